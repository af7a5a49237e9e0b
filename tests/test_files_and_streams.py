import json

import pytest
from pyspark.sql import functions as F

from tessella.operators.contracts import ContractError
from tessella.sources import files as I
from tessella.streaming import competition as S


def test_raw_tsv(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_bytes('entity_id\tbusiness_name\tbusiness_address\tcountry\r\nS1-1\t"NA" \\ co\t\tUS\r\nS1-2\tNone\tx "y\tFR\r\n'.encode())
    rows = [tuple(r) for r in I.read_tsv(spark, str(p)).collect()]
    assert rows == [("S1-1", '"NA" \\ co', "", "US"), ("S1-2", "None", 'x "y', "FR")]
    df = I.convert(spark, str(p), str(tmp_path / "s.parquet"))
    assert df.count() == 2 and I.load_source(df, ["country"]).columns == ["country"]
    with pytest.raises(ContractError):
        I.load_source(df, ["zip"])


def test_lists_round_trip(spark, tmp_path):
    uni = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "source1_entity_id string, ordinal long")
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-9", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    I.write_lists(uni, pairs, str(tmp_path / "parts"))
    I.joined_file(spark, str(tmp_path / "parts"), str(tmp_path / "out.tsv"))
    assert (tmp_path / "out.tsv").read_bytes() == b"source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-1,S3-1\nS1-3\t\n"
    universe, truth = I.read_truth(spark, str(tmp_path / "out.tsv"))
    assert universe.count() == 3 and sorted(map(tuple, truth.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    with pytest.raises(ContractError):
        I.write_lists(uni.union(uni), pairs, str(tmp_path / "again"))


def test_ids_manifest_and_log(spark, tmp_path):
    p = tmp_path / "ids.csv"
    p.write_text("entity_id\n" + "".join(f"S1-{9 - i}\n" for i in range(10)))
    ids = I.read_ids(spark, str(p))
    assert [r[0] for r in I.prefix(ids, 3).orderBy("ordinal").collect()] == ["S1-9", "S1-8", "S1-7"]
    p.write_text("entity_id\nS2-1\n")
    with pytest.raises(ContractError):
        I.read_ids(spark, str(p))
    a, b = (spark.createDataFrame([(x,) for x in v], "source1_entity_id string") for v in (["S1-1", "S1-2"], ["S1-3"]))
    I.write_manifest(tmp_path / "m.json", a, b, "42")
    I.verify_manifest(tmp_path / "m.json", a, b)
    with pytest.raises(ContractError):
        I.verify_manifest(tmp_path / "m.json", b, a)
    I.log_run(tmp_path / "log" / "runs.jsonl", name="x")
    assert json.loads((tmp_path / "log" / "runs.jsonl").read_text())["name"] == "x"
    assert len(I.config_hash({"k": 1})) == 12 and I.sha256_file(p) == I.sha256_file(p)


def test_data_dir(tmp_path):
    with pytest.raises(FileNotFoundError):
        I.data_dir(str(tmp_path))
    for n in ("train", "test"):
        (tmp_path / n).mkdir()
    assert I.data_dir(str(tmp_path)) == tmp_path


def test_scores_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 1, 0.5)], "s string, rank int, p double")
    assert I.write_scores(df, str(tmp_path / "s"), "a") and not I.write_scores(df, str(tmp_path / "s"), "a")
    assert I.write_scores(df.withColumn("rank", F.lit(9)), str(tmp_path / "s"), "b")
    assert I.read_scores(spark, str(tmp_path / "s")).count() == 2 and I.read_scores(spark, str(tmp_path / "s"), 5).count() == 1


def test_streams(spark, tmp_path):
    schema = "source1_entity_id string, candidate_entity_id string, score double"
    for i, rows in enumerate([[("S1-2", "x", 0.9), ("S1-1", "y", 0.1)], [("S1-1", "x", 0.9), ("S1-3", "x", 0.2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = S.running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r[0]: tuple(r)[1:] for r in spark.table("running").collect()} == {"x": (0.9, 3, "S1-1"), "y": (0.1, 1, "S1-1")}
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        S.score_stream(stream, lambda b: b.withColumn("p", F.col("score") / 2), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 4
