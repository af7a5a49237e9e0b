import sentencepiece
from conftest_llm import frame

import corpus_pipeline as P
from tessella.llm import quality as Q
from tessella.llm import sentencepiece_codec as C


def test_stages(spark, docs, rows, empty, tmp_path):
    for name, df in (("full", docs), ("none", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "sentencepiece"]
    step, before = docs, len(rows)
    for name, f in P.STAGES[:-1]:
        step = f(spark, step, str(tmp_path / "full")).persist()
        assert step.columns == docs.columns
        if name == "quality_rules":
            judged = Q.judge(docs, spark.read.parquet(str(tmp_path / "full" / "labels.parquet"))).where("kept").collect()
            assert sorted(str(r["doc_id"]) for r in step.collect()) == sorted(str(r["doc_id"]) for r in judged)
        if name != "mix_sources":
            assert step.count() <= before
            before = step.count()
    library = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    last = P.STAGES[-1][1](spark, step, str(tmp_path / "full")).collect()
    assert sorted(r["token_ids"] for r in last) == sorted(library.encode(r["text"] or "") for r in step.collect()) and all(r["round_trip"] for r in last)


def test_clean_documents_pass(spark, tmp_path):
    import random

    rng = random.Random(5)
    w = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(w, k=60))) for i in range(50)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 50, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in P.STAGES[:3]:
        step = f(spark, step, str(tmp_path))
    assert sorted(tuple(r)[:2] for r in step.collect()) == sorted(rows)
