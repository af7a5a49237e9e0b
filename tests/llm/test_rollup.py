import pytest
from pyspark.sql import functions as F

from tessella.llm import rollup as R

FEED = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, n_docs string"


def test_deltas_and_replays(spark, tmp_path):
    at = R.Rollup(spark, str(tmp_path / "r"))
    assert at.totals().count() == 0
    a = spark.createDataFrame([("insert", "s", "en", "v", None, 10, "x"), ("insert", "s", "en", "v", None, 5, "x"), ("insert", None, "en", "v", 0, 1, "x")], FEED)
    b = spark.createDataFrame([("revise", "s", "en", "v", 10, 7, "x"), ("delete", None, "en", "v", 1, None, "x")], FEED)
    assert at.apply("1", a) and not at.apply("1", a) and at.apply("2", b)
    want = [("s", "en", "v", 2, 12)]
    assert [tuple(r) for r in at.totals().collect()] == want
    at.compact()
    assert not at.apply("2", b) and [tuple(r) for r in at.totals().collect()] == want
    assert at.apply("3", b.limit(0)) and at.apply("4", a.limit(1))
    at.compact()
    assert [tuple(r) for r in at.totals().collect()] == [("s", "en", "v", 3, 22)] and not at.apply("1", a)
    with pytest.raises(Exception, match="unknown op"):
        at.apply("5", a.withColumn("op", F.lit("upsert")))


def test_a_run_that_died_is_written_anew(spark, tmp_path):
    at = R.Rollup(spark, str(tmp_path / "r"))
    a = spark.createDataFrame([("insert", "s", "en", "v", None, 10, "x")], FEED)
    at.apply("1", a)
    (tmp_path / "r" / "batch=1" / "_SUCCESS").unlink()
    assert at.totals().count() == 0 and at.apply("1", a) and at.totals().first()["n_tokens"] == 10


def test_query(spark, docs, rows, empty, tmp_path):
    import re

    for name, df in (("full", docs), ("none", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert R.query(spark, str(tmp_path / "none")).count() == 0
    got = {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in R.query(spark, str(tmp_path / "full")).collect()}
    want = {}
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t in rows:
        if i is not None and first[t or ""] < i:
            continue
        for v, p in R.PATTERNS.items():
            x = want.setdefault((None if i is None else f"src{i % 3}", v), [0, 0])
            x[0] += 1
            x[1] += len(re.findall(p, re.sub("[0-9]+", "", t or "")))
    assert got == {k: tuple(v) for k, v in want.items()}
