import math
from collections import Counter

from conftest_llm import frame
from pyspark.sql import functions as F

from tessella.llm import mixing as M


def test_counts_follow_the_inverse_distribution(spark, docs, rows):
    w = M.tempered(docs)
    got = Counter((r["doc_id"], r["text"]) for r in M.replicate(docs, w).collect())
    size = {}
    for i, t in rows:
        size[None if i is None else i % 3] = size.get(None if i is None else i % 3, 0) + len(t or "") + 1
    share = {s: math.sqrt(x) for s, x in size.items()}
    import hashlib

    want = Counter()
    for i, t in rows:
        s = None if i is None else i % 3
        rate = share[s] / sum(share.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"{M.SEED}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[i, t] += k
    assert got == +want


def test_many_sources_take_the_salted_way(spark, docs):
    w = M.tempered(docs)
    key = lambda df: sorted((str(r["doc_id"]), r["copy"], r["mix_key"]) for r in df.collect())
    assert key(M.replicate(docs, w)) == key(M.replicate(docs, w, broadcast_rows=1))


def test_weights_and_edges(spark, docs, empty):
    one = spark.createDataFrame([("src1", 2.0), ("src2", 0.0)], "source string, weight double")
    out = M.replicate(docs, one)
    assert {r["source"] for r in out.collect()} <= {"src1"} and set(out.columns) == set(docs.columns)
    size = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0]
    got = out.agg(F.sum(F.length("text") + 1)).first()[0]
    assert 0.6 < got / size < 1.6
    assert M.replicate(empty, one).count() == 0
    big = M.replicate(frame(spark, [(i * 3 + 1, "x" * 9) for i in range(4)]), spark.createDataFrame([("src1", 1.0)], "source string, weight double"), budget=40_000.0)
    assert abs(big.count() - 4000) < 300


def test_large_rates(spark):
    """Counts at a rate of 30,000, by the distribution function in exact steps of its logarithm."""
    import hashlib

    rate, got = 30_000.0, {}
    docs = frame(spark, [(i * 3 + 1, "x" * 9) for i in range(12)])
    out = M.replicate(docs, spark.createDataFrame([("src1", 1.0)], "source string, weight double"), budget=rate * 120)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.where("copy < 0").isEmpty()
    assert M.rates(docs, spark.createDataFrame([("src1", 1.0)], "source string, weight double"), rate * 120).select(F.size("_cdf")).first()[0] < 30 * rate**0.5
    for i, n in got.items():
        u = int(hashlib.md5(f"{M.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, 0.0
        while True:
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if c > u:
                break
            k += 1
        assert abs(k - n) <= (abs(c - u) < 1e-8)
