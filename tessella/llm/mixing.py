"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Every document of source s is repeated Poisson(rate_s) times, where rate_s = share_s * budget / size_s: share_s is
the source's target share of the mixture, size_s its size and budget the size of the mixture. The count inverts the
Poisson distribution function at a uniform number hashed from (seed, doc_id), so it is the same in every run and on
every cluster. Copies then go to partitions and into order by a second hash: a global shuffle.

Sizes are characters plus one a document (its separator), so that sources of empty texts have a size.
Defined cases: a null source is a source of its own; a null text has size 1; a null doc_id hashes as ''; rows that
repeat a doc_id get the same count each; a source without a weight, or with one of 0 or less, is left out; an empty
table gives an empty mixture. All input columns pass through; `copy` and `mix_key` replace input columns of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, passing

SEED = 17
#: A rates table of at most so many rows and numbers of distribution functions (8 bytes each) is broadcast; a larger one
#: meets salted documents instead.
BROADCAST_ROWS, BROADCAST_NUMBERS = 10_000, 2_000_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("_size"))


def tempered(docs: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Target weights (source, weight) of size ** exponent: under 1, small sources gain."""
    return sizes(docs).select(F.col("_source").alias("source"), F.pow("_size", F.lit(exponent)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, budget: float | None = None) -> DataFrame:
    """(_source, _rate, _from, _cdf): the mean repetition and the distribution function from the count _from on, to where a
    double reaches 1. _from is 0 for rates under 1,000; else counts under it, 12 deviations and 40 below the mean, have
    chances that a double can not add to the rest, so a tiny source of a huge mixture needs some roots of its rate."""
    w = weights.where("weight > 0").select(F.col("source").alias("_w_source"), F.col("weight").cast("double").alias("_weight"))
    each = cut(sizes(docs), "sizes")
    has = cut(each.join(w, F.col("_source").eqNullSafe(F.col("_w_source"))).drop("_w_source"), "weighted")
    shares, size = has.agg(F.sum("_weight")).first()[0] or 1.0, budget or each.agg(F.sum("_size")).first()[0] or 0.0  # two numbers
    r = has.select("_source", (F.col("_weight") / F.lit(shares) * F.lit(float(size)) / F.col("_size")).alias("_rate"))
    wide = 12 * F.sqrt("_rate") + 40
    r = r.withColumn("_from", F.when(F.col("_rate") < 1000, F.lit(0)).otherwise(F.floor(F.col("_rate") - wide)).cast("long"))
    k = r.select("_source", "_rate", "_from", F.explode(F.sequence("_from", F.ceil(F.col("_rate") + wide).cast("long"))).alias("_k"))
    upto = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumn("_p", F.exp(F.col("_k") * F.log("_rate") - F.col("_rate") - log_factorial("_from") - F.sum(F.when(F.col("_k") > F.col("_from"), F.log("_k")).otherwise(F.lit(0.0))).over(upto)))
    k = k.withColumn("_c", F.sum("_p").over(upto))
    return k.groupBy("_source").agg(F.first("_rate").alias("_rate"), F.first("_from").alias("_from"), F.expr("transform(array_sort(collect_list(struct(_k, _c))), x -> x._c)").alias("_cdf"))


def log_factorial(n: str) -> Column:
    """ln n! by Stirling's series, 0 for 0. Other n are over 500 here, where these terms are exact to a double."""
    x = F.col(n).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3)))
    return F.when(x >= 1, series).otherwise(F.lit(0.0))


def replicate(docs: DataFrame, weights: DataFrame, budget: float | None = None, seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs repeated to the target weights, in shuffled order.

    weights: (source, weight), one row a source. budget: characters of the mixture, those of docs if not given.
    """
    columns = [c for c in docs.columns if c not in ("copy", "mix_key")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])  # apart from the names used here
    plain = docs.select("doc_id", "source", row.alias("_row"))
    with passing() as kept:
        table = kept(cut(rates(docs.select("source", "text"), weights, budget), "rates"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows, numbers = table.agg(F.count("*"), F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()  # two numbers
    if rows <= broadcast_rows and numbers <= BROADCAST_NUMBERS:
        met = plain.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = plain.withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    n = F.col("_from") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    many = met.withColumn("_u", uniform(F.lit(str(seed)), key)).withColumn("_n", n).where("_n > 0")
    out = many.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    out = out.select(*[F.col("_row").getField(c).alias(c) for c in columns], F.col("copy").cast("long").alias("copy"), F.md5(F.concat_ws("|", F.lit(f"{seed}s"), key, F.col("copy").cast("string"))).alias("mix_key"))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


#: replicate(documents, tempered(documents)) in DuckDB.
SQL = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::INT + 1)) AS k FROM r),
p AS (SELECT source, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source),
d AS (SELECT d.*, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents d),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len(list_filter(cdf, lambda x: x <= u)) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n)) AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, md5('{SEED}s|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS mix_key FROM e
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs, tempered(docs))
