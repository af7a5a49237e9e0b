"""Splits and samples by hashes: the same members in every run, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocking import PAIR

S1 = PAIR[0]


def hash_rank(seed: str, column: str) -> Column:
    """16 hexadecimal digits of SHA-256 over seed, a zero byte and the id; their order is a random order of ids."""
    return F.substring(F.sha2(F.concat(F.lit(seed), F.lit("\x00"), F.col(column)), 256), 1, 16)


def split(ids: DataFrame, test_percent: int = 20, seed: str = "42", column: str = S1) -> DataFrame:
    """ids with is_val: true for about test_percent of them."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit("\x00"), F.col(column)), 256), 1, 8), 16, 10).cast("long")
    return ids.select(column).distinct().withColumn("is_val", u % 100 < test_percent)


def members(df: DataFrame, ids: DataFrame, column: str = S1) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def quotas(strata: DataFrame, sample: int) -> DataFrame:
    """(stratum columns, population, quota): one each, the rest in proportion, remainders to the largest fractions.

    strata has a row for each stratum: few rows, so its windows over all rows are small.
    """
    keys = [c for c in strata.columns if c != "population"]
    every = Window.partitionBy(F.lit(1))
    x = strata.withColumns({"_n": F.count("*").over(every), "_all": F.sum("population").over(every)})
    room = F.greatest(F.lit(sample) - F.col("_n"), F.lit(0))
    exact = room * (F.col("population") - 1) / F.greatest(F.col("_all") - F.col("_n"), F.lit(1))
    x = x.withColumns({"_room": room, "_floor": F.floor(exact), "_part": F.round(exact - F.floor(exact), 9)})
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("_part").desc(), *keys)
    left = F.col("_room") - F.sum("_floor").over(every)
    quota = F.least(1 + F.col("_floor") + F.when(F.row_number().over(order) <= left, 1).otherwise(0), F.col("population"))
    return x.select(*keys, "population", quota.cast("long").alias("quota"))


def stratified(rows: DataFrame, keys: list[str], sample: int, seed: str = "sample", column: str = S1) -> DataFrame:
    """A sample of ids in proportion to strata; within a stratum the smallest hashes."""
    q = quotas(rows.groupBy(*keys).agg(F.count("*").alias("population")), sample)
    w = Window.partitionBy(*keys).orderBy(hash_rank(seed, column), column)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked.join(q, keys).where(F.col("_n") <= F.col("quota")).select(column, *keys)


def first_by_hash(ids: DataFrame, n: int, seed: str = "sample", column: str = S1) -> DataFrame:
    """n ids in hash order."""
    return ids.select(column).distinct().orderBy(hash_rank(seed, column), column).limit(n)


def numbered(ids: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """ids with their ordinal from 0, by a numeric order column without repeats: rows go to ranges between approximate
    quantiles, are numbered within each, and start behind the counts of the ranges before. No task gets all rows."""
    bounds = sorted(set(ids.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005))) or [0.0]
    x = ids.withColumn("_b", F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col(order))))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return x.withColumn("_m", within).join(F.broadcast(starts), "_b").withColumn("ordinal", F.col("_s") + F.col("_m") - 1).drop("_b", "_m", "_s")  # a row a range


def part(ordinals: DataFrame, i: int, n: int) -> DataFrame:
    """Slice i (from 0) of n, by ordinal modulo n."""
    return ordinals.where(F.col("ordinal") % n == i)


def row_range(ordinals: DataFrame, low: int, high: int) -> DataFrame:
    return ordinals.where((F.col("ordinal") >= low) & (F.col("ordinal") < high))
