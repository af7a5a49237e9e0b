"""How the S1 of one record compete: statistics by record, features, and windows over records and over S1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocking import PAIR

S1, CAND = PAIR
FEATURES = ["blocking_score", "best_score", "second_score", "n_s1", "is_best_s1", "margin_to_best", "owner_gap"]


def record_stats(pairs: DataFrame) -> DataFrame:
    """By record: best and second score (null if there is none), how many S1, and the best S1 (ties: smallest id).

    The second score is the largest that is left beside one best: equal to it if two S1 tie. Plain aggregates that
    combine in every task: the two best scores come from the maximum, how often it occurs, and the largest below it.
    """
    best = pairs.groupBy(CAND).agg(F.max("score").alias("best_score"), F.count("*").alias("n_s1"))
    joined = pairs.join(best, CAND)
    top = F.col("score") == F.col("best_score")
    sums = joined.groupBy(CAND, "best_score", "n_s1").agg(F.count_if(top).alias("_ties"), F.max(F.when(~top, F.col("score"))).alias("_below"), F.min(F.when(top, F.col(S1))).alias("best_s1"))
    second = F.when(F.col("_ties") > 1, F.col("best_score")).otherwise(F.col("_below"))
    return sums.select(CAND, "best_score", second.alias("second_score"), "n_s1", "best_s1")


def competition_features(pairs: DataFrame, stats: DataFrame, missing_second: float = -1.0) -> DataFrame:
    """pairs (with score) and the seven features of FEATURES; a record without statistics has zeros."""
    j = pairs.join(stats, CAND, "left")
    best, second = F.coalesce("best_score", F.lit(0.0)), F.coalesce("second_score", F.lit(missing_second))
    return j.select(
        *PAIR, F.col("score").alias("blocking_score"), best.alias("best_score"), second.alias("second_score"), F.coalesce("n_s1", F.lit(0)).cast("long").alias("n_s1"),
        F.coalesce(F.col(S1) == F.col("best_s1"), F.lit(False)).cast("int").alias("is_best_s1"), (best - F.col("score")).alias("margin_to_best"), (best - second).alias("owner_gap"),
    )


def by_record(p: str = "p") -> Window:
    return Window.partitionBy(CAND).orderBy(F.col(p).desc(), F.col(S1))


def is_owner(p: str = "p") -> Column:
    """True for the S1 with the record's largest p (ties: smallest S1)."""
    return F.row_number().over(by_record(p)) == 1


def ratio_to_first(score: str = "score") -> Column:
    """score over the score of the S1's rank-1 row; null without such a row."""
    first = F.max(F.when(F.col("rank") == 1, F.col(score))).over(Window.partitionBy(S1))
    return F.col(score) / first


def record_context(pairs: DataFrame) -> DataFrame:
    """pairs (with p) and how p compares within the record and within the S1."""
    rec, s1 = Window.partitionBy(CAND), Window.partitionBy(S1)
    whole = by_record().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(by_record())
    other = F.coalesce(F.when(rank == 1, F.nth_value("p", 2).over(whole)).otherwise(F.nth_value("p", 1).over(whole)), F.lit(0.0))
    top = F.max("p").over(s1)
    return pairs.select(
        "*", F.count("*").over(rec).alias("rec_n"), F.round(F.sum("p").over(rec), 6).alias("rec_sum"), rank.cast("long").alias("rec_rank"), other.alias("rec_other"),
        F.count("*").over(s1).alias("s1_n"), F.count_if(F.col("p") >= 0.5).over(s1).alias("s1_n05"), F.round(F.sum("p").over(s1), 6).alias("s1_sum"), top.alias("s1_max"),
        F.row_number().over(Window.partitionBy(S1).orderBy(F.col("p").desc(), F.col(CAND))).cast("long").alias("s1_rank"), F.round(F.col("p") / F.greatest(top, F.lit(1e-6)), 6).alias("p_over_s1max"),
    ).withColumn("p_minus_other", F.round(F.col("p") - F.col("rec_other"), 6))


def siblings(pairs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """For each key: the p of the S1's other candidates with the record's value (sup), how many (cnt), their share of the
    others' p, and whether the S1 has the value too; -1 where the record has none. keys: entity_id and one column a name."""
    rec = keys.select(F.col("entity_id").alias(CAND), *[F.coalesce(n, F.lit("")).alias(f"_r_{n}") for n in names])
    own = keys.select(F.col("entity_id").alias(S1), *[F.coalesce(n, F.lit("")).alias(f"_s_{n}") for n in names])
    j = pairs.join(rec, CAND, "left").join(own, S1, "left")
    total = F.sum("p").over(Window.partitionBy(S1))
    out = []
    for n in names:
        val, w = F.coalesce(f"_r_{n}", F.lit("")), Window.partitionBy(S1, f"_r_{n}")
        sup, none = F.sum("p").over(w) - F.col("p"), val == ""
        out += [
            F.when(none, F.lit(-1.0)).otherwise(F.round(sup, 6)).alias(f"{n}_sup"), F.when(none, F.lit(-1)).otherwise(F.count("*").over(w) - 1).cast("long").alias(f"{n}_cnt"),
            F.when(none, F.lit(-1.0)).otherwise(F.round(sup / F.greatest(total - F.col("p"), F.lit(1e-6)), 6)).alias(f"{n}_share"), (~none & (val == F.coalesce(f"_s_{n}", F.lit("")))).cast("int").alias(f"{n}_eq_s1"),
        ]
    return j.select(*pairs.columns, *out)
