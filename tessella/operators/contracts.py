"""Contracts of tables: each check is a query for violations; require() raises if one finds any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocking import PAIR

S1, CAND = PAIR


class ContractError(ValueError):
    pass


def columns(df: DataFrame, required: list[str]) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df


def ill_formed(column: str, prefixes: tuple[str, ...]) -> Column:
    """True for null, blank or untrimmed ids, and for ids without one of the prefixes."""
    c = F.col(column)
    fits = reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
    return c.isNull() | (F.trim(c) == "") | (F.trim(c) != c) | ~fits


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def candidate_violations(pairs: DataFrame) -> DataFrame:
    """(violation, n) of a candidate table: ill-formed ids and repeated pairs."""
    bad = pairs.agg(F.count_if(ill_formed(S1, ("S1-",))).alias("bad_s1"), F.count_if(ill_formed(CAND, ("S2-", "S3-"))).alias("bad_candidate"))
    again = repeated(pairs, PAIR).agg(F.count("*").alias("repeated_pairs"))
    one = bad.join(F.broadcast(again))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in ("bad_s1", "bad_candidate", "repeated_pairs")])))


def id_violations(df: DataFrame, column: str, prefixes: tuple[str, ...]) -> DataFrame:
    """One row of a universe or a record table: rows, ill-formed ids, ids that come more than once."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(ill_formed(column, prefixes), F.col("n"))), F.lit(0)).alias("bad_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"))


def score_violations(scores: DataFrame, score: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row: null, NaN or infinite scores, and scores outside [low, high]."""
    c, odd = F.col(score).cast("double"), not_finite(score)
    out = (F.lit(False) if low is None else c < low) | (F.lit(False) if high is None else c > high)
    return scores.agg(F.count("*").alias("n_rows"), F.count_if(odd).alias("not_finite"), F.count_if(~odd & out).alias("out_of_range"))


def not_finite(column: str) -> Column:
    c = F.col(column).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def competition_violations(features: DataFrame, pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of what competition features are made of: pairs that repeat in either table, records with several rows of
    statistics, scores and statistics that are no finite numbers, and pairs whose record has no statistics."""
    columns(features, PAIR), columns(pairs, [*PAIR, "score"]), columns(stats, [CAND, "best_score", "second_score", "n_s1", "best_s1"])
    rows = [
        repeated(features, PAIR).agg(F.count("*").alias("repeated_features")), repeated(pairs, PAIR).agg(F.count("*").alias("repeated_pairs")), repeated(stats, [CAND]).agg(F.count("*").alias("repeated_stats")),
        pairs.agg(F.count_if(not_finite("score")).alias("bad_scores")), stats.agg(F.count_if(not_finite("best_score") | not_finite("n_s1")).alias("bad_stats")),
        features.select(CAND).join(stats.select(CAND), CAND, "left_anti").agg(F.count("*").alias("without_stats")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # one row each


def strangers(pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """S1 of pairs that the universe does not have."""
    return pairs.select(S1).distinct().join(universe.select(S1), S1, "left_anti")


def coverage(universe: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: ids of the universe without a decision, decisions outside it, decisions that come twice."""
    u = universe.groupBy(S1).agg(F.count("*").alias("u"))
    d = decided.groupBy(S1).agg(F.count("*").alias("d"))
    return u.join(d, S1, "outer").agg(F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("u").isNull()).alias("extra"), F.count_if(F.col("d") > 1).alias("repeated"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many ids two sets share."""
    return a.select(S1).intersect(b.select(S1)).agg(F.count("*").alias("shared"))


def group_sizes(pairs: DataFrame, most: int) -> DataFrame:
    """One row: groups, the largest, and groups of more than `most` pairs."""
    per = pairs.groupBy(S1).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("n") > most).alias("oversize"))


def submission_problems(universe: DataFrame, decided: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row: coverage of the universe, lists of blanks, trailing commas, lists that repeat an id, ill-formed ids."""
    v = F.coalesce(F.col(column), F.lit(""))
    ids = F.filter(F.split(v, ","), lambda x: x != "")
    shape = decided.agg(
        F.count("*").alias("n_rows"), F.count_if(v == "").alias("empty_lists"), F.count_if((v != "") & (F.trim(v) == "")).alias("blank_lists"), F.count_if(v.endswith(",")).alias("trailing_commas"),
        F.count_if(F.size(F.array_distinct(ids)) < F.size(ids)).alias("repeats"), F.coalesce(F.sum(F.size(F.filter(ids, lambda x: ~x.rlike("^S[23]-")))), F.lit(0)).cast("long").alias("bad_ids"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).cast("long").alias("n_ids"),
    )
    return shape.join(F.broadcast(coverage(universe, decided)))  # one row each


def list_problems(universe: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: matched pairs that are no candidates, with the coverage of the candidate lists' S1."""
    wild = matches.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_anti").agg(F.count("*").alias("not_candidates"))
    return wild.join(F.broadcast(coverage(universe, candidates.select(S1).distinct())))  # one row each


def require(violations: DataFrame, counts: list[str]) -> None:
    """Raise unless all counts of a one-row violation table are 0."""
    row = violations.select(*counts).first()
    if row is not None and any(row):
        raise ContractError(", ".join(f"{c}: {row[c]}" for c in counts if row[c]))
