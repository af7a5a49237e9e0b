"""From scored pairs to decisions: thresholds, one owner a record, margins, and the best expected F0.5.

Pairs are (source1_entity_id, candidate_entity_id, p, ...). Ties go to the smaller id, everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocking import PAIR
from tessella.operators.competition import is_owner, ratio_to_first
from tessella.operators.evaluation import per_entity

S1, CAND = PAIR


def id_lists(universe: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for each S1 of the universe: its distinct candidates in order, joined by commas, or ''."""
    lists = pairs.groupBy(S1).agg(F.array_join(F.array_sort(F.collect_set(CAND)), ",").alias("_l"))
    return universe.join(lists, S1, "left").select(S1, F.coalesce("_l", F.lit("")).alias(name))


def above(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= threshold)


def one_owner(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Pairs at the threshold, of which each record keeps its best S1."""
    return above(pairs, threshold, p).withColumn("_o", is_owner(p)).where("_o").drop("_o")


def owner_above(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """The owner is decided over all pairs, then the threshold."""
    return pairs.withColumn("_o", is_owner(p)).where(F.col("_o") & (F.col(p) >= threshold)).drop("_o")


def rule_baseline(pairs: DataFrame, ranks: int, threshold: float, ratio: float, owner: bool = True) -> DataFrame:
    """Pairs to a rank, at a threshold, near the S1's first score, and of the record's best S1 among those ranks."""
    top = pairs.where(F.col("rank") <= ranks).withColumns({"_r": ratio_to_first(), "_o": is_owner("score")})
    keep = (F.col("score") >= threshold) & (F.col("_r") >= ratio) & (F.col("_o") | F.lit(not owner))
    return top.where(keep).drop("_r", "_o")


def prob_margin(pairs: DataFrame, p: str = "p") -> DataFrame:
    """pairs, with the record's best p and second p (0 if none), whether this p is the best (ties all are) and the margin."""
    w = Window.partitionBy(CAND).orderBy(F.col(p).desc(), F.col(S1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max(p).over(Window.partitionBy(CAND))
    second = F.coalesce(F.nth_value(p, 2).over(w), F.lit(0.0))
    return pairs.withColumns({"best_prob": best, "second_prob": second, "is_prob_owner": (F.col(p) == best), "prob_margin": F.round(best - second, 6)})


def margin_rule(pairs: DataFrame, sure: float, likely: float, gap: float, p: str = "p") -> DataFrame:
    """p >= sure, or p >= likely for the record's owner with a margin of gap."""
    m = prob_margin(pairs, p)
    return m.where((F.col(p) >= sure) | ((F.col(p) >= likely) & F.col("is_prob_owner") & (F.col("prob_margin") >= gap))).select(pairs.columns)


def expected_f05(pairs: DataFrame, bias: float | Column = 0.0, q: str = "q", by: tuple[str, ...] = ()) -> DataFrame:
    """Of each S1 (and each value of the columns `by`) the first k candidates by q, where k has the largest expected F0.5
    (the smallest such k), if that exceeds the chance that the S1 has no match at all; candidates of q 0 never."""
    bias = bias if isinstance(bias, Column) else F.lit(bias)
    whole = Window.partitionBy(*by, S1)
    order = whole.orderBy(F.col(q).desc(), F.col(CAND))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    k, tp, total = F.row_number().over(order), F.sum(q).over(upto), F.sum(q).over(whole)
    none = F.exp(F.sum(F.log1p(-F.least(F.col(q), F.lit(1 - 1e-6)))).over(whole))
    x = pairs.withColumns({"_k": k, "_f": F.round(F.lit(1.25) * tp / (F.lit(0.25) * total + k + bias), 9), "_none": F.round(none, 9)})
    x = x.withColumn("_best", F.max("_f").over(whole))
    x = x.withColumn("_at", F.min(F.when(F.col("_f") == F.col("_best"), F.col("_k"))).over(whole))
    return x.where((F.col("_best") > F.col("_none")) & (F.col("_k") <= F.col("_at")) & (F.col(q) > 0)).drop("_k", "_f", "_none", "_best", "_at")


@dataclass(frozen=True)
class Rule:
    """kind thr: x is a threshold; kind efo: x is a bias. owner: others than the record's best S1 count as 0."""

    prob: str = "p"
    kind: str = "thr"
    x: float = 0.5
    owner: bool = True


def select(pairs: DataFrame, rule: Rule, only: DataFrame | None = None) -> DataFrame:
    """Apply a rule; owners are decided over all pairs, the rule itself on the S1 of `only` if given."""
    q = F.when(is_owner(rule.prob), F.col(rule.prob)).otherwise(F.lit(0.0)) if rule.owner else F.col(rule.prob)
    owned = pairs.withColumn("q", q)
    if only is not None:
        owned = owned.join(only.select(S1).distinct(), S1, "left_semi")
    return owned.where(F.col("q") >= rule.x).drop("q") if rule.kind == "thr" else expected_f05(owned, rule.x).drop("q")


def sweep(pairs: DataFrame, truth: DataFrame, universe: DataFrame, thresholds: list[float], owners: tuple[bool, ...] = (True, False), p: str = "p") -> DataFrame:
    """Mean F0.5 of every (threshold, owner), in one pass: each pair counts for the configurations it passes.

    The list of configurations is exploded beside each pair, and sums by (configuration, S1) are taken before the shuffle.
    """
    spark = pairs.sparkSession
    configs = [(float(t), o) for o in owners for t in thresholds]
    hit = pairs.withColumn("_own", is_owner(p)).join(truth.select(*PAIR, F.lit(1).alias("_hit")), PAIR, "left")
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(o).alias("owner")) for t, o in configs])
    passed = F.filter(each, lambda c: (F.col(p) >= c["threshold"]) & (F.col("_own") | ~c["owner"]))
    got = hit.select(S1, "_hit", F.inline(passed)).groupBy("threshold", "owner", S1).agg(F.count("*").alias("n_pred"), F.count("_hit").alias("tp"))
    return mean_f05(got, spark.createDataFrame(configs, "threshold double, owner boolean"), truth, universe).drop("n_pairs")


def grid(pairs: DataFrame, truth: DataFrame, universe: DataFrame, ranks: list[int], thresholds: list[float], ratios: list[float], owners: tuple[bool, ...] = (True, False)) -> DataFrame:
    """Mean F0.5 and pairs of rule_baseline() for every (ranks, threshold, ratio, owner), in one pass over pairs (score, rank).

    A pair counts once for each `ranks` it is within, as the owner among those differs; the rest is as in sweep().
    """
    configs = [(r, float(t), float(a), o) for r in ranks for t in thresholds for a in ratios for o in owners]
    within = F.explode(F.array(*[F.lit(r) for r in ranks]))
    each = pairs.where(F.col("rank") <= max(ranks)).withColumn("_r", ratio_to_first()).select(*PAIR, "score", "_r", "rank", within.alias("ranks")).where("rank <= ranks")
    best = Window.partitionBy("ranks", CAND).orderBy(F.col("score").desc(), F.col(S1))
    hit = each.withColumn("_own", F.row_number().over(best) == 1).join(truth.select(*PAIR, F.lit(1).alias("_hit")), PAIR, "left")
    rules = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(a).alias("ratio"), F.lit(o).alias("owner")) for r, t, a, o in configs if r == ranks[0]])
    passed = F.filter(rules, lambda c: (F.col("score") >= c["threshold"]) & (F.col("_r") >= c["ratio"]) & (F.col("_own") | ~c["owner"]))
    got = hit.select(S1, "_hit", "ranks", F.inline(passed)).groupBy("ranks", "threshold", "ratio", "owner", S1).agg(F.count("*").alias("n_pred"), F.count("_hit").alias("tp"))
    return mean_f05(got, pairs.sparkSession.createDataFrame(configs, "ranks int, threshold double, ratio double, owner boolean"), truth, universe)


def bias_sweep(pairs: DataFrame, truth: DataFrame, universe: DataFrame, biases: list[float], owners: tuple[bool, ...] = (True, False), p: str = "p") -> DataFrame:
    """Mean F0.5 and pairs of expected_f05() for every (bias, owner), in one pass: a pair stands once for each configuration,
    as the prefix that is kept differs."""
    configs = [(float(b), o) for o in owners for b in biases]
    each = F.array(*[F.struct(F.lit(b).alias("bias"), F.lit(o).alias("owner")) for b, o in configs])
    q = F.when(F.col("_own") | ~F.col("owner"), F.col(p)).otherwise(F.lit(0.0))
    owned = pairs.withColumn("_own", is_owner(p)).select(*PAIR, p, "_own", F.inline(each)).withColumn("q", q)
    kept = expected_f05(owned, F.col("bias"), "q", ("bias", "owner"))
    hit = kept.join(truth.select(*PAIR, F.lit(1).alias("_hit")), PAIR, "left")
    got = hit.groupBy("bias", "owner", S1).agg(F.count("*").alias("n_pred"), F.count("_hit").alias("tp"))
    return mean_f05(got, pairs.sparkSession.createDataFrame(configs, "bias double, owner boolean"), truth, universe)


def mean_f05(got: DataFrame, configs: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """configs with f05, the mean over the universe, and n_pairs; got has n_pred and tp by configuration and S1."""
    by = configs.columns
    n_true = universe.join(truth.groupBy(S1).agg(F.count("*").alias("n_true")), S1, "left").select(S1, F.coalesce("n_true", F.lit(0)).alias("n_true"))
    # S1 without predictions score 1 if they have no match, else 0: counted once, not once a configuration.
    scored = got.join(n_true, S1).groupBy(*by).agg(F.sum(per_entity()["f05"]).alias("f"), F.count_if(F.col("n_true") == 0).alias("z"), F.sum("n_pred").alias("n_pairs"))
    totals = n_true.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("empty"))
    out = configs.join(scored, by, "left").join(F.broadcast(totals))  # one row
    f = (F.coalesce("f", F.lit(0.0)) + F.col("empty") - F.coalesce("z", F.lit(0))) / F.col("n")
    return out.select(*by, F.round(f, 6).alias("f05"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def best_across(sweeps: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """(family, config, f05): the n best rows of several sweeps; ties by family, then by the configuration's values."""
    each = [df.select(F.lit(k).alias("family"), F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c not in ("f05", "n_pairs")]).alias("config"), "f05") for k, df in sweeps.items()]
    return best_of(reduce(DataFrame.union, each), "f05", ["family", "config"], n)


def best_of(results: DataFrame, score: str, ties: list[Column | str], n: int = 1) -> DataFrame:
    """The n best rows of a sweep; ties by the given columns."""
    return results.orderBy(F.col(score).desc(), *ties).limit(n)
