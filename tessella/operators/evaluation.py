"""Macro and micro measures of decisions and of candidates, and accounts of their errors.

truth and predictions are (source1_entity_id, candidate_entity_id); universe has every S1 once. Repeated pairs count
once, predictions for S1 outside the universe are not counted, S1 without predictions have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.similarity import f05
from tessella.operators.blocking import PAIR

S1, CAND = PAIR
BUCKETS = ["0", "1", "2-5", "6+"]


def explode_lists(wide: DataFrame, column: str) -> DataFrame:
    """A comma list of ids to distinct pairs."""
    each = wide.select(S1, F.explode(F.split(F.coalesce(column, F.lit("")), ",")).alias(CAND))
    return each.select(S1, F.trim(CAND).alias(CAND)).where(f"{CAND} <> ''").distinct()


def per_entity() -> dict[str, Column]:
    """Precision, recall and F0.5 of columns n_true, n_pred, tp; an S1 with nothing to find and nothing found has 1."""
    p = F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "n_true"), F.lit(0.0))
    clean = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    one = lambda x: F.when(clean, F.lit(1.0)).otherwise(x)
    return {"precision": one(p), "recall": one(r), "f05": one(f05(p, r))}


def entity_counts(universe: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """n_true, n_pred and tp of each S1, from one grouping of marked pairs."""
    marked = truth.select(*PAIR, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predictions.select(*PAIR, F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = marked.groupBy(*PAIR).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    sums = pairs.groupBy(S1).agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "tp")]
    return universe.select(S1).join(sums, S1, "left").select(S1, *zero)


def scored_entities(universe: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return entity_counts(universe, truth, predictions).withColumns(per_entity())


def macro(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    single = F.col("n_true") == 0
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n_entities"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.sum("n_pred").alias("predicted_pairs"), F.sum("n_true").alias("true_pairs"), F.count_if(single).alias("singletons"), F.count_if(single & (F.col("n_pred") == 0)).alias("correct_singletons"),
    )


def micro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    tp, pred, true = F.sum("tp"), F.sum("n_pred"), F.sum("n_true")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return counts.groupBy(*(by or [])).agg(
        tp.alias("tp"), (pred - tp).alias("fp"), (true - tp).alias("fn"), rate(tp, pred).alias("pair_precision"), rate(tp, true).alias("pair_recall"),
        rate(F.count_if((F.col("n_true") > 0) & (F.col("n_pred") == 0)), F.count_if(F.col("n_true") > 0)).alias("nonsingleton_empty_rate"),
    )


def bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").otherwise("6+")


def match_group(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")


def hits_at(universe: DataFrame, truth: DataFrame, candidates: DataFrame, ks: list[int]) -> DataFrame:
    """(k, S1, n_true, n_hit, n_cand) for each k: each pair counts from its best rank on."""
    best = candidates.groupBy(*PAIR).agg(F.min("rank").alias("rank"))
    hit = best.join(truth.select(*PAIR, F.lit(1).alias("h")).distinct(), PAIR, "left")
    sums = [x for k in ks for x in (F.count_if((F.col("rank") <= k) & F.col("h").isNotNull()).alias(f"h{k}"), F.count_if(F.col("rank") <= k).alias(f"c{k}"))]
    per = hit.groupBy(S1).agg(*sums)
    n = truth.distinct().groupBy(S1).agg(F.count("*").alias("n_true"))
    wide = universe.select(S1).join(n, S1, "left").join(per, S1, "left")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("n_hit"), F.coalesce(f"c{k}", F.lit(0)).alias("n_cand")) for k in ks])
    return wide.select(S1, F.coalesce("n_true", F.lit(0)).alias("n_true"), F.inline(each))


def ceiling() -> Column:
    """The F0.5 of a perfect choice among the candidates that were found."""
    r = F.col("n_hit") / F.col("n_true")
    return F.when(F.col("n_true") == 0, F.lit(1.0)).when(F.col("n_hit") == 0, F.lit(0.0)).otherwise(f05(F.lit(1.0), r))


def blocking_measures(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    true, hit = F.sum("n_true"), F.sum("n_hit")
    some = F.col("n_true") > 0
    return hits.groupBy("k", *(by or [])).agg(
        F.count("*").alias("n_entities"), F.round(F.coalesce(F.try_divide(hit, true), F.lit(0.0)), 6).alias("recall"), F.round(F.avg(ceiling()), 6).alias("ceiling_f05"),
        F.round(F.coalesce(F.try_divide(F.count_if(some & (F.col("n_hit") == F.col("n_true"))), F.count_if(some)), F.lit(0.0)), 6).alias("full_coverage"),
        F.round(F.avg("n_cand"), 6).alias("avg_candidates"), F.round(F.percentile("n_cand", F.lit(0.95)), 6).alias("p95_candidates"), F.max("n_cand").alias("max_candidates"), F.sum("n_cand").alias("total_candidates"),
        F.count_if(F.col("n_cand") == 0).alias("without_candidates"),
    )


def misses(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """True pairs that no candidate has."""
    return truth.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_anti")


def error_counts(universe: DataFrame, truth: DataFrame, candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: false negatives split into pairs that blocking missed and pairs that the matcher rejected."""
    mark = lambda df, n: df.select(*PAIR).distinct().withColumn(n, F.lit(1))
    known = universe.select(S1).distinct()
    t = mark(truth.join(known, S1, "left_semi"), "t")
    j = t.join(mark(candidates, "c"), PAIR, "left").join(mark(predictions, "p"), PAIR, "outer").join(known, S1, "left_semi")
    pairs = j.agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull() & F.col("p").isNotNull()).alias("fp"),
        F.count_if(F.col("t").isNotNull() & F.col("p").isNull()).alias("fn"), F.count_if(F.col("t").isNotNull() & F.col("c").isNull()).alias("blocking_misses"),
        F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull() & F.col("p").isNull()).alias("matcher_rejections"),
    )
    single = known.join(t, S1, "left_anti")
    right = single.join(predictions.select(S1), S1, "left_anti")
    counts = single.agg(F.count("*").alias("singletons")).join(F.broadcast(right.agg(F.count("*").alias("correct_singletons"))))
    return pairs.join(F.broadcast(counts))  # one row each


def error_type(score: str, threshold: float, label: str = "label") -> Column:
    """false_positive, false_negative or '' for a pair that a threshold decides."""
    yes = F.col(score) >= threshold
    return F.when(yes & (F.col(label) == 0), "false_positive").when(~yes & (F.col(label) == 1), "false_negative").otherwise("")


def error_examples(pairs: DataFrame, score: str, threshold: float, n: int = 100, label: str = "label") -> DataFrame:
    """The n wrongly decided pairs of the largest scores (ties: smaller ids)."""
    wrong = pairs.withColumn("error_type", error_type(score, threshold, label)).where("error_type <> ''")
    return wrong.orderBy(F.col(score).desc(), *PAIR).limit(n)


def part_problems(facts: DataFrame, ids: DataFrame, pairs: DataFrame, n: int, agree: list[str]) -> DataFrame:
    """One row: what forbids merging n parts. facts has a row a part (part from 1, n_s1, n_pairs and the columns on which
    parts must agree), ids each part's S1, pairs its pairs: parts that are missing, unknown or repeated, columns that
    differ, parts whose S1 or pairs are not as many as its facts say, and S1 that come more than once."""
    parts = facts.groupBy("part").agg(F.count("*").alias("_n"))
    known = F.col("part").between(1, n)
    shape = parts.agg((F.lit(n) - F.count_if(known)).alias("missing_parts"), F.count_if(~known).alias("unknown_parts"), F.count_if(F.col("_n") > 1).alias("repeated_parts"))
    differ = facts.agg(sum((F.count_distinct(c) > 1).cast("long") for c in agree).alias("differing"))
    size = lambda df, name: df.groupBy("part").agg(F.count("*").alias(name))
    j = facts.join(size(ids, "_s1"), "part", "outer").join(size(pairs, "_pairs"), "part", "outer")
    off = lambda have, said: ~F.coalesce(F.col(have), F.lit(0)).eqNullSafe(F.col(said))
    sizes = j.agg(F.count_if(off("_s1", "n_s1")).alias("wrong_s1"), F.count_if(off("_pairs", "n_pairs")).alias("wrong_pairs"))
    again = ids.groupBy(S1).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("repeated_s1"))
    return shape.join(F.broadcast(differ)).join(F.broadcast(sizes)).join(F.broadcast(again))  # one row each


def weighted_merge(parts: DataFrame, metrics: dict[str, str], by: list[str]) -> DataFrame:
    """Means of part-wise ratios, weighted by each metric's weight column."""
    return parts.groupBy(*by).agg(*[F.round(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col(w)), F.sum(w)), F.lit(0.0)), 6).alias(m) for m, w in metrics.items()])


def artifact_facts(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, distinct keys and rows that repeat a key."""
    keys = df.groupBy(*key).agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
