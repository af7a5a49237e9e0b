"""Why candidates miss true pairs, and what each channel adds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.blocking import PAIR
from tessella.operators.evaluation import ceiling, hits_at, misses
from tessella.operators.features import sides

S1, CAND = PAIR


def miss_reasons(truth: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """(reason, n) of true pairs without a candidate: the first reason that holds."""
    rec = records.select("entity_id", "country", F.coalesce("business_address", F.lit("")).alias("addr"), T.non_ascii(F.col("business_name")).alias("far"), F.array_distinct(T.word_tokens(F.concat_ws(" ", "business_name", "business_address"))).alias("tokens"))
    j = sides(misses(truth, candidates), rec)
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    full = candidates.select(S1).distinct().withColumn("_has", F.lit(1))
    j = j.join(full, S1, "left")
    reason = (
        F.when(F.col("a.country") != F.col("b.country"), "country_mismatch").when(F.col("a.far") != F.col("b.far"), "cross_script").when(shared == 0, "no_shared_word")
        .when((F.col("a.addr") == "") | (F.col("b.addr") == ""), "empty_address").when(F.col("_has").isNotNull(), "crowded_out").otherwise("unreachable")
    )
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that a or b has, each once. A join: Spark may zip the sides of a union that it takes for partitioned alike."""
    return a.distinct().join(b.distinct(), PAIR, "outer")


def channel_ablation(universe: DataFrame, truth: DataFrame, base: DataFrame, channels: dict[str, DataFrame], k: int, unions: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """For each channel, and for each union of channels named in `unions`: which share of the base's misses it finds, the union's ceiling, and candidates added an S1."""
    missed = misses(truth, base.where(F.col("rank") <= k))
    cut = base.where(F.col("rank") <= k).select(*PAIR)
    total = missed.agg(F.count("*").alias("n_missed"))
    each = {name: c.where(F.col("rank") <= k).select(*PAIR) for name, c in channels.items()}
    each |= {" + ".join(names): reduce(either, [each[n] for n in names]) for names in unions}
    out = None
    for name, own in each.items():
        found = missed.join(own, PAIR, "left_semi").agg(F.count("*").alias("recovered"))
        added = own.distinct().join(cut, PAIR, "left_anti").agg(F.count("*").alias("added"))
        hits = hits_at(universe, truth, either(cut, own).withColumn("rank", F.lit(1)), [k])
        top = hits.agg(F.round(F.avg(ceiling()), 6).alias("ceiling_f05"), F.count("*").alias("n"))
        row = total.join(F.broadcast(found)).join(F.broadcast(added)).join(F.broadcast(top))  # one row each
        row = row.select(F.lit(name).alias("channel"), "n_missed", "recovered", F.round(F.coalesce(F.try_divide("recovered", "n_missed"), F.lit(0.0)), 6).alias("recovered_share"), "ceiling_f05", F.round(F.col("added") / F.col("n"), 6).alias("added_per_s1"))
        out = row if out is None else out.unionByName(row)
    return out
