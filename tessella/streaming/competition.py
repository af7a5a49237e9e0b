"""Competition statistics and scores as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.blocking import PAIR

S1, CAND = PAIR


def running_stats(pairs: DataFrame) -> DataFrame:
    """By record: best score, its S1 (ties: smallest id) and how many pairs; updates as pairs arrive, in bounded state."""
    order = F.struct(-F.col("score"), F.col(S1))
    return pairs.groupBy(CAND).agg(F.max("score").alias("best_score"), F.count("*").alias("n_s1"), F.min_by(F.col(S1), order).alias("best_s1"))


def score_stream(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and write it under its batch id; a batch that comes again after a failure overwrites
    itself, so each pair is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
