"""Quality rules: exact base counts, and a log-likelihood ratio of hashed n-grams against the raw corpus.

Byte n-grams of every text are hashed into BUCKETS counters, once for the raw corpus (all documents) and once for a
trusted target (documents that the labels call good). A text's score is the mean over its n-grams of
log(p_target / p_raw), the mean makes long and short texts comparable. Both multinomials are smoothed by comparing the
target's count with the count that the raw corpus lets expect, each plus SMOOTH: a few unseen n-grams weigh little, and a
small target cannot reject much. Every document is kept or rejected by comparing its score with one threshold, so equal
texts always share a verdict.

The target may be a bounded sample of the labelled rows: TRUSTED_ROWS, those with the smallest hashes. Raw counts
cover all documents. Counters are BUCKETS numbers whatever the input; nothing else reaches the driver.
Defined cases: a null text is empty; texts under GRAM bytes have score 0; empty tables give empty results; with no
trusted rows every score is 0 and the base rules alone decide; rows without doc_id are never trusted; repeated rows are judged
each, and count as often as they come; a very long text is judged whole, with about 40 bytes of numbers a byte; equal texts
have equal verdicts; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_size, table

GRAM, BUCKETS, SMOOTH, THRESHOLD, TRUSTED_ROWS = 4, 1 << 17, 4.0, -0.3, 20_000
BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def covered(hit: np.ndarray, width: int) -> int:
    """How many positions the windows of this width that begin at the hits cover."""
    at = np.flatnonzero(hit)
    return int(np.minimum(np.diff(at), width).sum()) + width if len(at) else 0


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that occur twice or more. Windows are told apart by their words' numbers:
    pairs of numbers get numbers again, three times for a width of 8, so there are no collisions."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    sums = np.lib.stride_tricks.sliding_window_view((ids.astype(np.uint64) + np.uint64(1)) * _MIX, width)
    mixed = (sums * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(0xD1B54A32D192ED03))).sum(axis=1)
    if len(np.unique(mixed)) == len(mixed):  # no two sums agree, so no two windows do
        return 0
    step = 1
    while step < width:
        _, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        step *= 2
    return covered(np.bincount(ids)[ids] > 1, width)


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() parts at BLANK exactly."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def grams(raw: bytes) -> np.ndarray:
    """The bucket of each GRAM bytes."""
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    x = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), GRAM)
    key = np.ascontiguousarray(x).view("<u4").ravel().astype(np.uint64)
    return ((key * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def raws(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode()


def counters(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """[2, BUCKETS]: n-gram counts of all documents, and of the trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            ids = b.column(0)
            goods = (np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for some in by_size(zip(goods, raws(b.column(1)), strict=True), lambda x: len(x[1]), 1 << 20):
                for k, chosen in ((0, some), (1, [x for x in some if x[0]])):
                    if chosen:
                        total[k] += np.bincount(np.concatenate([grams(raw) for _, raw in chosen]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "good"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket long, raw long, good long")
    got = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, BUCKETS))
    at = got.column("bucket").to_numpy()
    out[0, at], out[1, at] = got.column("raw").to_numpy(), got.column("good").to_numpy()
    return out


def weights(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(p_target / p_raw) by bucket; zeros without trusted rows."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
    raw, good = counters(docs, np.array([r[0] for r in ids.collect()], np.int64))
    if not good.sum():
        return np.zeros(BUCKETS, np.float32)
    return np.log((good + SMOOTH) / (good.sum() * raw / raw.sum() + SMOOTH)).astype(np.float32)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row a document: base counts, llr and verdict."""
    w = docs.sparkSession.sparkContext.broadcast(weights(docs, labels, trusted_rows))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = w.value
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = (text := t.as_py() or "").encode()
                n, *rest = base_counts(text, raw)
                g = grams(raw)
                llr = float(table[g].sum(dtype=np.float64) / len(g)) if len(g) else 0.0
                failed = n < MIN_WORDS or 100 * rest[-1] > MAX_REPEAT_PERCENT * n
                rows.append((n, *rest, failed, llr, not failed and llr >= threshold))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The documents that judge() keeps, with all their columns. Whole rows pass through Python, as an executor that sends
    texts alone holds their rows until the verdicts are back."""
    w = docs.sparkSession.sparkContext.broadcast(weights(docs, labels, trusted_rows))

    def verdict(raw: bytes) -> bool:
        words = raw.split()
        if len(words) < MIN_WORDS or 100 * repeat_words(words) > MAX_REPEAT_PERCENT * len(words):
            return False
        g = grams(raw)
        return (float(w.value[g].sum(dtype=np.float64) / len(g)) if len(g) else 0.0) >= threshold

    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([verdict(r) for r in raws(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
