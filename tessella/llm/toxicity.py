"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more?

One dictionary is trained on ordinary text, one on toxic text: the windows that come most often, the most frequent
last, where they are cheapest to refer to. The toxic one's training text is the windows whose stems toxic documents
have far more often than ordinary ones, since most of a toxic document reads like any other. A window (one word between
blanks) is compressed with either dictionary between a carrier and a trailer that both know (zstandard seeks no match in
a block's last bytes), so that what differs is the cost of the window itself; the difference of the two lengths is the
window's distance. A document's largest distances, how many exceed some steps, and its size are calibrated to a
probability by a logistic curve, fitted on labelled documents that no dictionary saw.

The library's own dictionary trainer gives weaker results (README), so content is chosen here and windows are one word.
Training uses at most PER_CLASS labelled rows a class, those with the smallest hashes; every document is scored whole.
Distances of words are remembered in a task, at most CACHE of them.
Defined cases: a null text is empty; a text without words has distances 0 and the score the curve gives them; labels
that are null are not used; equal texts have equal scores; a very long text is scored whole, window by window; an empty
table gives an empty result; without toxic or without ordinary training rows all scores are 0; repeated rows each get a
row; no columns but doc_id and text are read, whatever the others are called.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import received, ship, table

PER_CLASS, CACHE, SEED = 4_000, 400_000, 5
DICT_BYTES, STEM, MIN_SHARE, MIN_RATIO, TOP, STEPS = 4096, 6, 0.03, 4.0, 4, (2, 3, 5)
CARRIER, TRAILER = b"\x01carrier\x02\x01carrier\x02", b"\x03trailer\x04trailer\x05"


def fold(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def windows(raw: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in raw.split()]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(9, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Distances:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        if (d := self.known.get(window)) is None:
            block = CARRIER + window + TRAILER
            d = len(self.ordinary.compress(block)) - len(self.toxic.compress(block))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[window] = d
        return d

    def features(self, raw: bytes) -> list[float]:
        """The TOP largest distances, the size, and how many distances reach each of STEPS: number and share."""
        d = sorted(map(self.of, windows(raw)), reverse=True)
        top = [float(max(0, x)) for x in d[:TOP]]
        reach = [bisect_right(d, -k, key=lambda x: -x) for k in STEPS]
        return top + [0.0] * (TOP - len(top)) + [log1p(len(d))] + [4 * log1p(n) for n in reach] + [80 * n / (len(d) + 10) for n in reach]


def train_dictionary(samples: list[bytes]) -> bytes:
    """DICT_BYTES of the most frequent windows, the most frequent last, then carrier and trailer."""
    out = b""
    for w, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if len(out) + len(w) > DICT_BYTES:
            break
        out = w + out
    return out + CARRIER + b" " + TRAILER


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Windows by stem: at least MIN_SHARE of the toxic texts have it, and MIN_RATIO times as many as of the ordinary."""
    t, o = (Counter(s for x in texts for s in {w[:STEM] for w in x}) for texts in (toxic, ordinary))
    many = {s for s, c in t.items() if c >= max(5, MIN_SHARE * len(toxic)) and (c + 0.5) / (len(toxic) + 1) >= MIN_RATIO * (o[s] + 0.5) / (len(ordinary) + 1)}
    return [w for x in toxic for w in x if w[:STEM] in many]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, on scaled columns and a constant."""
    x = np.c_[x / 8, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def probability(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[features / 8, np.ones(len(features))] @ w, -30, 30)))


class Classifier:
    """Fitted on texts and their labels: three quarters for the dictionaries, one for the curve."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        rng = random.Random(SEED)
        rows = sorted(set(zip(texts, labels, strict=True)))
        rng.shuffle(rows)
        parts = [r for i, r in enumerate(rows) if i % 4], rows[::4]
        toxic, ordinary = ([windows(t) for t, y in parts[0] if y == k] for k in (1, 0))
        chosen, plain = telling(toxic, ordinary), [w for x in ordinary for w in x]
        self.dictionaries: tuple[bytes, bytes] | None = None
        if chosen and plain and len({y for _, y in parts[1]}) == 2:
            self.dictionaries = train_dictionary(plain), train_dictionary(chosen)
            d = Distances(*self.dictionaries)
            self.curve = fit_curve(np.array([d.features(t) for t, _ in parts[1]]), np.array([y for _, y in parts[1]], float))

    def scores(self, raws: list[bytes], distances: Distances | None) -> np.ndarray:
        return probability(np.array([distances.features(r) for r in raws]), self.curve) if distances and raws else np.zeros(len(raws))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[bytes], list[int]]:
    """At most per_class labelled rows of each class, with whole texts."""
    rows: list[tuple[bytes, int]] = []
    for k in (0, 1):
        ids = labels.where((F.col("toxic") == k) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # per_class ids
        rows += [((r.text or "").encode(), k) for r in found.select("text").collect()]
    return [t for t, _ in rows], [y for _, y in rows]


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = PER_CLASS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Labels of held-out documents are not looked at."""
    model = Classifier(*training_rows(docs, labels.where(fold(folds) != 0), per_class))
    shared = ship(docs.sparkSession, model)  # two dictionaries and a curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        d = Distances(*own.dictionaries) if own.dictionaries else None
        for b in batches:
            s = np.concatenate([own.scores([(x.as_py() or "").encode()], d) for x in b.column(2)]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold(folds) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
