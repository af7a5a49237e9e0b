"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Tokens are words (ASCII letters in lower case) and one end a text. Texts are dealt to blocks by doc_id and text and coded
once: a block keeps its different words as 96-bit hashes and its texts as numbers of these. Counts of all training tokens
are whole: blocks send theirs, dealt by hash, and get the sums of their own words back (no key costs a block more than one
number). The model predicts OUTPUTS symbols from the two tokens before: the most frequent words, and CLASSES classes of
all other words, by their last two bytes; a word of a class then has its smoothed share of that class's counts, so that the
probabilities of seen words and one unseen word a class add up to 1. A hidden vector is the sum of two context
vectors, each scaled by its position's weights; its products with all output vectors plus biases go through a softmax
(logZ is computed once for each different context of a block).

Training: every block runs Adagrad over all positions of its training documents from common parameters, with NOISE shared
samples a minibatch; a round takes the blocks whose number modulo ROUNDS is the round's, and averages their parameters
with the positions as weights. Together the rounds take every position once. Blocks, their order and their random numbers
follow from the table alone, so that scores do not depend on files, partitions or executors, but for rounding.

Defined cases: a null text is empty and has one token, the end; a null doc_id is held out, as '' would be; no training
tokens at all give N = V = 0 and a uniform model; repeated rows each get a row; a very long text makes its block larger, at
about 100 bytes of numbers a token; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, cut, discard, received, ship, table
from tessella.llm.phrase_dedup import Words
from tessella.llm.recurring import groups, mix, parcels, raws_of, slices

OUTPUTS, CLASSES, DIM = 1024, 128, 16
NOISE, BATCH, RATE, ROUNDS, SEED = 48, 512, 0.15, 4, 3
ADD, LEAST_BLOCKS = 0.1, 60
WORDS = OUTPUTS - CLASSES
#: A block's word: its hash, its count in the block's training texts, and its class.
WORD = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("c", "<u4"), ("klass", "u1")])
TOP = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("c", "<i8"), ("klass", "u1")])
END = (np.uint64(0), np.uint32(0))  # the end's hash


@cache
def classes() -> np.ndarray:
    """The class of each pair of last bytes, then of each single byte."""
    two = (bytes((a, b)) for a in range(256) for b in range(256))
    return np.array([zlib.crc32(x) % CLASSES for x in (*two, *(bytes((a,)) for a in range(256)))], np.uint8)


def held_out(folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def coded(raws: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of some texts (as WORD), the number of each token in them, and tokens of each text."""
    h1, h2, klass, ns = [], [], [], []
    for lo, hi in slices(raws):
        w = Words([r.lower() for r in raws[lo:hi]])
        x = np.frombuffer(w.flat, np.uint8)
        last, one = x[w.ends - 1].astype(np.int64), w.ends - w.starts == 1
        h1.append(w.hashes[0])
        h2.append((w.hashes[1] >> np.uint64(32)).astype(np.uint32))
        klass.append(classes()[np.where(one, 65536 + last, x[w.ends - 2].astype(np.int64) * 256 + last)])
        ns.append(w.n)
    one, two, kind = (np.concatenate(x) for x in (h1, h2, klass))
    n = np.concatenate(ns)
    at = np.cumsum(n)
    one, two, kind = np.insert(one, at, END[0]), np.insert(two, at, END[1]), np.insert(kind, at, 0)
    o, first = groups(one)
    if (two[o][1:] != two[o][:-1])[one[o][1:] == one[o][:-1]].any():  # 64 bits were not enough
        o, first = groups(one, two)
    codes = np.empty(len(one), np.int32)
    codes[o] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(one)]))
    words = np.empty(len(first), WORD)
    words["h1"], words["h2"], words["klass"] = one[o][first], two[o][first], kind[o][first]
    words["c"] = np.bincount(codes[np.repeat(~held, n + 1)], minlength=len(first))
    return words, codes, n + 1


def code_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text, held_out) as a written table with a row a block, and how many blocks there may be."""
    n = blocks(docs, least=LEAST_BLOCKS)
    schema = "block int, doc_id array<long>, held array<boolean>, n array<long>, codes binary, words binary"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
        held = rows.column("held_out").to_numpy()
        words, codes, sizes = coded(raws_of(rows.column("text")), held)
        cols = [pa.array([rows.column("block")[0].as_py()], pa.int32()), *[pa.array([x], pa.list_(k)) for x, k in ((rows.column("doc_id").to_pylist(), pa.int64()), (held, pa.bool_()), (sizes, pa.int64()))]]
        data = [pa.array([x], pa.binary()) for x in (zstandard.compress(codes.tobytes(), 1), words.tobytes())]
        return pa.table([*cols, *data], names=[x.split()[0] for x in schema.split(", ")])

    own = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    return cut(own.groupBy("block").applyInArrow(run, schema), "coded"), n


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words["h1"]) >> np.uint64(33)).astype(np.int64) % parts


class Vocabulary:
    """What every task needs of the counts: the most frequent words, and sums by class."""

    def __init__(self, sums: list[tuple]):
        """sums: (n, v, class counts, class words, top words) of disjoint parts of the words."""
        self.n, self.v = (sum(int(x[k]) for x in sums) for k in (0, 1))
        self.class_n, class_v = (sum((x[k] for x in sums), np.zeros(CLASSES)) for k in (2, 3))
        top = best(np.concatenate([np.zeros(0, TOP), *(x[4] for x in sums)]))
        for w in top:
            self.class_n[w["klass"]] -= w["c"]
            class_v[w["klass"]] -= 1
        self.class_z = self.class_n + ADD * (class_v + 1)
        self.z = self.n + ADD * (self.v + 1)
        share = np.full(OUTPUTS, ADD)
        share[: len(top)] += top["c"]
        share[WORDS:] += self.class_n
        self.log_q = np.log(share / share.sum()).astype(np.float32)
        self.rank = np.argsort(top["h1"])
        self.top = top[self.rank]

    def outputs(self, words: np.ndarray) -> np.ndarray:
        """The symbol that stands for each word."""
        out = WORDS + words["klass"].astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top["h1"], words["h1"]), len(self.top) - 1)
            same = (self.top["h1"][at] == words["h1"]) & (self.top["h2"][at] == words["h2"])
            out[same] = self.rank[at[same]]
        return out


def best(words: np.ndarray) -> np.ndarray:
    """The most frequent words; ties go by hash."""
    return words[np.lexsort((words["h2"], words["h1"], -words["c"]))[:WORDS]]


def summary(words: np.ndarray) -> tuple:
    seen = words[words["c"] > 0]
    return int(seen["c"].sum()), len(seen), np.bincount(seen["klass"], seen["c"], CLASSES), np.bincount(seen["klass"], minlength=CLASSES).astype(float), best(seen)


def counted(coded_: DataFrame, parts: int) -> tuple[DataFrame, Vocabulary]:
    """(block, part, data): the counts, over all training texts, of the words that a block sent to a part; and the
    vocabulary."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = np.frombuffer(raw.as_py(), WORD)
                out = list(parcels(part_of(words, parts), words))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["part", "block", "data"])

    def answer(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), WORD) for x in rows.column("data")]
        words = np.concatenate(own)
        o, first = groups(words["h1"], words["h2"])
        sums = np.add.reduceat(words["c"][o].astype(np.int64), first)
        each = np.empty(len(words), np.int64)
        each[o] = np.repeat(sums, np.diff(np.r_[first, len(words)]))
        top = np.empty(len(first), TOP)
        for c in ("h1", "h2", "klass"):
            top[c] = words[c][o][first]
        top["c"] = sums
        back = [x.tobytes() for x in np.split(each, np.cumsum([len(x) for x in own])[:-1])]
        part = rows.column("part")[0].as_py()
        return pa.table({"block": pa.array([*rows.column("block").to_pylist(), -1], pa.int32()), "part": pa.array([part] * (len(back) + 1), pa.int32()), "data": pa.array([*back, pickle.dumps(summary(top))], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple | None = None
        for b in batches:
            for x in b.column(0):
                new = pickle.loads(x.as_py())
                got = new if got is None else (*(p + q for p, q in zip(got[:4], new[:4], strict=True)), best(np.concatenate([got[4], new[4]])))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["data"])

    sent = coded_.select("block", "words").mapInArrow(send, "part int, block int, data binary")
    answers = cut(sent.groupBy("part").applyInArrow(answer, "block int, part int, data binary"), "counts")
    sums = answers.where("block = -1").select("data").repartition(8).mapInArrow(merge, "data binary").collect()  # 8 rows
    return answers, Vocabulary([pickle.loads(bytes(r[0])) for r in sums])


def numbered(coded_: DataFrame, answers: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """Blocks with symbols for words, and each text's sums that need no model; a written table."""
    shared = ship(coded_.sparkSession, vocabulary)
    schema = "block int, doc_id array<long>, held array<boolean>, n array<long>, known array<long>, base array<double>, inside array<double>, symbols binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = received(shared)
        for b in batches:
            for i in range(len(b)):
                n = np.array(b.column(3)[i].as_py())
                codes = np.frombuffer(zstandard.decompress(b.column(4)[i].as_py()), np.int32)
                words = np.frombuffer(b.column(5)[i].as_py(), WORD)
                c = np.empty(len(words), np.int64)
                got = sorted((x["part"], x["data"]) for x in b.column(6)[i].as_py())
                c[np.argsort(part_of(words, parts), kind="stable")] = np.frombuffer(b"".join(d for _, d in got), np.int64)
                out = voc.outputs(words)
                inside = np.where(out < WORDS, 0.0, np.log10((c + ADD) / voc.class_z[words["klass"]]))
                at = np.r_[0, np.cumsum(n)[:-1]]
                sums = [np.add.reduceat(x[codes], at) for x in ((c > 0).astype(np.int64), np.log10((c + ADD) / voc.z), inside)]
                lists = [pa.array([x], pa.list_(k)) for x, k in zip(sums, (pa.int64(), pa.float64(), pa.float64()), strict=True)]
                symbols = zstandard.compress(out.astype("<u2")[codes].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*[b.column(k)[i : i + 1] for k in range(4)], *lists, pa.array([symbols], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    own = answers.where("block >= 0").groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("part", "data")).alias("got"))
    both = coded_.join(own, F.col("block") == F.col("_block")).drop("_block")
    return cut(both.mapInArrow(run, schema), "symbols")


class Model:
    """Context vectors r (one more row for the start of a text), output vectors q, position weights p, biases b."""

    def __init__(self, log_q: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.r = rng.normal(0, 0.1, (OUTPUTS + 1, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (OUTPUTS, DIM)).astype(np.float32)
        self.p = np.ones((2, DIM), np.float32)
        self.b = log_q.copy()

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.p, self.b)])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name in ("r", "q", "p", "b"):
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return self.r[contexts[:, 0]] * self.p[0] + self.r[contexts[:, 1]] * self.p[1]

    def log_prob(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of normalised probabilities."""
        key = contexts[:, 0] * (OUTPUTS + 1) + contexts[:, 1]
        each, which = np.unique(key, return_inverse=True)
        h = self.hidden(np.stack([each // (OUTPUTS + 1), each % (OUTPUTS + 1)], 1))
        log_z = np.empty(len(each), np.float32)
        ones, q = np.ones(OUTPUTS, np.float32), np.c_[self.q, self.b].T.copy()
        for i in range(0, len(each), 512):
            part = np.c_[h[i : i + 512], np.ones(len(h[i : i + 512]), np.float32)]
            # One bound for all symbols of a context, in place of their maximum, keeps exp() in range.
            bound = np.sqrt((part[:, :-1] ** 2).sum(1) * (self.q**2).sum(1).max()) + self.b.max() - 60
            s = part @ q
            s -= np.maximum(bound, 0)[:, None]
            np.exp(s, out=s)
            log_z[i : i + 512] = np.log(s @ ones) + np.maximum(bound, 0)
        out = np.empty(len(targets), np.float32)
        for i in range(0, len(targets), 1 << 16):
            w, t = which[i : i + (1 << 16)], targets[i : i + (1 << 16)]
            out[i : i + (1 << 16)] = (h[w] * self.q[t]).sum(1) + self.b[t] - log_z[w]
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, log_q: np.ndarray, state: list[np.ndarray], rng: np.random.Generator) -> None:
        """Adagrad over minibatches; the gradient of log sigmoid(s(target) - log(k q)) and of the noise's counterpart."""
        noise_p = np.exp(log_q.astype(np.float64))
        noise_p /= noise_p.sum()
        shift = log_q + np.float32(np.log(NOISE))
        for i in range(0, len(targets), BATCH):
            c, t = contexts[i : i + BATCH], targets[i : i + BATCH]
            n = rng.choice(OUTPUTS, NOISE, p=noise_p)
            h = self.hidden(c)
            qt, qn = self.q[t], self.q[n]
            pos = -1 / (1 + np.exp(np.clip((h * qt).sum(1) + self.b[t] - shift[t], -30, 30)))
            neg = h @ -qn.T
            neg += shift[n] - self.b[n]
            np.exp(np.minimum(neg, 60, out=neg), out=neg)
            neg += 1
            np.reciprocal(neg, out=neg)
            dh = pos[:, None] * qt + neg @ qn
            grads = [np.zeros_like(x) for x in (self.r, self.q, self.p, self.b)]
            grads[0] += summed(np.concatenate([c[:, 0], c[:, 1]]), np.concatenate([dh * self.p[0], dh * self.p[1]]), len(self.r))
            grads[1] += summed(np.concatenate([t, n]), np.concatenate([pos[:, None] * h, neg.T @ h]), len(self.q))
            grads[2][0], grads[2][1] = (dh * self.r[c[:, 0]]).sum(0), (dh * self.r[c[:, 1]]).sum(0)
            np.add.at(grads[3], t, pos)
            np.add.at(grads[3], n, neg.sum(0))
            for x, g, a in zip((self.r, self.q, self.p, self.b), grads, state, strict=True):
                a += g * g
                x -= RATE * g / np.sqrt(a + 1e-6)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of n rows each the sum of the rows that are for it; a count over numbers of cells is faster than np.add.at."""
    cells = (at[:, None] * rows.shape[1] + np.arange(rows.shape[1])).ravel()
    return np.bincount(cells, rows.ravel(), n * rows.shape[1]).reshape(n, rows.shape[1])


def windows(symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All contexts [tokens, 2] (nearest first) and targets of texts of n tokens each; a text begins after two starts."""
    flat = np.insert(symbols.astype(np.int64), np.repeat(np.cumsum(n) - n, 2), OUTPUTS)
    at = np.flatnonzero(flat != OUTPUTS)
    return np.stack([flat[at - 1], flat[at - 2]], 1), flat[at]


def fit(symbols: DataFrame, log_q: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of the training documents of all blocks of numbered()."""
    spark, model = symbols.sparkSession, Model(log_q)
    for k in range(rounds):
        flat = spark.sparkContext.broadcast((model.flat(), log_q))  # 34 thousand numbers
        shared = ship(spark, Model)

        def run(batches: Iterator[pa.RecordBatch], flat=flat, shared=shared) -> Iterator[pa.RecordBatch]:
            kind, (start, log_q) = received(shared), flat.value
            total, positions = np.zeros(len(start)), 0
            for b in batches:
                for block, held, n, data in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                    use, n = ~np.array(held.as_py()), np.array(n.as_py())
                    c, t = windows(np.frombuffer(zstandard.decompress(data.as_py()), "<u2")[np.repeat(use, n)], n[use])
                    own, rng = kind(log_q).load(start), np.random.default_rng([SEED, block])
                    order = rng.permutation(len(t))
                    own.train(c[order], t[order], log_q, [np.full(x.shape, 1.0, np.float32) for x in (own.r, own.q, own.p, own.b)], rng)
                    total += own.flat().astype(np.float64) * len(t)
                    positions += len(t)
            if positions:
                yield pa.RecordBatch.from_arrays([pa.array([positions]), pa.array([total.tobytes()])], names=["n", "sum"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for b in batches:
                n += sum(b.column(0).to_pylist())
                total = sum((np.frombuffer(x.as_py()) for x in b.column(1)), total)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "sum"])

        chosen = symbols.where(F.col("block") % rounds == k).select("block", "held", "n", "symbols")
        parts = chosen.mapInArrow(run, "n long, sum binary").repartition(8).mapInArrow(add, "n long, sum binary").collect()
        if parts:
            model.load(sum(np.frombuffer(bytes(r[1])) for r in parts) / sum(r[0] for r in parts))
    return model


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row a document: the contract's columns."""
    own = docs.select("doc_id", "text", held_out(folds).alias("held_out"))
    coded_, parts = code_blocks(own)
    answers, vocabulary = counted(coded_, parts)
    symbols = numbered(coded_, answers, vocabulary, parts)
    discard(coded_, answers)
    shared = ship(docs.sparkSession, fit(symbols, vocabulary.log_q))
    train_tokens = vocabulary.n
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        for b in batches:
            for i in range(len(b)):
                ids, held, n, known, base, inside = (b.column(k)[i].values for k in range(1, 7))
                sizes = n.to_numpy()
                c, t = windows(np.frombuffer(zstandard.decompress(b.column(7)[i].as_py()), "<u2"), sizes)
                p = np.add.reduceat(model.log_prob(c, t).astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]]) / np.log(10)
                yield pa.RecordBatch.from_arrays([ids, held, n, known, pa.array(np.full(len(sizes), train_tokens)), base, pa.array(p + inside.to_numpy())], names=[x.split()[0] for x in schema.split(", ")])

    return symbols.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
