"""Substring dedup by repeated-phrase automata.

A window is WIDTH consecutive words of one document. Windows that start in two documents are found by 128-bit hashes
over hashed words: first by their anchors, then by segments (runs of windows with one anchor), of which most are the
same wherever their anchor is, and only where segments of an anchor differ window by window. What two documents share is
a recurring phrase, with the smallest doc_id that has it. Every block of documents gets the recurring phrases that one
of its own documents loses. Its documents are parted into shards of about SHARD bytes; a shard reads its phrases' words
where they stand first, compiles them into an Aho-Corasick automaton (pyahocorasick) over words written as two letters
each, and streams all of its documents through it, which locates every occurrence; one that does not begin with a word's
first letter is none. A segment that is the same wherever its anchor is makes one pattern. A word is removed if an
occurrence that covers it has a smaller doc_id than its document. A phrase that a third of all documents share costs
each shard one pattern.

Words are found and hashed in numpy over the bytes of many texts at once: a word's hash is the difference of two sums of
its bytes' numbers times powers of an odd number, and a window's that of its words' hashes. Words over LONG bytes, which
could be made to collide, are hashed by xxhash.

Defined cases: a null text has no words; texts under WIDTH words lose none; rows that repeat a doc_id are one document
and do not remove each other; rows without doc_id neither lose nor take anything; an empty table gives an empty result;
equal texts lose all but the smallest doc_id's words; a very long text is a slice of its own, hashed piece by piece, with
about 40 bytes of numbers a word; no columns but doc_id and text are read, and those that without_phrases() passes through
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import blocks, discard, table
from tessella.llm.recurring import Got, Question, Sent, between, dealt, groups, low, mix, numbers, of_group, per_block, raws_of, round_, runs_of, shared_anchors, slices, sliding_min, table_of, within

WIDTH, GRAM, SHARD, PIECE, LONG = 13, 5, 1 << 19, 1 << 18, 255
_BLANK = np.zeros(256, np.int8)
_BLANK[[9, 10, 11, 12, 13, 32]] = 1
_NUMBER = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPAN = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("block", "<i4")])
CROWD = np.dtype([("anchor", "<i8"), ("least", "<i8"), ("largest", "<i8"), ("block", "<i4")])
PHRASE = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("first", "<i8")])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverses modulo 2 ** 64, for i up to n; remembered."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(n + n // 2 + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... numbers times their powers."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0][: len(x)], out=out[1:])
    return out


class Words:
    """Where the words of some texts lie, how many each text has, and 128 bits a word."""

    def __init__(self, raws: list[bytes]):
        self.flat = b"\n".join(raws)
        x = np.frombuffer(self.flat, np.uint8)
        edge = np.diff(np.r_[np.int8(1), _BLANK[x], np.int8(1)])
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        self.n = np.diff(np.searchsorted(self.starts, at))
        self.hashes = np.empty((2, len(self.starts)), np.uint64)
        lo = 0
        while lo < len(self.starts):
            a = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, a + PIECE, "right")))
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            if e[-1] <= PIECE:
                back = powers(PIECE)[1][s]
                for k in (0, 1):
                    total = sums(_NUMBER[k][x[a : a + e[-1]]])
                    self.hashes[k, lo:hi] = mix((total[e] - total[s]) * back)
            lo = hi
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            self.hashes[:, i] = np.frombuffer(xxhash.xxh3_128_digest(self.flat[self.starts[i] : self.ends[i]]), "<u8")

    def some(self, a: int, b: int) -> list[bytes]:
        return self.flat[self.starts[a] : self.ends[b - 1]].split() if a < b else []


def windows(total: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive numbers, of which `total` has the sums()."""
    n = len(total) - width
    return mix((total[width:] - total[:n]) * powers(n)[1][:n]) if n > 0 else total[:0]


def anchors(total: np.ndarray) -> np.ndarray:
    return sliding_min(windows(total, GRAM), WIDTH - GRAM + 1)


def find(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(raws)
    a = anchors(sums(w.hashes[0]))
    starts, _, text = runs_of(a, w.n, WIDTH)
    return text, a[starts]


class Runs:
    """The runs of windows of some texts and their windows' hashes; with some: of known anchors alone."""

    def __init__(self, words: Words, some: np.ndarray | None = None):
        one, two = map(sums, words.hashes)
        a = anchors(one)
        self.one, self.two = windows(one, WIDTH), windows(two, WIDTH)
        self.starts, self.stops, self.text = runs_of(a, words.n, WIDTH)
        self.anchor = low(a[self.starts])
        if some is not None:
            keep = within(self.anchor, some)
            self.starts, self.stops, self.text, self.anchor = (x[keep] for x in (self.starts, self.stops, self.text, self.anchor))
        self.n = self.stops - self.starts

    def each(self) -> np.ndarray:
        """The windows of all runs."""
        return np.repeat(self.starts - (np.cumsum(self.n) - self.n), self.n) + np.arange(self.n.sum())

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each run, over its windows' hashes and their places in the run."""
        where, first = self.each(), np.cumsum(self.n) - self.n
        place = mix((where - np.repeat(self.starts, self.n)).astype(np.uint64) + np.uint64(77))
        return tuple(np.add.reduceat(mix(x[where] ^ place), first).view(np.int64) if len(first) else np.zeros(0, np.int64) for x in (self.one, self.two))


def gathered(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n


def spans(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, block: int) -> np.ndarray:
    """Each different hash once, with the smallest and the largest doc_id that has it."""
    o, first = groups(h1, h2)
    least, largest = (f.reduceat(doc[o], first) if len(first) else doc for f in (np.minimum, np.maximum))
    return table_of({"h1": h1[o][first], "h2": h2[o][first], "lo": least, "hi": largest, "block": block}, SPAN)


def send_segments(block: int, ids: list[int], raws: list[bytes], got: Got) -> Sent:
    """Segments with a shared anchor by hash, and for each such anchor the smallest and the largest hash."""
    some, parts = np.sort(numbers(got, "shared")), []
    for lo, hi in slices(raws) if len(some) else ():
        r = Runs(Words(raws[lo:hi]), some)
        parts.append((*r.segments(), r.anchor, np.array(ids[lo:hi], np.int64)[r.text]))
    h1, h2, anchor, doc = gathered(parts, 4)
    o, first = groups(anchor)
    least, largest = (f.reduceat(h1[o], first) if len(first) else h1 for f in (np.minimum, np.maximum))
    crowd = table_of({"anchor": anchor[o][first], "least": least, "largest": largest, "block": block}, CROWD)
    rows = spans(h1, h2, doc, block)
    return {"whole": (rows, rows["h1"]), "crowded": (crowd, crowd["anchor"])}


def send_windows(block: int, ids: list[int], raws: list[bytes], got: Got) -> Sent:
    """The windows of segments whose anchor has different segments."""
    some, parts = np.sort(numbers(got, "crowded")), []
    for lo, hi in slices(raws) if len(some) else ():
        r = Runs(Words(raws[lo:hi]), some)
        at = r.each()
        parts.append((r.one[at].view(np.int64), r.two[at].view(np.int64), np.repeat(np.array(ids[lo:hi], np.int64)[r.text], r.n)))
    rows = spans(*gathered(parts, 3), block)
    return {"single": (rows, rows["h1"])}


def recurring(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that two documents have, with the first, for each block that has a later document with it."""
    o, first = groups(rows["h1"], rows["h2"])
    rows = rows[o]
    least = of_group(np.minimum, rows["lo"], first)
    late = rows["hi"] > least
    return rows["block"][late], table_of({"h1": rows["h1"][late], "h2": rows["h2"][late], "first": least[late]}, PHRASE)


def different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that have different segments, for each block that has them."""
    o, first = groups(rows["anchor"])
    rows = rows[o]
    keep = of_group(np.minimum, rows["least"], first) != of_group(np.maximum, rows["largest"], first)
    return rows["block"][keep], np.ascontiguousarray(rows["anchor"][keep])


class Automaton:
    """Phrases with the smallest doc_id of each. Nodes are searched one child after the other, so the alphabet is
    small: a word is its number in two letters, and words that no phrase has are all the same."""

    OTHER = "\x01\x01"

    def __init__(self, phrases: list[tuple[list[bytes], int]]) -> None:
        seen = dict.fromkeys(chain.from_iterable(p for p, _ in phrases))
        base = 1 + int(len(seen) ** 0.5)
        self.codes = {w: chr(2 + n // base) + chr(2 + n % base) for n, w in enumerate(seen)}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, first in phrases:
            self.trie.add_word("".join(map(self.codes.__getitem__, p)), (first, len(p)))
        if phrases:
            self.trie.make_automaton()

    def covered(self, words: list[bytes], doc_id: int) -> np.ndarray | None:
        """Which words phrases cover that a smaller doc_id has; None: no word."""
        if not len(self.trie) or len(words) < WIDTH:
            return None
        get = self.codes.get
        text = "".join([get(w, self.OTHER) for w in words])
        spans = [((end + 1) // 2 - n, (end + 1) // 2) for end, (first, n) in self.trie.iter(text) if first < doc_id and end % 2]
        return between(*map(list, zip(*spans, strict=True)), len(words)) if spans else None


def known(phrases: np.ndarray) -> tuple[dict[tuple[int, int], int], np.ndarray]:
    """The smallest doc_id of each phrase, and their first hashes in order."""
    return dict(zip(zip(phrases["h1"].tolist(), phrases["h2"].tolist(), strict=True), phrases["first"].tolist(), strict=True)), np.sort(phrases["h1"])


def compile_shard(words: Words, whole: tuple[dict, np.ndarray], single: tuple[dict, np.ndarray]) -> Automaton:
    """The automaton of some texts: the recurring segments and windows they have, each read where it stands first."""
    out: dict[tuple, tuple[list[bytes], int]] = {}
    if whole[0] or single[0]:
        r = Runs(words)
        g1, g2 = r.segments()
        at = np.flatnonzero(within(g1, whole[1]))
        for s, e, *g in zip(r.starts[at].tolist(), r.stops[at].tolist(), g1[at].tolist(), g2[at].tolist(), strict=True):
            if (first := whole[0].get(g := (*g,))) is not None and g not in out:
                out[g] = words.some(s, e + WIDTH - 1), first
        at = r.each()
        at = at[within(r.one[at].view(np.int64), single[1])]
        for i, *g in zip(at.tolist(), r.one[at].view(np.int64).tolist(), r.two[at].view(np.int64).tolist(), strict=True):
            if (first := single[0].get(g := (*g,))) is not None and (0, *g) not in out:
                out[0, *g] = words.some(i, i + WIDTH), first
    return Automaton(list(out.values()))


def kept_words(raws: list[bytes], ids: list[int | None], got: Got) -> Iterator[tuple[list[bytes], list[bytes] | None]]:
    """The words of each text of a block, and what is left of them; None where nothing goes."""
    whole, single = (known(numbers(got, kind, PHRASE)) for kind in ("whole", "single"))
    for lo, hi in slices(raws, SHARD):
        shard = compile_shard(Words([r for r, d in zip(raws[lo:hi], ids[lo:hi], strict=True) if d is not None]), whole, single)
        for raw, d in zip(raws[lo:hi], ids[lo:hi], strict=True):
            words = raw.split()
            mask = None if d is None else shard.covered(words, d)
            yield words, None if mask is None else [x for x, m in zip(words, mask.tolist(), strict=True) if not m]


def found(packed: DataFrame, parts: int) -> DataFrame:
    """The recurring phrases of each block: answers of the kinds `whole` and `single`."""
    shared = shared_anchors(packed, find, parts)
    segments = round_(packed, shared, send_segments, parts, whole=Question(SPAN, recurring), crowded=Question(CROWD, different))
    discard(shared)
    single = round_(packed, segments.where("kind = 'crowded'"), send_windows, parts, single=Question(SPAN, recurring))
    return segments.where("kind = 'whole'").unionByName(single)


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256, of the words that are left, joined by one blank."""

    def run(_: int, rows: pa.Table, got: Got) -> Iterator[pa.RecordBatch]:
        ids, out = rows.column("doc_id").to_pylist(), []
        for words, kept in kept_words(raws_of(rows.column("text")), ids, got):
            left = words if kept is None else kept
            out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        n, gone, digests = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    packed = dealt(docs, n := blocks(docs), ["doc_id", "text"])
    return per_block(packed, found(packed, n), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_phrases(docs: DataFrame) -> DataFrame:
    """docs with all their columns; a text that loses words becomes the words that are left, joined by one blank, and
    its n_chars, if there is such a column, follows. Other texts stay as they are."""
    columns = docs.columns

    def run(_: int, rows: pa.Table, got: Got) -> Iterator[pa.RecordBatch]:
        texts = rows.column("text").to_pylist()
        kept = [k for _, k in kept_words(raws_of(rows.column("text")), rows.column("doc_id").to_pylist(), got)]
        texts = [t if k is None else b" ".join(k).decode() for t, k in zip(texts, kept, strict=True)]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            before = rows.column("n_chars").to_pylist()
            new["n_chars"] = pa.array([n if k is None else len(t) for n, k, t in zip(before, kept, texts, strict=True)], rows.schema.field("n_chars").type)
        yield from pa.table({c: new.get(c, rows.column(c)) for c in columns}).combine_chunks().to_batches()

    packed = dealt(docs, n := blocks(docs), columns)
    return per_block(packed, found(packed, n), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
