"""Suffix-array dedup: bytes in WIDTH-byte strings that start in a document with a smaller doc_id are removed.

Only stretches whose anchor (the smallest hash of GRAM bytes in a window) two documents have can repeat. These segments, at
most MOST windows long, are told apart by 128-bit hashes. Where an anchor has one segment alone, its smallest doc_id is
the answer for all its windows. All other segments go, as text, to shards by anchor. Of a shard, segments with a window
whose rolling hash is not unique are the collection, and each shard builds the Burrows-Wheeler transform and the common
prefixes of its whole collection column by column: a round inserts one more symbol of every segment, from the ends
backwards, at places that ranks in the last round's transform give, and common prefixes follow from minima over the last
round's. Each round reads the last round's arrays from one end to the other and writes new ones. They stay in memory, as
a shard is bounded. Neighbours in suffix order with WIDTH common bytes are equal windows; the smallest doc_id of such a run
is the window's.

An anchor that may have more than HEAVY different segments (one line in front of countless different ones) does not go to
one task: its windows are compared one by one, by their hashes, dealt over all parts.
Defined cases: a null text is empty; texts under WIDTH bytes lose none; rows that repeat a doc_id are one document and
do not remove each other; equal texts lose all but the smallest doc_id's bytes; rows without doc_id neither lose nor take
anything; an empty table gives an empty result; a very long text is a slice of its own, with about 60 bytes of numbers a
byte; no columns but doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import blocks, discard, table
from tessella.llm.recurring import Got, Question, Sent, between, dealt, groups, low, mix, numbers, of_group, per_block, raws_of, round_, runs_of, shared_anchors, slices, sliding_min, table_of, within

WIDTH, GRAM = 50, 20
MOST = WIDTH - GRAM + 1
LONGEST = MOST + WIDTH - 1
#: Segments of a shard, about; and of one anchor, at most.
SHARD, HEAVY = 3_000, 8_000
#: A byte that UTF-8 does not have stands before the first symbol of a text.
END = 255
#: What is known of an anchor's segments: one alone, some, or too many for one task.
ALONE, SOME, MANY = 0, 1, 2

_NUMBER = np.random.default_rng(8).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 16, b, np.uint64)]) for b in (_ODD, pow(_ODD, -1, 1 << 64)))

SPAN = np.dtype([("g1", "<i8"), ("g2", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("block", "<i4")])
CROWD = np.dtype([("anchor", "<i8"), ("least", "<i8"), ("largest", "<i8"), ("n", "<i8"), ("block", "<i4")])
ANCHORS = np.dtype([("anchor", "<i8"), ("kind", "<i4")])
TEXT = np.dtype([("anchor", "<i8"), ("g1", "<i8"), ("g2", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("block", "<i4"), ("size", "<i4"), ("segment", f"V{LONGEST}")])
FIRST = np.dtype([("g1", "<i8"), ("g2", "<i8"), ("first", "<i8")])
RUN = np.dtype([("g1", "<i8"), ("g2", "<i8"), ("at", "<i4"), ("n", "<i4"), ("first", "<i8")])


def anchors(raw: bytes) -> np.ndarray:
    """Of each window of a run of bytes, without regard to where texts end."""
    n = len(raw) - GRAM + 1
    if n < MOST:
        return np.zeros(0, np.uint64)
    at = lambda k, kind: np.ndarray((n,), kind, raw, k, (1,))
    h = at(0, "<u8") * np.uint64(0x9E3779B97F4A7C15)
    h ^= at(8, "<u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += at(16, "<u4") * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return sliding_min(h, MOST)


def find(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = anchors(b"".join(raws))
    starts, _, text = runs_of(a, np.array([len(r) for r in raws]), WIDTH)
    return text, a[starts]


def hashes(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span of bytes, none longer than half of 1 << 16, in order of their starts: sums of the bytes'
    numbers times powers of an odd number, and the lengths. The sums begin anew where they come to the end of the powers."""
    x = np.frombuffer(flat, np.uint8)
    out = np.empty((2, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + (1 << 15), "right")))
        b = int(ends[i:j].max())
        s, e = starts[i:j] - a, ends[i:j] - a
        for k in (0, 1):
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_NUMBER[k][x[a:b]] * _UP[: b - a], out=total[1:])
            out[k, i:j] = mix((total[e] - total[s]) * _DOWN[s] ^ (e - s).astype(np.uint64))
        i = j
    return out[0].view(np.int64), out[1].view(np.int64)


class Segments:
    """Runs of windows with one anchor in some texts: where they start and end (in bytes), and two hashes of each; with
    some: those of known anchors."""

    def __init__(self, raws: list[bytes], some: np.ndarray | None = None):
        self.flat = b"".join(raws)
        a = anchors(self.flat)
        starts, stops, text = runs_of(a, np.array([len(r) for r in raws]), WIDTH, MOST)
        anchor = low(a[starts])
        if some is not None:
            keep = within(anchor, some)
            starts, stops, text, anchor = starts[keep], stops[keep], text[keep], anchor[keep]
        self.starts, self.ends, self.text, self.anchor = starts, stops + WIDTH - 1, text, anchor
        self.g1, self.g2 = hashes(self.flat, self.starts, self.ends)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of chosen segments: their starts, texts and two hashes."""
        n = self.ends[chosen] - self.starts[chosen] - WIDTH + 1
        at = np.repeat(self.starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, np.repeat(self.text[chosen], n), *hashes(self.flat, at, at + WIDTH)


def spans(g1: np.ndarray, g2: np.ndarray, doc: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each different hash once, with the smallest and the largest doc_id that has it; and where each stands."""
    o, first = groups(g1, g2)
    least, largest = (f.reduceat(doc[o], first) if len(first) else doc for f in (np.minimum, np.maximum))
    at = o[first]
    return table_of({"g1": g1[at], "g2": g2[at], "lo": least, "hi": largest, "block": block}, SPAN), at


def gathered(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n


def send_segments(block: int, ids: list[int], raws: list[bytes], got: Got) -> Sent:
    """Segments with a shared anchor by hash, and what each such anchor has of them."""
    some, parts = np.sort(numbers(got, "shared")), []
    for lo, hi in slices(raws) if len(some) else ():
        x = Segments(raws[lo:hi], some)
        parts.append((x.g1, x.g2, x.anchor, np.array(ids[lo:hi], np.int64)[x.text]))
    g1, g2, anchor, doc = gathered(parts, 4)
    rows, at = spans(g1, g2, doc, block)
    o, first = groups(anchor[at])
    key, g1 = anchor[at][o][first], rows["g1"][o]
    least, largest = (f.reduceat(g1, first) if len(first) else g1 for f in (np.minimum, np.maximum))
    crowd = table_of({"anchor": key, "least": least, "largest": largest, "n": np.diff(np.r_[first, len(o)]) if len(first) else first, "block": block}, CROWD)
    return {"whole": (rows, rows["g1"]), "crowd": (crowd, crowd["anchor"])}


def send_texts(block: int, ids: list[int], raws: list[bytes], got: Got) -> Sent:
    """The different segments of anchors that have some, as text; windows of those that have many, by hash."""
    kinds = numbers(got, "crowd", ANCHORS)
    some, many = (np.sort(kinds["anchor"][kinds["kind"] == k]) for k in (SOME, MANY))
    both = np.sort(kinds["anchor"])
    parts, wins, flats = [], [], []
    for lo, hi in slices(raws) if len(kinds) else ():
        x = Segments(raws[lo:hi], both)
        doc = np.array(ids[lo:hi], np.int64)
        heavy = within(x.anchor, many)
        light = np.flatnonzero(~heavy)
        parts.append((x.g1[light], x.g2[light], x.anchor[light], doc[x.text[light]], np.full(len(light), len(flats)), x.starts[light], x.ends[light]))
        flats.append(x.flat)
        if heavy.any():
            _, text, h1, h2 = x.windows(np.flatnonzero(heavy))
            wins.append((h1, h2, doc[text]))
    g1, g2, anchor, doc, flat, start, end = gathered(parts, 7)
    rows, at = spans(g1, g2, doc, block)
    own = [flats[k][s:e] for k, s, e in zip(flat[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True)]
    out = table_of({"anchor": anchor[at], **{c: rows[c] for c in ("g1", "g2", "lo", "hi", "block")}, "size": np.array([len(t) for t in own], np.int32)}, TEXT)
    out["segment"] = np.frombuffer(b"".join(t.ljust(LONGEST, b"\0") for t in own), f"V{LONGEST}")
    each, _ = spans(*gathered(wins, 3), block)
    return {"text": (out, out["anchor"]), "window": (each, each["g1"])}


def recurring(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What two documents have, with the first, for each block that has a later document with it."""
    o, first = groups(rows["g1"], rows["g2"])
    rows = rows[o]
    least = of_group(np.minimum, rows["lo"], first)
    late = rows["hi"] > least
    return rows["block"][late], table_of({"g1": rows["g1"][late], "g2": rows["g2"][late], "first": least[late]}, FIRST)


def crowds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that have different segments, for each block that has them, and whether they are many."""
    o, first = groups(rows["anchor"])
    rows = rows[o]
    several = of_group(np.minimum, rows["least"], first) != of_group(np.maximum, rows["largest"], first)
    kind = np.where(of_group(np.add, rows["n"], first) > HEAVY, MANY, np.where(several, SOME, ALONE))
    keep = kind != ALONE
    return rows["block"][keep], table_of({"anchor": rows["anchor"][keep], "kind": kind[keep]}, ANCHORS)


def transform(texts: list[bytes], most: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all texts in order, as (text, start), their preceding symbols (END: none), and the common prefix
    of each with the one before, counted up to `most`. The empty suffixes come first, by text."""
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    flat, base = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    before = lambda who, at: np.where(at > 0, flat[np.maximum(base[who] + at - 1, 0)] if len(flat) else END, END).astype(np.uint8)
    who, start = np.arange(m, dtype=np.int32), size.astype(np.int32)
    bwt, lcp = before(who, start), np.zeros(m, np.uint8)
    row = np.arange(m)  # where the last inserted suffix of each live text is
    live = np.flatnonzero(size > 0)
    while len(live):
        order = np.argsort(bwt, kind="stable")  # the suffixes one symbol longer, in order; those of END do not exist
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        r = row[live]
        k = rank[r]
        o = np.argsort(k)
        live, r, k = live[o], r[o], k[o]
        place = m + k
        levels = np.zeros((max(1, len(lcp).bit_length()), len(lcp)), np.uint8)  # minima of 1, 2, 4, ... neighbours
        levels[0] = lcp
        for v in range(1, len(levels)):
            step = 1 << v - 1
            np.minimum(levels[v - 1, :-step], levels[v - 1, step:], out=levels[v, :-step])
        real = int(np.count_nonzero(bwt != END))

        def shared(i: np.ndarray, order=order, levels=levels, bwt=bwt, real=real) -> np.ndarray:
            """1 + the least common prefix on the way from the row before to the row of the i-th suffix in the new order."""
            ok = (i > 0) & (i < real)
            i = np.where(ok, i, min(1, len(order) - 1))
            b, a = order[i], order[i - 1]
            ok &= bwt[a] == bwt[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            v = np.frexp(np.maximum(b - a, 1))[1] - 1
            least = np.minimum(levels[v, np.minimum(a + 1, len(bwt) - 1)], levels[v, np.maximum(b + 1 - (1 << v), 0)])
            return np.where(ok, np.minimum(least.astype(np.int64) + 1, most), 0).astype(np.uint8)

        own, after = shared(k), shared(k + 1)
        total = len(bwt) + len(live)
        stay = np.ones(total, bool)
        stay[place] = False
        stay = np.flatnonzero(stay)
        start_new = start[r] - 1
        merged = []
        for old, new in ((bwt, before(live, start_new)), (lcp, own), (who, live.astype(np.int32)), (start, start_new)):
            x = np.empty(total, old.dtype)
            x[place], x[stay] = new, old
            merged.append(x)
        bwt, lcp, who, start = merged
        has = place + 1 < total
        lcp[place[has] + 1] = after[has]
        row[live] = place
        live = live[start_new > 0]
    return who, start, bwt, lcp


def candidates(texts: list[bytes]) -> np.ndarray:
    """Which texts have a window whose rolling hash another window of the collection has too."""
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    if len(flat) < WIDTH:
        return np.zeros(len(texts), bool)
    power = np.multiply.accumulate(np.full(len(flat), 0x9E3779B97F4A7C15, np.uint64))
    back = np.multiply.accumulate(np.full(len(flat), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum((flat + np.uint64(1)) * power)]
    h = mix((sums[WIDTH:] - sums[:-WIDTH]) * back[: len(flat) - WIDTH + 1])
    who = np.repeat(np.arange(len(texts)), size)[: len(h)]
    inside = np.arange(len(h)) + WIDTH <= np.cumsum(size)[who]
    h, who = h[inside], who[inside]
    o = np.argsort(h)
    same = h[o][1:] == h[o][:-1]
    out = np.zeros(len(texts), bool)
    out[who[o[1:][same]]] = out[who[o[:-1][same]]] = True
    return out


def firsts(texts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> list[list[dict]]:
    """Of each text, the runs of windows that two documents have, with the smallest doc_id."""
    known = candidates(texts)
    chosen = np.flatnonzero(known)
    who, start, _, lcp = transform([texts[i] for i in chosen])
    who = chosen[who]
    size = np.array([len(t) for t in texts])
    group = np.cumsum(lcp < WIDTH) - 1
    full = size[who] - start >= WIDTH
    who, start, group = who[full], start[full], group[full]
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(group)])
    least, largest = (np.repeat(f.reduceat(x[who], new), n) if len(new) else x[who] for f, x in ((np.minimum, lo), (np.maximum, hi)))
    keep = least < largest
    who, start, least = who[keep], start[keep], least[keep]
    o = np.lexsort((start, who))
    who, start, least = who[o], start[o], least[o]
    # A window that no other segment has may still be in two documents, those that share its whole segment.
    edge = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])]) if len(who) else np.zeros(0, np.int64)
    out: list[list[dict]] = [[] for _ in texts]
    for e, k in zip(edge.tolist(), np.diff(np.r_[edge, len(who)]).tolist(), strict=True):
        out[who[e]].append({"at": int(start[e]), "n": k, "first": int(least[e])})
    for i in np.flatnonzero(lo < hi):
        if not out[i] and not known[i]:
            out[i].append({"at": 0, "n": int(size[i]) - WIDTH + 1, "first": int(lo[i])})
    return out


def resolved(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a part's segments the runs of windows that two documents have, for each block with a later document; shards are
    about SHARD segments, and whole anchors."""
    o, first = groups(rows["anchor"], rows["g1"], rows["g2"])
    rows = rows[o]
    one = rows[first] if len(first) else rows
    lo, hi = (f.reduceat(rows[c], first) if len(first) else rows[c] for f, c in ((np.minimum, "lo"), (np.maximum, "hi")))
    texts = [t[:n] for t, n in zip(one["segment"].tolist(), one["size"].tolist(), strict=True)]
    fresh = np.flatnonzero(np.r_[True, one["anchor"][1:] != one["anchor"][:-1]]) if len(one) else first
    edges = [0]
    for at in [*fresh.tolist(), len(one)]:
        if at - edges[-1] >= SHARD or at == len(one) > edges[-1]:
            edges.append(at)
    runs = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in firsts(texts[a:b], lo[a:b], hi[a:b])]
    n = np.array([len(x) for x in runs], np.int64)
    flat = [y for x in runs for y in x]
    which = np.repeat(np.arange(len(one)), n)
    found = table_of({"g1": one["g1"][which], "g2": one["g2"][which], "at": [y["at"] for y in flat], "n": [y["n"] for y in flat], "first": [y["first"] for y in flat]}, RUN)
    # Each run goes to each block that has its segment in a later document.
    copies = np.diff(np.r_[first, len(rows)]) if len(first) else first
    m = copies[which]
    run = np.repeat(np.arange(len(which)), m)
    row = np.repeat(first[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    late = rows["hi"][row] > found["first"][run]
    return rows["block"][row[late]], found[run[late]]


def marks(x: Segments, doc: np.ndarray, got: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of what the texts of these segments lose."""
    whole, runs, single, crowded, many = got
    starts, ends = [], []
    alone = ~within(x.anchor, crowded)
    for known in (whole, runs):
        a, b = np.searchsorted(known["g1"], x.g1, "left"), np.searchsorted(known["g1"], x.g1, "right")
        n = b - a
        which = np.repeat(np.arange(len(n)), n)
        k = known[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ok = (k["g2"] == x.g2[which]) & (k["first"] < doc[x.text[which]]) & ((known.dtype == RUN) | alone[which])
        which, k = which[ok], k[ok]
        if known.dtype == RUN:
            starts.append(x.starts[which] + k["at"])
            ends.append(starts[-1] + k["n"] + WIDTH - 1)
        else:
            starts.append(x.starts[which])
            ends.append(x.ends[which])
    if len(single):
        at, text, h1, h2 = x.windows(np.flatnonzero(within(x.anchor, many)))
        k = np.minimum(np.searchsorted(single["g1"], h1), len(single) - 1)
        ok = (single["g1"][k] == h1) & (single["g2"][k] == h2) & (single["first"][k] < doc[text])
        starts.append(at[ok])
        ends.append(at[ok] + WIDTH)
    return starts, ends


def removed(packed: DataFrame, answers: DataFrame, texts: bool) -> DataFrame:
    """One row a document; with texts also the bytes that are left."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def run(_: int, docs: pa.Table, got: Got) -> Iterator[pa.RecordBatch]:
        raws, ids = raws_of(docs.column("text")), docs.column("doc_id").to_pylist()
        kinds = numbers(got, "crowd", ANCHORS)
        known = [np.sort(numbers(got, c, t), order="g1") for c, t in (("whole", FIRST), ("text", RUN), ("window", FIRST))]
        known += [np.sort(kinds["anchor"]), np.sort(kinds["anchor"][kinds["kind"] == MANY])]
        use = [i for i, d in enumerate(ids) if d is not None] if any(map(len, known)) else []
        rows: list[tuple] = [(len(r), 0, 0, r) for r in raws]
        for lo, hi in slices([raws[i] for i in use]):
            some = use[lo:hi]
            x = Segments([raws[i] for i in some])
            starts, ends = map(np.concatenate, marks(x, np.array([ids[i] for i in some], np.int64), known))
            if not len(starts):
                continue
            gone = between(starts, ends, len(x.flat))
            at = 0
            for i in some:
                mask, at = gone[at : at + len(raws[i])], at + len(raws[i])
                if n := int(np.count_nonzero(mask)):
                    spans_ = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0])
                    rows[i] = (len(mask), n, spans_, np.frombuffer(raws[i], np.uint8)[~mask].tobytes())
        cols = list(zip(*((*r[:3], hashlib.sha256(r[3]).hexdigest(), r[3]) for r in rows), strict=True)) if rows else [()] * 5
        kinds_ = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        out = [pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)]]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays(out if texts else out[:5], names=names if texts else names[:5])

    return per_block(packed, answers, run, schema)


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts kept, the remaining bytes."""
    packed = dealt(docs, n := blocks(docs), ["doc_id", "text"])
    shared = shared_anchors(packed, find, n)
    segments = round_(packed, shared, send_segments, n, whole=Question(SPAN, recurring), crowd=Question(CROWD, crowds))
    discard(shared)
    crowd = segments.where("kind = 'crowd'")
    answers = round_(packed, crowd, send_texts, n, text=Question(TEXT, resolved), window=Question(SPAN, recurring))
    return removed(packed, segments.unionByName(answers), texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
