"""What two kinds of substring dedup share: finding windows of fixed width that start in more than one document.

Texts are dealt to blocks once, and each block is written as one compressed row. A window's anchor is the smallest hash
of the k-grams in it, so equal windows have equal anchors and neighbouring windows mostly share one. Only anchors, not
windows, are sent for all texts (shared_anchors), each once a block; blocks then get those of their anchors that two
documents have, and look closer at windows with such an anchor alone. Anchors are 48 bits: two different ones that meet
cost a closer look and change no result.

A round() is how blocks learn what other blocks have. Each block sends numbers in arrays, dealt to parts by a key; a part
answers for its keys, and the answers go back to the blocks in arrays again. Spark moves a few long rows, numpy sorts and
groups. However hot a key is, it costs each block one number; a part has about as many numbers as a block. Blocks grow with
the square root of the input, so that the arrays between blocks and parts stay long and a part fits in memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: The column that says which block a text is dealt to.
BLOCK = "_block_of_text"
#: What a round's answers look like: a number array of some kind for a block.
ANSWERS = f"{BLOCK} int, kind string, data binary"
ANCHOR = np.dtype([("anchor", "<i8"), ("block", "<i4"), ("many", "?")])

Sent = dict[str, tuple[np.ndarray, np.ndarray]]
Got = dict[str, bytes]


class Question(NamedTuple):
    """What blocks send, and the function from all rows of a part to (blocks, rows for each)."""

    sent: np.dtype
    answer: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive numbers, by doubling."""
    if len(x) < width:
        return x[:0]
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def runs_of(anchors: np.ndarray, lengths: np.ndarray, width: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, in texts of these lengths (in symbols) that lie one behind the other.

    Returns starts, ends (of windows, not of their symbols) and the text of each run; `most` cuts longer runs up.
    """
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(anchors)]
    valid = np.arange(len(anchors)) + width <= ends[text]
    new = np.r_[True, (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])] & valid if len(anchors) else valid
    starts = np.flatnonzero(new)
    stop = np.r_[starts[1:], len(anchors)]
    stop = np.minimum(stop, ends[text[starts]] - width + 1)
    if most and len(starts) and (stop - starts).max() > most:
        parts = -(-(stop - starts) // most)
        which = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stop = starts[which] + nth * most, np.minimum(starts[which] + (nth + 1) * most, stop[which])
    return starts, stop, text[starts]


def slices(raws: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Spans of texts of about `most` bytes; one text may be larger."""
    lo = n = 0
    for i, r in enumerate(raws):
        n += len(r) + 64
        if n > most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(raws):
        yield lo, len(raws)


def raws_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def dealt(docs: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """(BLOCK, packed): the columns of each block's documents as one compressed Arrow stream, written. Rows that repeat a
    doc_id may be in several blocks; what blocks send has doc_ids, so they are one document all the same."""
    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.spark_partition_id()), F.lit(n)).cast("int")

    def run(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        data = rows.drop_columns([BLOCK]).rename_columns(columns)
        with pa.ipc.new_stream(sink, data.schema) as out:
            out.write_table(data)
        return pa.table({BLOCK: pa.array([rows.column(BLOCK)[0].as_py()], pa.int32()), "packed": pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())})

    inner = own.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], block.alias(BLOCK))  # no name can clash
    return cut(inner.groupBy(BLOCK).applyInArrow(run, f"{BLOCK} int, packed binary"), "blocks")


def unpacked(row: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(row.as_py())).read_all()


def per_block(packed: DataFrame, answers: DataFrame | None, f: Callable[[int, pa.Table, Got], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f(block, documents, arrays by kind) over all blocks."""
    if answers is None:
        both = packed.withColumn("list", F.lit(None).cast("array<struct<kind:string,data:binary>>"))
    else:
        both = packed.join(answers.groupBy(BLOCK).agg(F.collect_list(F.struct("kind", "data")).alias("list")), BLOCK, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, row, got in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                by_kind: dict[str, list[bytes]] = defaultdict(list)
                for x in got.as_py() or ():
                    by_kind[x["kind"]].append(x["data"])
                yield from f(block, unpacked(row), {k: b"".join(v) for k, v in by_kind.items()})

    return both.select(BLOCK, "packed", "list").mapInArrow(run, schema)


def parcels(to: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows for each number in `to`, as bytes."""
    o = np.argsort(to, kind="stable")
    to, rows = to[o], rows[o]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(to[a]), rows[a:b].tobytes()


def round_(packed: DataFrame, answers: DataFrame | None, f: Callable[[int, list[int], list[bytes], Got], Sent], parts: int, **ask: Question) -> DataFrame:
    """Answers (BLOCK, kind, data) to what blocks send, written.

    f(block, doc_ids, texts, arrays by kind) gives, by kind, an array of rows to send and the key that deals it to parts.
    """

    def send(block: int, docs: pa.Table, got: Got) -> Iterator[pa.RecordBatch]:
        for kind, (rows, key) in f(block, *usable(docs), got).items():
            to = (mix(key.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
            out = list(parcels(to, rows))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(out), pa.string()), pa.array([p for p, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["kind", "part", "data"])

    def answer(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        block, found = ask[kind].answer(np.frombuffer(b"".join(x.as_py() for x in rows.column("data")), ask[kind].sent))
        out = list(parcels(block, found))
        return pa.table({BLOCK: pa.array([b for b, _ in out], pa.int32()), "kind": pa.array([kind] * len(out), pa.string()), "data": pa.array([d for _, d in out], pa.binary())})

    sent = per_block(packed, answers, send, "kind string, part int, data binary")
    return cut(sent.groupBy("kind", "part").applyInArrow(answer, ANSWERS), "answers")


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rows with equal keys together, and where each such group begins in it."""
    o = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(o):
        return o, o
    new = np.zeros(len(o), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[o[1:]] != k[o[:-1]]
    return o, np.flatnonzero(new)


def of_group(f: np.ufunc, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """f over each group, for each row of it."""
    return np.repeat(f.reduceat(x, first), np.diff(np.r_[first, len(x)])) if len(first) else x


def usable(docs: pa.Table) -> tuple[list[int], list[bytes]]:
    """doc_ids and texts of the rows that have a doc_id."""
    has = docs.filter(docs.column("doc_id").is_valid())
    return has.column("doc_id").to_pylist(), raws_of(has.column("text"))


def table_of(columns: dict[str, np.ndarray], dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), dtype)
    for k, v in columns.items():
        out[k] = v
    return out


def shared_anchors(packed: DataFrame, find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """Answers of kind `shared`: for each block its anchors that documents of two different doc_ids have.

    find(texts) gives the number of the text and the anchor of each run of windows.
    """

    def send(block: int, ids: list[int], raws: list[bytes], _: Got) -> Sent:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in slices(raws):
            text, anchor = find(raws[lo:hi])
            found[0].append(low(anchor))
            found[1].append(np.array(ids[lo:hi], np.int64)[text])
        anchor, doc = map(np.concatenate, found)
        o, first = groups(anchor)
        anchor, doc = anchor[o], doc[o]
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else first.astype(bool)
        rows = table_of({"anchor": anchor[first], "block": block, "many": many}, ANCHOR)
        return {"shared": (rows, rows["anchor"])}

    def answer(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o, first = groups(rows["anchor"])
        rows = rows[o]
        size = np.diff(np.r_[first, len(rows)])
        keep = (np.repeat(size, size) > 1) | rows["many"]
        return rows["block"][keep], np.ascontiguousarray(rows["anchor"][keep])

    return round_(packed, None, send, parts, shared=Question(ANCHOR, answer))


_SMALL = np.uint64((1 << 48) - 1)


def low(anchors: np.ndarray) -> np.ndarray:
    """Anchors as shared_anchors lists them."""
    return (anchors & _SMALL).view(np.int64)


def numbers(got: Got, kind: str, dtype: np.dtype | str = "<i8") -> np.ndarray:
    return np.frombuffer(got.get(kind, b""), dtype)


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values the ordered array has."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def between(starts: list[int], ends: list[int], n: int) -> np.ndarray:
    """Which of n symbols lie in a span from a start to before its end."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
