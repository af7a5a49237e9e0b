"""Near-duplicates by Order MinHash: sketches that keep the order of k-mers, checked by a banded alignment.

A text's k-mers are its runs of K words, each labelled with how often it has occurred so far, so that repeats count.
One hash deals the k-mers to BINS bins and the smallest of each bin is sampled; an empty bin borrows from the next one.
A sketch is the sampled k-mers of ORDER fixed bins in the order of the text; two texts agree on a sketch only if they
sampled the same k-mers there and have them in the same order, which makes agreement follow edit similarity and not the
bag of words. SKETCHES such sketches are buckets.

In a bucket all texts are first compared with one, the text that shares most buckets with others: the hub of its copies.
Those that are not linked to it go on to a next round with a hub of their own; what is left of a bucket of more than
SMALL texts goes on in buckets of one more common sketch each, of the next REACH sketches. These rounds only find most
links soon: at last apart() compares all pairs of a bucket that the links so far do not connect, so no pair that shares a
bucket is lost. A pair is linked if an alignment within the band of diagonals that the threshold allows finds
aligned / (n + m - aligned) >= SIMILARITY for the two k-mer sequences. Links make classes: connected components.

What can be lost are pairs that share no bucket; the README has measured shares of them by length.
Equal texts are one node. Defined cases: a null text is empty; texts without words are alike; texts under K words are
one k-mer; a null doc_id takes part by its text and class_id is the smallest doc_id of the class that is not null;
repeated rows each get a row; empty tables give empty results; of the texts of a class the smallest doc_id leads, of texts
without one the smallest fingerprint; a very long text is aligned whole, in a band that grows with its length; columns
that first_of_classes() passes through may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, fresh, passing, release, table
from tessella.llm.components import components

K, ORDER, SKETCHES, BINS, SIMILARITY, SEED = 5, 8, 60, 128, 0.8, 11
SMALL, REACH, DEEPEST = 4, 12, 5
CHOSEN = np.stack([np.random.default_rng(SEED + i).permutation(BINS)[:ORDER] for i in range(SKETCHES)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits a word: two different 32-bit checks beside each other, the same on every machine."""
    from zlib import adler32, crc32

    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    keys = np.fromiter((crc32(w) << 32 | crc32(w[::-1], 7) ^ adler32(w) for w in seen), np.uint64, len(seen))
    return mix(keys)[ids] if len(words) else keys


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    h = word_hashes(words)
    if len(h) < k:
        return mix(np.array([np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=np.uint64)))], np.uint64)) if len(h) else np.zeros(1, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return mix(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, which occurrence of it this is)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), np.uint64)
    out[order] = s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def samples(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Of each bin the smallest hash and its place in the text; bins are ranges of hashes."""
    h = mix(x ^ np.uint64(SEED * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    order = np.argsort(h)
    ordered = h[order]
    shift = np.uint64(65 - bins.bit_length())
    first = np.searchsorted(ordered, np.arange(bins, dtype=np.uint64) << shift)
    first[first == len(h)] = 0  # behind the last hash comes the first
    return ordered[first], order[first]


def sketches(words: list[bytes], k: int = K) -> np.ndarray:
    """SKETCHES signed 64-bit numbers."""
    values, places = samples(labelled(kmer_hashes(words, k)))
    at = np.take_along_axis(CHOSEN, np.argsort(places[CHOSEN], axis=1, kind="stable"), axis=1)
    acc = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for v in values[at].T:
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + v)
    return acc.view(np.int64)


def aligned(a: list, b: list, band: int) -> int:
    """The longest common subsequence of a and b among matches at most `band` diagonals off the main one.

    Bit-parallel over a window of 2 * band + 1 positions of a that slides along b; a zero bit is a match taken.
    """
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    width = 2 * band + 1
    mask = v = (1 << width) - 1
    lo = -band
    found = 0
    for x in b:
        m = 0
        if (at := where.get(x)) is not None:
            for i in at if len(at) < 8 else at[bisect_left(at, lo) : bisect_right(at, lo + width - 1)]:
                if 0 <= i - lo < width:
                    m |= 1 << i - lo
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & mask
        found += 1 - (v & 1)
        v = v >> 1 | 1 << width - 1
        lo += 1
    return found + width - v.bit_count()


def similarity(a: list[bytes], b: list[bytes], k: int = K, least: float = SIMILARITY) -> float:
    """aligned / (n + m - aligned) of the k-mer sequences; exact where it is `least` or more, else below it."""
    x, y = ([tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else [] for w in (a, b))
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    head = 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    band = int((n + m) * (1 - least) / (1 + least)) + 1  # insertions and deletions that the threshold allows
    got = head + tail + aligned(x[head : n - tail], y[head : m - tail], band)
    return got / (n + m - got)


def fingerprint(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, sketch array), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sketches(words_of(t.as_py())) for t in b.column(2)]
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * SKETCHES), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["fp", "doc_id", "sketch"])

    return cut(docs.select(fingerprint().alias("fp"), "doc_id", "text").mapInArrow(run, "fp binary, doc_id long, sketch array<long>"), "sketched")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with `linked`; texts (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            linked = []
            for a, s, t in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if (key := a.as_py()) != last:
                    last, words = key, words_of(s.as_py())
                linked.append(similarity(words, words_of(t.as_py())) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    with_b = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, linked boolean")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose fp may be one of wanted's: all that are, and few others. The filter has one bit for each of 2^25 hashes,
    4 MB at any size; a join must follow."""
    bits = lambda fp: (F.pmod(F.xxhash64(fp), F.lit(1024)), F.pmod(F.shiftright(F.xxhash64(fp), 10), F.lit(32768)))
    part, at = bits("fp")
    maps = wanted.select(part.alias("_part"), at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumns({"_part": part, "_at": at}).join(F.broadcast(maps), "_part")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).select(rows.columns)


def deeper(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each member in the buckets of its own bucket's key and one of the next sketches."""
    later = F.posexplode(F.slice("sketch", F.col("last") + 2, F.lit(REACH))).alias("_k", "_value")
    each = left.join(nodes.select("fp", "sketch"), "fp").select("fp", "shared", "bucket", "depth", "last", later)
    at = F.col("last") + 1 + F.col("_k")
    return each.select(F.xxhash64("bucket", at, "_value").alias("bucket"), at.alias("last"), (F.col("depth") + 1).alias("depth"), "shared", "fp")


def grams(texts: DataFrame) -> DataFrame:
    """(fp, comp, n, kmer) of texts (fp, comp, text): a row for each of a text's n labelled k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                hashes = [labelled(kmer_hashes(words_of(t.as_py()))).view(np.int64) for t in part.column(2)]
                n = np.array([len(h) for h in hashes])
                at = pa.array(np.repeat(np.arange(len(n)), n))
                cols = [part.column(0).take(at), part.column(1).take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(hashes))]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "comp", "n", "kmer"])

    return texts.select("fp", "comp", "text").mapInArrow(run, "fp binary, comp binary, n long, kmer long")


def rare_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) of different components: all pairs of texts (fp, comp, text) that can reach 0.8, and some others.

    Two texts of 0.8 have 0.8 of the longer one's k-mers in common, so that each has one of these among its first
    n - 0.8 n + 1 in any order that both use; here the rarest come first. Of a k-mer that they share, what follows it in
    both must be enough for the rest.
    """
    each = cut(grams(texts), "grams")
    ranked = each.join(each.groupBy("kmer").agg(F.count("*").alias("c")), "kmer")
    first = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    lists = ranked.groupBy("fp", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("c", "kmer"))).alias("_all"))
    heads = lists.select("fp", "comp", "n", F.posexplode(F.slice("_all", F.lit(1), first.cast("int"))).alias("at", "_one"))
    heads = cut(heads.where("_one.c > 1").select("fp", "comp", "n", "at", F.col("_one.kmer").alias("kmer")), "heads")
    mixed = heads.groupBy("kmer").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("main")).where("lo < hi")
    heads = cut(heads.join(mixed.select("kmer", "main"), "kmer"), "heads")
    x = heads.where("comp <> main").alias("x")  # texts of a k-mer's largest component meet only the others
    y = heads.alias("y")
    once = "x.kmer = y.kmer AND x.comp <> y.comp AND (y.comp = y.main OR x.comp < y.comp)"
    enough = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND 9 * least(x.n - x.at, y.n - y.at) >= 4 * (x.n + y.n)"
    return x.join(y, F.expr(f"{once} AND {enough}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def apart(members: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) that share one of the buckets `members` (bucket, n, b) and that edges (u, v) do not connect: all of them in
    buckets of up to SMALL texts, in larger ones all that can reach 0.8."""
    labels = components(edges)
    placed = members.select("bucket", "n", F.col("b").alias("fp")).join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    placed = cut(placed.select("bucket", "n", "fp", F.coalesce("label", "fp").alias("comp")), "placed")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    still = cut(placed.join(several, "bucket"), "still")
    few = still.where(F.col("n") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    near = x.join(y, F.expr("x.bucket = y.bucket AND x.comp < y.comp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = still.where(F.col("n") > SMALL).select("fp", "comp").distinct()
    far = rare_pairs(cut(texts.join(many, "fp").select("fp", "comp", "text"), "open"))
    return near.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(u, v) of linked texts by fingerprint; nodes (fp, first_id, sketch) has one row a text. None: no two agree."""

    def met(members: DataFrame) -> DataFrame:
        """Members (as b) of buckets that have two or more, with their bucket's hub, a, and size, n."""
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("shared", "fp")).alias("hub")).where("n > 1")
        few = cut(sizes.select("bucket", "n", F.col("hub.fp").alias("a")), "hubs")
        return cut(members.join(few, "bucket").withColumnRenamed("fp", "b"), "members")

    flat = nodes.select("fp", F.posexplode("sketch").alias("last", "bucket"))
    sizes = cut(flat.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    release(docs.sparkSession)
    crowd = cut(flat.join(sizes, "bucket"), "crowd")
    shared = cut(crowd.groupBy("fp").agg(F.sum("m").alias("shared")), "shared")
    if shared.isEmpty():
        return None
    members = met(crowd.drop("m").join(shared, "fp").withColumn("depth", F.lit(0)))
    first = members.where("n > 2")
    wanted = cut(shared.select("fp").join(nodes.select("fp", "first_id"), "fp"), "wanted")
    own = docs.select(fingerprint().alias("fp"), F.col("doc_id").alias("first_id"), "text")
    same = (F.col("fp") == F.col("_fp")) & F.col("first_id").eqNullSafe(F.col("_id"))
    some = marked(own, wanted).join(wanted.withColumnsRenamed({"fp": "_fp", "first_id": "_id"}).hint("merge"), same)  # a semi join would be moved before the filter
    texts = cut(some.select("fp", "text").dropDuplicates(["fp"]), "texts")
    release(docs.sparkSession)
    found: list[DataFrame] = []
    known: list[DataFrame] = []
    while not members.isEmpty():
        release(docs.sparkSession)
        checked = cut(verify(members.where("a <> b").select("a", "b").distinct(), texts), "checked")
        known.append(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        found.append(checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        left = cut(members.join(checked.where("not linked").select("a", "b"), ["a", "b"], "left_semi").withColumnRenamed("b", "fp").drop("a"), "left")
        down = (F.col("n") > SMALL) & (F.col("depth") < DEEPEST)
        stay = left.where(~down).select("bucket", "last", "depth", "shared", "fp")
        members = met(cut(stay.unionByName(deeper(left.where(down), nodes)), "next"))
    release(docs.sparkSession)
    rest = apart(first, union(found), texts).join(union(known).distinct(), ["a", "b"], "left_anti")
    checked = cut(verify(cut(rest, "rest"), texts), "checked")
    return union([*found, checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))])


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, doc_id), and texts (fp, text_id, class_id, leads); in each class one text leads."""
    with passing() as kept:
        rows, texts = _classed(docs)
        return kept(rows), kept(texts)


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = sketched(docs)
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch")), "nodes")
    edges = links(docs, nodes)
    ids = nodes.select("fp", F.col("first_id").alias("text_id"))
    if edges is None:
        return rows, cut(ids.withColumns({"class_id": F.col("text_id"), "leads": F.lit(True)}), "classes")
    labels = cut(ids.join(components(edges).withColumnRenamed("node", "fp"), "fp"), "labelled")
    first = F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "fp"))
    least = cut(labels.groupBy("label").agg(first.alias("first")), "least")
    linked = cut(labels.join(least, "label").select("fp", F.col("first.text_id").alias("class_id"), (F.col("fp") == F.col("first.fp")).alias("leads")), "linked")
    of = ids.join(linked, "fp", "left").select("fp", "text_id", F.when(F.col("leads").isNull(), F.col("text_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    return rows, cut(of, "classes")


def classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_id (the smallest doc_id with this very text) and class_id (of its class)."""
    rows, of = classed(docs)
    return rows.select("fp", "doc_id").join(of, "fp").select("doc_id", "text_id", "class_id")


def first_of_classes(docs: DataFrame) -> DataFrame:
    """The document of each class with the smallest doc_id, with all its columns; of rows that repeat it, one."""
    _, of = classed(docs)
    fp, at, lead_fp, lead_at = (fresh(n, docs) for n in ("own_fp", "own_id", "lead_fp", "lead_id"))
    lead = of.where("leads").select(F.col("fp").alias(lead_fp), F.coalesce(F.col("text_id").cast("string"), F.lit("")).alias(lead_at))
    own = docs.select("*", fingerprint().alias(fp), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(at))
    chosen = own.join(lead, (F.col(fp) == F.col(lead_fp)) & (F.col(at) == F.col(lead_at)), "left_semi")
    return chosen.dropDuplicates([fp, at]).select([F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
