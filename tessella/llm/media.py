"""Media columns: documents as ordered sequences of text and of references to media that are stored by digest.

sequences() parses HTML into one array a page, in reading order: text runs, and media references (img, audio, video,
source) with their digest and caption (the figure's figcaption, else alt, else title). store() writes payloads as
8-bit grey PNG files, 576 samples a row, losslessly; fetch() reads the stored bytes back, checks every chunk and
computes features; resolve() joins references to what was fetched, by digest, and keeps position and caption beside it.

Defined cases: null or empty HTML has an empty sequence; a reference without a sha256: digest keeps a null digest and
resolves to nothing; a digest that the store lacks resolves to nulls; a payload that is stored more than once counts
once. A caption outside a figure is text, and one that is left open ends with its figure. A null text is the empty
payload; equal texts and repeated rows have equal payloads, and a row each; empty tables give empty results; a very long
text is one file. Columns that are not named here are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_size, cut, table

WIDTH, PAD = 576, b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Reader(HTMLParser):
    """Collects [kind, text, digest, caption] items in reading order."""

    MEDIA, SILENT = {"img", "audio", "video", "source"}, {"script", "style", "noscript", "template", "title"}
    BREAKS = {"p", "div", "li", "br", "hr", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "section", "article", "ul", "ol", "table", "blockquote", "pre", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.silent, self.figure, self.caption = 0, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "body":
            self.silent = 0  # a title or the like that was left open ends here
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.MEDIA:
            self.flush()
            src = a.get("src") or ""
            self.items.append(["media", None, src[7:] if src.startswith("sha256:") else None, a.get("alt") or a.get("title")])
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.end_figure()
                self.figure = len(self.items)
            elif tag == "figcaption" and self.figure is not None:
                self.caption = []

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.end_figure()

    def end_caption(self) -> None:
        text, self.caption = " ".join("".join(self.caption or ()).split()), None
        for item in self.items[self.figure :] if text else []:
            if item[0] == "media":
                item[3] = text

    def end_figure(self) -> None:
        """A caption ends with its figure, if not before; at the end of the page, so does a figure."""
        if self.figure is not None and self.caption is not None:
            self.end_caption()
        self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def read_html(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_figure()
    reader.flush()
    return [dict(zip(("position", "kind", "text", "digest", "caption"), (i, *x), strict=True)) for i, x in enumerate(reader.items)]


def sequences(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, and `sequence`, an array of (position, kind, text, digest, caption)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([read_html(x) for x in b.column(0).to_pylist()], pa.list_(ITEM))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], items], names=[*keep, "sequence"])

    df = pages.select(F.col(f"`{html}`").alias("_html"), *[F.col(f"`{c}`") for c in keep])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[1:])
    return df.mapInArrow(run, kept + "sequence array<struct<position:int,kind:string,text:string,digest:string,caption:string>>")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """payload with bytes 255 up to the next positive multiple of unit."""
    return payload + PAD * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def to_png(payload: bytes) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as 8-bit grey samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter type, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a file that to_png() made; damage is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, data = 8, None, []
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey samples")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, mean square and a 64-bit average hash (is each 64th of the samples brighter than the whole?)."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    cuts = np.arange(65) * len(x) // 64
    sums, n, total = np.add.reduceat(x, cuts[:-1]), np.diff(cuts), int(x.sum())
    bits = sum(1 << i for i, (s, k) in enumerate(zip(sums.tolist(), n.tolist(), strict=True)) if s * len(x) > total * k)
    return f"{total / len(x):.4f};{int((x * x).sum()) / len(x):.4f};{bits:016x}"


def store(docs: DataFrame) -> DataFrame:
    """Each document's payload as a stored media file: (doc_id, n_bytes, digest, media), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((i, len(p), hashlib.sha256(q := padded(p)).hexdigest(), to_png(q)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for p in [(t.as_py() or "").encode()])
            for some in by_size(rows, lambda r: len(r[3])):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "digest", "media"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, media binary"), "media")


def fetch(media: DataFrame) -> DataFrame:
    """One row a digest: the features of the bytes as they were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, png in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = png.as_py()
                payload = from_png(raw)
                if (sha := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"stored bytes differ from digest {digest}")
                rows.append((digest, len(payload), sha, zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", *[x.split()[0] for x in FEATURES.split(", ")]])

    rows = media.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}")
    return rows.groupBy("digest").agg(F.first(F.struct(*[x.split()[0] for x in FEATURES.split(", ")])).alias("resolved"))


def resolve(refs: DataFrame, fetched: DataFrame) -> DataFrame:
    """refs with `resolved`, null where the store lacks the digest. Both sides are plain shuffles, so that Spark splits
    a digest that very many references share."""
    return refs.join(cut(fetched, "fetched"), "digest", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    page = F.concat(F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>Text of '), name, F.lit("</figcaption></figure></article>"))
    seqs = sequences(stored.select("doc_id", "n_bytes", page.alias("html")), keep=("doc_id", "n_bytes"))
    refs = seqs.select("doc_id", "n_bytes", F.inline("sequence")).where("kind = 'media'").drop("kind", "text")
    out = resolve(refs, fetch(stored))
    return out.select("doc_id", "n_bytes", F.col("position").cast("int").alias("position"), "caption", "resolved.*")
