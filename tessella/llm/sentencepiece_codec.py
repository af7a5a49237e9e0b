"""SentencePiece encoding and decoding on the Tokenizers backend.

The model's protobuf is parsed here: pieces with scores and types, the normaliser's rules and the byte fallback. From
these a Tokenizers model is rebuilt, Unigram with its scores, or BPE with merges ranked by the scores of what they make;
blanks become the metaspace marker. No piece of usual models has a marker behind another character, so no merge or path
crosses the place before a marker: a text is then encoded chunk by chunk (markers and the characters up to the
next marker), each different chunk once in a task while it is remembered, new chunks together in multithreaded batches.
A model that has such a piece is encoded text by text. Tests hold ids against the sentencepiece library's.

Defined cases: a null text is empty; an empty text has no ids; characters outside the vocabulary become byte pieces, or
the unknown id without byte fallback; a literal marker reads back as a blank, as in the library; repeated rows each get a
row, equal texts equal ids; an empty table gives an empty result; a very long text is encoded whole, by its chunks; no
columns but doc_id and text are read. Pieces of type UNUSED are an error.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import received, ship, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: types of pieces, and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes that a task remembers of chunks and their ids, about.
CACHE = 96 << 20


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return value, at


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(message):
        key, at = _varint(message, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(message, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = message[at : at + n], at + n
        elif kind == 2:
            n, at = _varint(message, at)
            value, at = message[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class SentencePieceModel:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for n, v in fields(raw):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                normalizer = dict(fields(v))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.charsmap: bytes = normalizer.get(2, b"")
        self.dummy_prefix, self.remove_extra, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind}")
        if any(t == UNUSED for _, _, t in self.pieces):
            raise ValueError("unused pieces")
        if trainer.get(24, 0):
            raise ValueError("white space as a suffix")
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


class Codec:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.known: dict[str, bytes] = {}
        self.size = 0

    def __reduce__(self):
        return Codec, (self.raw,)

    @cached_property
    def model(self) -> SentencePieceModel:
        return SentencePieceModel(self.raw)

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import AddedToken, Tokenizer, models

        m = self.model
        if m.kind == UNIGRAM:
            # Text must not match control pieces, nor byte pieces where any other path is there.
            least = min([s for _, s, t in m.pieces if t == NORMAL], default=0.0)
            vocab = [(f"\U0010fffd{i}" if t == CONTROL else p, 7 * (least - 10) if t == BYTE else s) for i, (p, s, t) in enumerate(m.pieces)]
            out = Tokenizer(models.Unigram(vocab, unk_id=m.unk_id, byte_fallback=m.byte_fallback))
        else:
            score = {p: s for p, s, t in m.pieces if t in (NORMAL, USER_DEFINED)}
            made = sorted(((-s, i, p) for i, (p, s, t) in enumerate(m.pieces) if t == NORMAL and len(p) > 1))
            merges = [(p[:k], p[k:]) for _, _, p in made for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
            out = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
        if user := [AddedToken(p, normalized=False, special=False) for p, _, t in m.pieces if t == USER_DEFINED]:
            out.add_tokens(user)
        return out

    @cached_property
    def chunk(self):
        """The pattern of chunks; None if a piece has a marker behind another character."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.model.pieces if t in (NORMAL, USER_DEFINED)):
            return None
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    @cached_property
    def charsmap(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None

    def normalise(self, text: str) -> str:
        m = self.model
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " + text if m.dummy_prefix else text
        return text.replace(" ", MARK) if m.escape else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        split = self.chunk.findall if self.chunk else lambda x: [x] if x else []
        chunks = [split(self.normalise(t)) for t in texts]
        if self.size > CACHE:
            self.known.clear()
            self.size = 0
        known = self.known
        new = list({c for x in chunks for c in x if c not in known})
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, "<i4").tobytes()
            self.size += len(c) + len(known[c]) + 200
        return [np.frombuffer(b"".join([known[c] for c in x]), "<i4") for x in chunks]

    @cached_property
    def outputs(self) -> list[bytes]:
        """Each id's bytes."""

        def of(p: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(p[3:5], 16)])
            return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()

        return [of(p, t) for p, _, t in self.model.pieces]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.outputs.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Codec:
    """The codec of a model file that the driver can read; its bytes go to the executors."""
    with open(path, "rb") as f:
        return Codec(f.read())


def slices(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n > most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))


def encode(docs: DataFrame, codec: Codec, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids; with check also SHA-256 digests of the ids (little-endian 32 bits each) and of the
    decoded text, and whether decoding gives the text's normal form back."""
    shared = ship(docs.sparkSession, codec)
    more = ", ids_sha256 string, text_sha256 string, round_trip boolean" if check else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in slices(texts):
                ids = own.encode(texts[lo:hi])
                cols = [b.column(0)[lo:hi], pa.array([len(x) for x in ids], pa.int64()), id_lists(ids)]
                if check:
                    back = [own.decode(x.tolist()) for x in ids]
                    normal = [own.normalise(t).replace(MARK, " ").removeprefix(" " if own.model.dummy_prefix else "") for t in texts[lo:hi]]
                    cols += [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, normal, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "token_ids", "ids_sha256", "text_sha256", "round_trip"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>" + more)


def decode(rows: DataFrame, codec: Codec, ids: str = "token_ids") -> DataFrame:
    """rows (doc_id, token_ids) back to (doc_id, text)."""
    shared = ship(rows.sparkSession, codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), load())
