import random
import struct

import pytest
import sentencepiece

from tessella.llm import sentencepiece_codec as C


def _field(n, kind, value):
    key = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 127 | 128, n >> 4])
    return key + (bytes([len(value) & 127 | 128, len(value) >> 7]) + value if kind == 2 else value)


def unigram_model():
    """A model file written by hand: unigram scores, byte fallback, no training."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rng = random.Random(3)
    for p in ["▁", "▁the", "▁a", "▁an", "the", "an", "and", "▁and", "a", "b", "c", "n", "d", "t", "h", "e", "th", "he", "ab", "▁ab", "nd", "bc", "▁▁"]:
        pieces.append((p, -rng.uniform(1, 9), 1))
    out = b""
    for p, s, t in pieces:
        out += _field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([t])))
    trainer = _field(3, 0, b"\x01") + _field(35, 0, b"\x01")
    normal = _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01")
    return out + _field(2, 2, trainer) + _field(3, 2, normal)


def texts(n=400):
    rng = random.Random(1)
    alphabet = "ab  ▁éß日\n\t<0x0A></s>the and 🙂\x00ỹ"
    return ["", " ", "  the  and ", "▁▁a", "</s>"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("raw", [open(C.MODEL, "rb").read(), unigram_model()], ids=["bpe", "unigram"])
def test_parity_with_the_library(raw):
    codec, library = C.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    want = library.encode(texts(), num_threads=1)
    assert [x.tolist() for x in codec.encode(texts())] == want
    assert [codec.decode(x) for x in want] == [library.decode(x) for x in want]


def test_whole_table(spark, docs, rows, empty):
    codec = C.load()
    library = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    got = C.encode(docs, codec).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in got) == want
    back = C.decode(C.encode(docs, codec, check=False), codec)
    assert sorted(str(r["text"]) for r in back.collect()) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert C.encode(empty, codec).count() == 0
