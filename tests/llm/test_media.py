import hashlib
import zlib

import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

from tessella.llm import media as M


def test_png_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        p = M.padded(bytes(i % 251 for i in range(n)))
        assert len(p) % 576 == 0 and len(p) > 0 and M.from_png(M.to_png(p)) == p
    png = bytearray(M.to_png(M.padded(b"abc")))
    png[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        M.from_png(bytes(png))


def test_reading_order():
    html = "<head><title>no</title></head><p>One &amp; <b>two</b></p><script>x</script><figure><img src='sha256:aa' alt='alt'><figcaption>A  caption</figcaption></figure>tail<img src=x.png title=t><video src='sha256:bb'>"
    got = [(x["kind"], x["text"], x["digest"], x["caption"]) for x in M.read_html(html)]
    assert got == [("text", "One & two", None, None), ("media", None, "aa", "A caption"), ("text", "tail", None, None), ("media", None, None, "t"), ("media", None, "bb", None)]
    assert M.read_html(None) == [] and [x["position"] for x in M.read_html(html)] == list(range(5))


def test_tags_that_are_left_open():
    got = lambda html: [(x["kind"], x["text"], x["caption"]) for x in M.read_html(html)]
    assert got("<head><title>t</title><body><p>x<img src='sha256:a'>") == [("text", "x", None), ("media", None, None)]
    assert got("<figure><img src='sha256:a'><figcaption>c</figure>later") == [("media", None, "c"), ("text", "later", None)]
    assert got("<img src='sha256:a'><figcaption>loose</figcaption>z") == [("media", None, None), ("text", "loose", None), ("text", "z", None)]


def test_resolution_keeps_position_and_caption(spark):
    docs = frame(spark, [(1, "one"), (2, "two"), (3, "one")])
    stored = M.store(docs)
    a, b = (hashlib.sha256(M.padded(t)).hexdigest() for t in (b"one", b"two"))
    pages = spark.createDataFrame([(7, f"x<img src='sha256:{b}' alt=B>y<img src='sha256:{a}' alt=A><img src='sha256:00'>"), (8, None)], "page_id long, html string")
    refs = M.sequences(pages, keep=("page_id",)).select("page_id", F.inline("sequence")).where("kind = 'media'")
    got = {r["position"]: (r["caption"], r["resolved"] and r["resolved"]["payload_sha256"]) for r in M.resolve(refs, M.fetch(stored)).collect()}
    assert got == {1: ("B", b), 3: ("A", a), 4: (None, None)}


def test_query(spark, docs, rows, empty, tmp_path):
    for name, df in (("full", docs), ("none", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = M.query(spark, str(tmp_path / "full")).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = M.padded(raw)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in got}) == len({x[3] for x in want})
    assert M.query(spark, str(tmp_path / "none")).count() == 0
