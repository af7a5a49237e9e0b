import hashlib
import random

import pytest
from conftest_llm import frame

from tessella.llm import phrase_dedup as P
from tessella.llm import suffix_dedup as S


def marked(seqs, width):
    """(doc_id, sequence, mask) by brute force."""
    first = {}
    for i, x in seqs:
        for k in range(len(x) - width + 1) if i is not None else ():
            w = tuple(x[k : k + width])
            first[w] = min(first.get(w, i), i)
    for i, x in seqs:
        mask = [False] * len(x)
        for k in range(len(x) - width + 1) if i is not None else ():
            if first[tuple(x[k : k + width])] < i:
                mask[k : k + width] = [True] * width
        yield i, x, mask


def wanted_words(rows):
    return sorted((str(i), len(x), sum(m), hashlib.sha256(b" ".join(w for w, g in zip(x, m, strict=True) if not g)).hexdigest()) for i, x, m in marked([(i, (t or "").encode().split()) for i, t in rows], 13))


def wanted_bytes(rows):
    out = []
    for i, x, m in marked([(i, (t or "").encode()) for i, t in rows], 50):
        spans = sum(1 for k, g in enumerate(m) if g and not (k and m[k - 1]))
        out.append((str(i), len(x), sum(m), spans, hashlib.sha256(bytes(b for b, g in zip(x, m, strict=True) if not g)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_phrases(docs, rows, empty):
    assert found(P.dedup(docs)) == wanted_words(rows)
    assert P.dedup(empty).count() == 0


def test_bytes(docs, rows, empty):
    assert found(S.dedup(docs)) == wanted_bytes(rows)
    assert S.dedup(empty).count() == 0


def test_many_contexts_of_one_line(spark, monkeypatch):
    rng = random.Random(2)
    line = "this one line stands in every text and is longer than fifty bytes by far, with more than thirteen words in it"
    rows = [(i, "".join(rng.choices("abc de", k=70)) + line + "".join(rng.choices("abc de", k=70))) for i in range(80)] + [(90 + i, "ab" * 60 + "a" * i) for i in range(6)]
    df = frame(spark, rows)
    assert found(S.dedup(df)) == wanted_bytes(rows)
    assert found(P.dedup(df)) == wanted_words(rows)
    monkeypatch.setattr(S, "HEAVY", 5)
    assert found(S.dedup(df)) == wanted_bytes(rows)


def test_texts_without_phrases(docs, rows):
    out = P.without_phrases(docs)
    assert out.columns == docs.columns
    kept = {str(i): [w for w, g in zip(x, m, strict=True) if not g] for i, x, m in marked([(i, (t or "").encode().split()) for i, t in rows if i is not None], 13) if any(m)}
    for r in out.collect():
        if str(r["doc_id"]) in kept and r["text"] and len(r["text"].split()) == len(kept[str(r["doc_id"])]):
            assert r["text"].encode().split() == kept[str(r["doc_id"])]
    assert out.count() == docs.count() and kept


@pytest.mark.parametrize("most", [3, 255])
def test_collection_transform(most):
    rng = random.Random(4)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
        who, start, bwt, lcp = S.transform(texts, most)
        suffixes = [texts[w][s:] for w, s in zip(who, start, strict=True)]
        assert suffixes == sorted(t[s:] for t in texts for s in range(len(t) + 1))
        for i, (w, s, b) in enumerate(zip(who, start, bwt, strict=True)):
            assert b == (texts[w][s - 1] if s else S.END)
            common = 0
            while i and common < min(len(suffixes[i]), len(suffixes[i - 1])) and suffixes[i][common] == suffixes[i - 1][common]:
                common += 1
            assert lcp[i] == min(common, most)
