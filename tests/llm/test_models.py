"""Toxicity and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from conftest_llm import frame

from tessella.llm import logbilinear as L
from tessella.llm import toxicity as T


def toxic_corpus(n=400):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = rng.choices(words, k=rng.randint(15, 60))
        bad = int(i % 4 == 0)
        for _ in range(4 * bad):
            t[rng.randrange(len(t))] = rng.choice(["zzvile", "qqscum", "zzfoul"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, bad))
    return rows, labels


def test_held_out_toxicity(spark, empty):
    rows, labels = toxic_corpus()
    df = frame(spark, [*rows, (None, None), (9001, ""), rows[0]])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9001, 1, None)], "doc_id long, quality int, toxic int")
    got = T.score(df, lab).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in labels}
    test = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 40 and sum(a == b for a, b in test) / len(test) > 0.95
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    flipped = lab.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {(r["doc_id"], r["score"]) for r in T.score(df, flipped).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    assert T.score(empty, lab).count() == 0
    assert {r["score"] for r in T.score(df, lab.where("toxic = 0")).collect()} == {0.0}


def test_scores_by_a_second_way(spark):
    """Every score again from the two dictionaries: each window compressed anew, counts and logistic curve by hand."""
    rows, labels = toxic_corpus(200)
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + " zzvile qqscum zzfoul"
    texts = [*rows, (700, long), (701, ""), (702, None), (703, " \n\t"), (704, "zzvile"), rows[3], (rows[4][0], "another text with its id")]
    lab = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, texts, extra=True).repartition(3)
    model = T.Classifier(*T.training_rows(df, lab.where(T.fold(5) != 0), T.PER_CLASS))
    ordinary, toxic = map(T.compressor, model.dictionaries)

    def expected(text):
        d = []
        for w in (text or "").encode().split():
            block = T.CARRIER + b" " + w + b" " + T.TRAILER
            d.append(len(ordinary.compress(block)) - len(toxic.compress(block)))
        best = sorted(d)[::-1][: T.TOP]
        x = [max(0, v) for v in best] + [0] * (T.TOP - len(best)) + [math.log(1 + len(d))]
        many = [sum(v >= step for v in d) for step in T.STEPS]
        x += [4 * math.log(1 + n) for n in many] + [80 * n / (len(d) + 10) for n in many]
        z = sum(v / 8 * c for v, c in zip(x, model.curve, strict=False)) + model.curve[-1]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = sorted((str(r["doc_id"]), r["score"]) for r in T.score(df, lab).collect())
    want = sorted((str(i), expected(t)) for i, t in texts)
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-9)


def tokens(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [""]


def test_base_scores(spark, docs, rows, empty):
    trained = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    c = Counter(w for i, t in rows if trained(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows)
    got = L.score(docs).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [x[:3] for x in mine] == [x[:3] for x in want] and np.allclose([x[3] for x in mine], [x[3] for x in want], atol=1e-6)
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert all(r["held_out"] != trained(r["doc_id"]) for r in got)
    assert L.score(empty).count() == 0
    none = L.score(frame(spark, [(None, "nothing to learn from"), (None, None)])).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in none} == {(0, 0)} and all(math.isfinite(r["score"]) for r in none)


def test_scores_follow_from_the_table_alone(spark, docs):
    of = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in L.score(df).collect())
    a, b = of(docs.repartition(3)), of(docs.repartition(17))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-5)


def test_probabilities_of_words_add_up(spark, docs, rows, monkeypatch):
    """All seen words and one unseen word a class, after any context: the score of each, by a second way, adds up to 1."""
    monkeypatch.setattr(L, "WORDS", 40)  # most words are of a class
    monkeypatch.setattr(L, "OUTPUTS", 40 + L.CLASSES)
    texts = [(t or "").encode().lower() for _, t in rows]
    held = np.zeros(len(texts), bool)
    words, codes, n = L.coded(texts, held)
    top = np.empty(len(words), L.TOP)
    for k in ("h1", "h2", "klass", "c"):
        top[k] = words[k]
    voc = L.Vocabulary([L.summary(top)])
    assert voc.n == len(codes) == n.sum() and voc.v == len(words) == len({w for t in texts for w in t.split()}) + 1
    out = voc.outputs(words)
    inside = np.where(out < 40, 1.0, (words["c"] + L.ADD) / voc.class_z[words["klass"]])
    for k in range(L.CLASSES):
        assert abs(inside[out == 40 + k].sum() + L.ADD / voc.class_z[k] - 1) < 1e-9
    assert len(set(out[out < 40].tolist())) == 40 and sorted(words["c"][out < 40])[0] >= max(words["c"][out >= 40])


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    m = L.Model(rng.normal(size=L.OUTPUTS).astype(np.float32))
    m.q *= 30  # large products as well
    for ctx in ([L.OUTPUTS, L.OUTPUTS], [3, 7]):
        p = m.log_prob(np.tile(np.array([ctx]), (L.OUTPUTS, 1)), np.arange(L.OUTPUTS))
        assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-3


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(2)
    flat = np.array([1, 2, 3, 4] * 4000)
    log_q = np.full(L.OUTPUTS, -12.0, np.float32)
    log_q[1:5] = np.log(0.25)
    m = L.Model(log_q)
    state = [np.full(x.shape, 1.0, np.float32) for x in (m.r, m.q, m.p, m.b)]
    c, t = L.windows(flat, np.array([len(flat)]))
    before = m.log_prob(c[-400:], t[-400:]).mean()
    m.train(c, t, log_q, state, rng)
    assert m.log_prob(c[-400:], t[-400:]).mean() > before + 0.8


def test_training_takes_every_position_of_every_block(spark):
    """Each block has a word order of its own; after all rounds the model knows each of them."""
    symbols = [(b, [False, True], [4000, 4], bytearray(L.zstandard.compress(np.array([*[5 * b + i for i in range(1, 5)] * 1000, 99, 98, 97, 96], "<u2").tobytes()))) for b in range(8)]
    df = spark.createDataFrame(symbols, "block int, held array<boolean>, n array<long>, symbols binary")
    log_q = np.log(np.full(L.OUTPUTS, 1 / L.OUTPUTS, np.float32))
    model = L.fit(df, log_q)
    for b in range(8):
        assert model.log_prob(np.array([[5 * b + 2, 5 * b + 1]]), np.array([5 * b + 3]))[0] > math.log(2 / L.OUTPUTS)
    assert model.log_prob(np.array([[98, 99]]), np.array([97]))[0] < math.log(1.1 / L.OUTPUTS)  # held out
