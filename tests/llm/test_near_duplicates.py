import random
from itertools import pairwise

import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

from tessella.llm import order_minhash as O
from tessella.llm.components import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_in_a_band():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert O.aligned(a, b, 60) == lcs(a, b)
        d = len(a) + len(b) - 2 * lcs(a, b)
        assert O.aligned(a, b, d) == lcs(a, b)


def test_similarity_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a = [bytes([97 + rng.randrange(6)]) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = b"new"
        x, y = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in (a, b))
        s = lcs(x, y)
        want = float(len(x) == len(y)) if not x or not y else s / (len(x) + len(y) - s)
        got = O.similarity(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def classes_of(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    words = {k: k.encode().split() for k in keys}
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if O.similarity(words[a], words[b]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [i for i in texts[k] if i is not None]
        if ids:
            least[find(k)] = min([*ids, least.get(find(k), min(ids))])
    return sorted((str(i), str(least.get(find(t or "")))) for i, t in rows)


def test_classes(docs, rows, empty):
    got = O.classes(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == classes_of(rows)
    assert O.classes(empty).count() == 0 and O.first_of_classes(empty).count() == 0


def test_one_document_stays_of_each_class(docs, rows):
    out = O.first_of_classes(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {c for _, c in classes_of(rows)}
    assert sorted(str(i) for i in kept if i is not None) == sorted([x for x in want if x != "None"] + ["10"] * (sum(r[0] == 10 for r in rows) > 1 and kept.count(10) == 2))


def test_a_crowd_with_one_line_and_a_family_of_copies(spark):
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(14))
    w = [f"w{i}" for i in range(400)]
    rows = [(i, line + " " + " ".join(rng.choices(w, k=8))) for i in range(120)]
    base = rng.choices(w, k=150)
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(w)
        rows.append((500 + i, " ".join(t)))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in O.classes(frame(spark, rows)).collect())
    assert got == classes_of(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert {got[i] for i in range(41)} == {0} and got[100] == 100 and got[201] == 200
    assert len(list(pairwise(range(3)))) == 2
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def linked_by(spark, texts, buckets):
    """Links of texts by name, with hand-made sketches: buckets {position: [groups of names]}; all else is unshared."""
    docs = frame(spark, [(i, t) for i, t in enumerate(texts.values())])
    names = dict(enumerate(texts))
    nodes = []
    for r in docs.select(O.fingerprint().alias("fp"), "doc_id").collect():
        sketch = [1_000_000 + 1000 * r["doc_id"] + i for i in range(O.SKETCHES)]
        for at, groups in buckets.items():
            for g, group in enumerate(groups):
                if names[r["doc_id"]] in group:
                    sketch[at] = 100 * at + g
        nodes.append((r["fp"], r["doc_id"], sketch))
    of = {bytes(fp): names[i] for fp, i, _ in nodes}
    found = O.links(docs, spark.createDataFrame(nodes, "fp binary, first_id long, sketch array<long>")).collect()
    return {frozenset((of[bytes(r["u"])], of[bytes(r["v"])])) for r in found}


def edited(words, places):
    return [f"{x}x" if i in places else x for i, x in enumerate(words)]


def test_a_text_linked_to_the_hub_meets_those_that_are_not(spark):
    hub = [f"w{i}" for i in range(200)]
    b = edited(hub, {20, 60, 100, 140})
    c = edited(b, {40, 80, 120, 160})
    texts = {n: " ".join(t) for n, t in {"hub": hub, "b": b, "c": c, "far": hub[::-1]}.items()}
    for crowd in (0, 4):  # a small bucket, and one of more than SMALL texts
        others = {f"o{i}": " ".join(f"o{i}v{j}" for j in range(50)) for i in range(crowd)}
        got = linked_by(spark, texts | others, {3: [["hub", "b", "c", *others]], 5: [["hub", "far"]], 7: [["hub", "far"]]})
        assert got == {frozenset(("hub", "b")), frozenset(("b", "c"))}


def test_leftovers_of_a_crowd_without_a_later_common_sketch(spark):
    b = [f"w{i}" for i in range(200)]
    others = {f"o{i}": " ".join(f"o{i}v{j}" for j in range(50)) for i in range(6)}
    texts = {"b": " ".join(b), "c": " ".join(edited(b, {40, 120}))} | others
    hub = {0: [["o0", "o1"]], 1: [["o0", "o1"]]}
    assert linked_by(spark, texts, hub | {59: [list(texts)]}) == {frozenset(("b", "c"))}


def test_texts_without_a_common_bucket_are_not_shuffled(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(2000))) for i in range(300)]
    rows += [(1000, rows[0][1] + " end"), (1001, rows[1][1] + " end"), (None, rows[2][1]), (None, rows[2][1] + " end")]
    rows += [rows[0], rows[1]]  # repeated rows
    docs = frame(spark, rows)

    def written() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in O.classes(docs).collect())
    assert written() - before < sum(len(t) for _, t in rows) / 3
    want = {"1000": "0", "1001": "1", "None": "2"}
    assert got == sorted((str(i), want.get(str(i), str(i))) for i, _ in rows)


def test_the_filter_of_fingerprints_loses_none(spark):
    fps = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("fp"), "id")
    assert O.marked(fps, fps).count() == 20_000 and O.marked(fps, fps.limit(0)).count() == 0
    few = fps.where("id % 100 = 0").drop("id")
    got = {r["id"] for r in O.marked(fps, few).collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) < 300
