"""Blocking, competition, decisions and evaluation on small tables, against loops and hand-computed values."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocking as B
from tessella.operators import competition as C
from tessella.operators import contracts as K
from tessella.operators import decisions as D
from tessella.operators import evaluation as E
from tessella.operators import features as X
from tessella.operators import models as M
from tessella.operators import sampling as P
from tessella.operators.contracts import ContractError

REC = "entity_id string, business_name string, business_address string, country string"
PAIRS = "source1_entity_id string, candidate_entity_id string"
NAMES = ["acme lending group", "crystal power works", "blue river trading", "मार्केटिंग हाउस राम", "delta foods and farms", "école du nord"]


def records(spark, rows):
    return spark.createDataFrame(rows, REC)


def both_sides(spark):
    s1 = [(f"S1-{i}", n, "", "US") for i, n in enumerate(NAMES)]
    pool = [(f"S2-{i}", n.replace("group", "grp") + " ltd", "", "US") for i, n in enumerate(NAMES)] + [("S3-9", "acme lending", "", "FR")]
    return records(spark, s1), records(spark, pool)


def tokens():
    return F.split(F.concat_ws(" ", "business_name", "business_address"), " ")


def brute(q, c, k, min_df=1, max_df=1.0):
    toks = {i: Counter(n.split()) for i, n, _, _ in c}
    where = {i: x for i, _, _, x in c}
    out = []
    for country in set(where.values()):
        own = [i for i in toks if where[i] == country]
        df = Counter(t for i in own for t in toks[i])
        idf = {t: math.log((1 + len(own)) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * len(own)}

        def vec(bag):
            w = {t: n * idf[t] for t, n in bag.items() if t in idf}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1
            return {t: x / norm for t, x in w.items()}

        for i, n, _, x in q:
            if x == country:
                v = vec(Counter(n.split()))
                scores = [(-round(sum(v.get(t, 0) * y for t, y in vec(toks[j]).items()), 6), j) for j in own]
                out += [(i, j, -s, r) for r, (s, j) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "min_df", "max_df"), [(3, 1, 1.0), (1, 1, 1.0), (5, 2, 0.9)])
def test_top_k_is_dense_cosine(spark, k, min_df, max_df):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    s1 = [(f"S1-{i}", " ".join(rng.choices(words, k=4)), "", rng.choice(["US", "FR"])) for i in range(15)]
    pool = [(f"S2-{i}", " ".join(rng.choices(words, k=5)), "", rng.choice(["US", "FR"])) for i in range(30)]
    got = B.TfidfBlocker(F.split("business_name", " "), min_df, max_df).candidates(records(spark, s1), records(spark, pool), k)
    got, want = sorted(tuple(r) for r in got.select(*B.PAIR, "score", "rank").collect()), brute(s1, pool, k, min_df, max_df)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_each_query_finds_its_variant_and_countries_stay_apart(spark):
    s1, pool = both_sides(spark)
    got = B.TfidfBlocker(tokens()).candidates(s1, pool, 1).collect()
    assert {r[0][3:]: r[1][3:] for r in got} == {str(i): str(i) for i in range(len(NAMES))}
    far = records(spark, [("S1-x", "acme lending", "", "IN")])
    assert B.TfidfBlocker(tokens()).candidates(far, pool, 2).count() == 0
    assert B.TfidfBlocker(tokens(), open_set=True).candidates(far, pool, 2).first()["candidate_entity_id"] == "S3-9"


def test_reverse_exact_and_union(spark):
    s1, pool = both_sides(spark)
    back = B.reverse(B.TfidfBlocker(tokens()), s1, pool, 1)
    assert back.columns == [*B.PAIR, "rev_score", "rev_rank"] and {r["rev_rank"] for r in back.collect()} == {1}
    from tessella.functions.text import plain_name

    a = records(spark, [("S1-1", "Acme Ltd", "", "US"), ("S1-2", "", "", "US")])
    b = records(spark, [("S2-2", "ACME limited", "", "US"), ("S2-1", "acme", "", "US"), ("S2-3", "acme", "", "FR"), ("S2-4", "", "", "US")])
    exact = B.exact_candidates(a, b, plain_name(F.col("business_name")), 5)
    assert sorted((r[0], r[1], r["rank"]) for r in exact.collect()) == [("S1-1", "S2-1", 1), ("S1-1", "S2-2", 2)]
    u = B.union_channels({"x": exact, "y": exact.where("rank = 1").union(exact.where("rank = 1"))}).collect()
    assert {r["candidate_entity_id"]: r["n_channels"] for r in u} == {"S2-1": 2, "S2-2": 1}


def test_record_stats_against_a_loop(spark):
    rng = random.Random(4)
    pairs = {(f"S1-{rng.randrange(40):02d}", f"S2-{rng.randrange(60)}"): round(rng.random(), 2) for _ in range(500)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], PAIRS + ", score double")
    by = defaultdict(list)
    for (a, b), s in pairs.items():
        by[b].append((-s, a))
    want = {b: (-sorted(v)[0][0], -sorted(v)[1][0] if len(v) > 1 else None, len(v), sorted(v)[0][1]) for b, v in by.items()}
    assert {r[0]: (r["best_score"], r["second_score"], r["n_s1"], r["best_s1"]) for r in C.record_stats(df).collect()} == want
    f = {tuple(r)[:2]: r for r in C.competition_features(df, C.record_stats(df)).collect()}
    lone = next(((a, b) for (a, b) in pairs if len(by[b]) == 1), None)
    if lone:
        assert f[lone]["second_score"] == -1.0 and f[lone]["owner_gap"] == pytest.approx(pairs[lone] + 1)
    assert C.competition_features(df, C.record_stats(df).limit(0)).where("best_score <> 0").count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, PAIRS + ", p double")


def test_owners_ties_and_context(spark):
    df = scored(spark, [("S1-1", "S2-1", 0.8), ("S1-2", "S2-1", 0.8), ("S1-1", "S3-1", 0.9), ("S1-2", "S2-2", 0.4)])
    got = D.one_owner(df, 0.5)
    assert sorted(tuple(r)[:2] for r in got.collect()) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    uni = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    assert dict(map(tuple, D.id_lists(uni, got).collect())) == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": ""}
    c = {tuple(r)[:2]: r for r in C.record_context(df).collect()}
    r = c["S1-2", "S2-1"]
    assert (r["rec_n"], r["rec_sum"], r["rec_rank"], r["rec_other"], r["s1_n"], r["s1_n05"], r["s1_rank"]) == (2, 1.6, 2, 0.8, 2, 1, 1)
    assert c["S1-2", "S2-2"]["rec_other"] == 0 and c["S1-2", "S2-2"]["p_over_s1max"] == 0.5
    m = {tuple(r)[:2]: r for r in D.prob_margin(df).collect()}
    assert m["S1-1", "S2-1"]["is_prob_owner"] and m["S1-2", "S2-1"]["is_prob_owner"] and m["S1-1", "S2-1"]["prob_margin"] == 0
    assert {tuple(r)[:2] for r in D.margin_rule(df, 0.9, 0.3, 0.2).collect()} == {("S1-1", "S3-1"), ("S1-2", "S2-2")}


def test_siblings(spark):
    df = scored(spark, [("S1-1", "S2-1", 0.5), ("S1-1", "S2-2", 0.3), ("S1-1", "S2-3", 0.2), ("S1-1", "S2-4", 0.1)])
    keys = spark.createDataFrame([("S1-1", "a"), ("S2-1", "a"), ("S2-2", "a"), ("S2-3", "b"), ("S2-4", None)], "entity_id string, n string")
    got = {r[1]: (r["n_sup"], r["n_cnt"], r["n_share"], r["n_eq_s1"]) for r in C.siblings(df, keys, ["n"]).collect()}
    assert got["S2-1"] == (0.3, 1, 0.5, 1) and got["S2-3"] == (0.0, 0, 0.0, 0) and got["S2-4"] == (-1, -1, -1, 0)


def test_expected_f05_against_a_loop(spark):
    rng = random.Random(5)
    rows = {(f"S1-{rng.randrange(30):02d}", f"S2-{rng.randrange(80):02d}"): rng.choice([0.0, 0.1, 0.3, 0.5, 0.7, 0.95, 1.0]) for _ in range(250)}
    df = spark.createDataFrame([(a, b, q) for (a, b), q in rows.items()], PAIRS + ", q double")
    for bias in (-0.4, 0.0, 0.6):
        want = set()
        for s in {a for a, _ in rows}:
            own = sorted((-q, b) for (a, b), q in rows.items() if a == s)
            total, none, tp, best = -sum(q for q, _ in own), math.prod(1 - min(-q, 1 - 1e-6) for q, _ in own), 0.0, (-1.0, 0)
            for k, (q, _) in enumerate(own, 1):
                tp -= q
                best = max(best, (round(1.25 * tp / (0.25 * total + k + bias), 9), -k))
            if best[0] > round(none, 9):
                want |= {(s, b) for q, b in own[: -best[1]] if q < 0}
        assert {tuple(r)[:2] for r in D.expected_f05(df, bias).collect()} == want


def test_rule_baseline_first_of_equals_owns(spark):
    rows = [("A", "x", 1.0, 1), ("A", "z", 0.5, 2), ("B", "z", 0.9, 1), ("B", "y", 0.2, 2), ("C", "z", 0.9, 1)]
    df = spark.createDataFrame(rows, PAIRS + ", score double, rank int")
    assert sorted(tuple(r)[:2] for r in D.rule_baseline(df, 2, 0.4, 0.5).collect()) == [("A", "x"), ("B", "z")]
    assert sorted(tuple(r)[:2] for r in D.rule_baseline(df, 2, 0.4, 0.5, owner=False).collect()) == [("A", "x"), ("A", "z"), ("B", "z"), ("C", "z")]


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIRS)


def uni(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "source1_entity_id string")


def test_known_answers(spark):
    u = uni(spark, ["S1-1", "S1-2", "S1-3"])
    t = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-3", "S3-1")])
    p = pairs(spark, [("S1-1", "S2-1"), ("S1-3", "S3-1"), ("S1-1", "S2-1"), ("S1-9", "S2-7")])
    m = E.macro(E.scored_entities(u, t, p)).first()
    assert (m["macro_f05"], m["macro_precision"], m["macro_recall"]) == (round((1.25 * 0.5 / 0.75 + 2) / 3, 6), 1.0, round(2.5 / 3, 6))
    assert (m["singletons"], m["correct_singletons"], m["predicted_pairs"], m["true_pairs"]) == (1, 1, 2, 3)
    one = E.scored_entities(uni(spark, ["a"]), pairs(spark, [("a", "x"), ("a", "y")]), pairs(spark, [("a", "x"), ("a", "y"), ("a", "z")])).first()
    assert one["f05"] == pytest.approx(0.7142857)


def test_scores_against_a_loop(spark):
    rng = random.Random(6)
    t = {(f"S1-{rng.randrange(60)}", f"S2-{rng.randrange(40)}") for _ in range(90)}
    p = {(f"S1-{rng.randrange(70)}", f"S2-{rng.randrange(40)}") for _ in range(120)}
    ids = [f"S1-{i}" for i in range(60)]
    total = 0.0
    for s in ids:
        a, b = {y for x, y in t if x == s}, {y for x, y in p if x == s}
        if not a and not b:
            total += 1
        elif a & b:
            pr, re = len(a & b) / len(b), len(a & b) / len(a)
            total += 1.25 * pr * re / (0.25 * pr + re)
    got = E.macro(E.scored_entities(uni(spark, ids), pairs(spark, list(t)), pairs(spark, list(p)))).first()
    assert got["macro_f05"] == pytest.approx(total / 60, abs=1e-6)
    known = set(ids)
    e = E.error_counts(uni(spark, ids), pairs(spark, list(t)), pairs(spark, list(p)), pairs(spark, list(p))).first()
    assert e["blocking_misses"] + e["matcher_rejections"] == e["fn"] == len({x for x in t if x[0] in known} - p)


def test_blocking_measures_by_hand(spark):
    u = uni(spark, ["S1-a", "S1-b", "S1-c"])
    t = pairs(spark, [("S1-a", "S2-1"), ("S1-a", "S2-2"), ("S1-c", "S3-9")])
    c = spark.createDataFrame([("S1-a", "S2-1", 1), ("S1-a", "S2-1", 2), ("S1-x", "S2-2", 1)], PAIRS + ", rank int")
    m = E.blocking_measures(E.hits_at(u, t, c, [3])).first()
    assert m["ceiling_f05"] == round((1.25 * 0.5 / 0.75 + 1 + 0) / 3, 6) and m["recall"] == round(1 / 3, 6) and m["without_candidates"] == 2


def test_contracts(spark):
    good = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S3-1")])
    bad = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S2-1"), (" S1-1", "S2-1"), ("S1-1", None), ("X", "")])
    assert {r[0]: r[1] for r in K.candidate_violations(good).collect()} == {"bad_s1": 0, "bad_candidate": 0, "repeated_pairs": 0}
    assert {r[0]: r[1] for r in K.candidate_violations(bad).collect()} == {"bad_s1": 2, "bad_candidate": 2, "repeated_pairs": 1}
    K.require(K.id_violations(uni(spark, ["S1-1"]), "source1_entity_id", ("S1-",)), ["bad_ids", "repeated_ids"])
    with pytest.raises(K.ContractError):
        K.require(K.id_violations(uni(spark, ["S1-1", "S1-1"]), "source1_entity_id", ("S1-",)), ["bad_ids", "repeated_ids"])
    with pytest.raises(K.ContractError):
        K.columns(good, ["score"])
    s = scored(spark, [("a", "b", 0.5), ("a", "c", float("nan")), ("a", "d", 2.0), ("a", "e", None)])
    assert tuple(K.score_violations(s, "p", 0, 1).first()) == (4, 2, 1)


def test_samples(spark):
    rows = [(f"S1-{i}", "US" if i % 2 else "IN", str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "source1_entity_id string, country string, matches string")
    got = P.stratified(df, ["country", "matches"], 12).collect()
    assert len(got) == 12 and Counter((r["country"], r["matches"]) for r in got) == {(c, m): 2 for c in ("US", "IN") for m in "012"}
    assert {r[0] for r in got} == {r[0] for r in P.stratified(df.repartition(3), ["country", "matches"], 12).collect()}
    s = P.split(df)
    assert 0 < s.where("is_val").count() < 30 and s.count() == 60
    n = P.numbered(df.select("source1_entity_id", F.substring("source1_entity_id", 4, 9).cast("long").alias("at")), "at", 7).collect()
    assert sorted((r["ordinal"], r["at"]) for r in n) == [(i, i) for i in range(60)]


def test_models(spark):
    rng = random.Random(7)
    rows = [(f"S1-{i}", f"S2-{i}", x, rng.random(), int(x + 0.3 * rng.random() > 0.6)) for i in range(120) for x in [rng.random()]]
    df = spark.createDataFrame(rows, PAIRS + ", a double, b double, label int")
    for fit in (M.fit_logistic, lambda d, f: M.fit_boosted(d, f, iterations=5, depth=3, least=5)):
        p = M.predict(fit(df, ["a", "b"]), df, ["a", "b"]).collect()
        assert all(0 <= r["p"] <= 1 for r in p)
        one, two = ([r["p"] for r in p if r["label"] == k] for k in (0, 1))
        assert sum(two) / len(two) > sum(one) / len(one) + 0.2
    with pytest.raises(K.ContractError):
        M.fit_logistic(df.where("label = 1"), ["a"])
    assert M.averaged(df, ["a", "b"]).where("abs(p - (a + b) / 2) > 1e-12").count() == 0


def test_fitted_models_are_saved_with_their_features(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{i}", i / 40, (i * 7 % 40) / 40, int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, a double, b double, label int")
    model = M.fit_logistic(df, ["a", "b"])
    for _ in range(2):
        M.save_fitted(model, ["a", "b"], str(tmp_path / "fitted"))
    again, features = M.load_fitted(str(tmp_path / "fitted"), ["a", "b"])
    assert features == ["a", "b"]
    p = lambda m: [r["p"] for r in M.predict(m, df, features).orderBy("a").collect()]
    assert p(again) == p(model)
    with pytest.raises(K.ContractError):
        M.load_fitted(str(tmp_path / "fitted"), ["b", "a"])


def test_pairs_without_records(spark):
    rec = spark.createDataFrame([("S1-1", "a"), ("S2-1", "b")], "entity_id string, business_name string")
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-9")], "source1_entity_id string, candidate_entity_id string")
    assert [r["b"]["business_name"] for r in X.Records(rec).joined(pairs.limit(1)).collect()] == ["b"]
    assert X.Records(rec, strict=False).joined(pairs).count() == 1
    with pytest.raises(Exception, match="no record of S2-9"):
        X.sides(pairs, rec).collect()


def test_named_blockers(spark):
    rec = spark.createDataFrame([("S1-1", "red fox"), ("S2-1", "red fox"), ("S2-2", "blue fox"), ("S3-3", None)], "entity_id string, business_name string").selectExpr("*", "'US' AS country")
    index = B.named_blocker("d2", ["business_name"], min_df=1).build_index(rec.where("entity_id > 'S2'"))
    got = index.candidates(rec.where("entity_id < 'S2'"), 5).orderBy("rank").collect()
    assert [r["candidate_entity_id"] for r in got] == ["S2-1", "S2-2"] and abs(got[0]["score"] - 1) < 1e-6
    assert B.named_blocker("word", ["business_name"], min_df=1).candidates(rec.where("entity_id < 'S2'"), rec.where("entity_id > 'S2'"), 1).count() == 1
    with pytest.raises(KeyError, match="no blocker"):
        B.named_blocker("none", [])
    with pytest.raises(ValueError):
        B.register("d2", B.BLOCKERS["d2"])


def test_second_stage_columns(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9, 1, 0.8), ("S1-1", "S2-2", 0.5, 2, 0.4)], "source1_entity_id string, candidate_entity_id string, score double, rank int, p double")
    keyed = spark.createDataFrame([("S1-1", "1", "x", "a", "1 2"), ("S2-1", "1", "x", "a", "1 2"), ("S2-2", "1", "", "b", "3")], "entity_id string, n1 string, nn string, na string, nums string")
    kept = pairs.limit(1).select("source1_entity_id", "candidate_entity_id", *[F.lit(0.5).alias(c) for c in X.KEPT])
    out = X.second_stage(pairs, keyed, kept)
    assert X.require_schema(out.select("source1_entity_id", "candidate_entity_id", *X.SECOND_STAGE), X.SECOND_STAGE) is not None and len(X.SECOND_STAGE) == 40
    a, b = out.orderBy("rank").collect()
    assert (a["n1_sup"], a["n1_cnt"], a["n1_eq_s1"], b["nn_sup"], b["na_eq_s1"], b["n_tset"]) == (0.4, 1, 1, -1.0, 0, None)
    with pytest.raises(ContractError, match="differ"):
        X.require_schema(out, X.SECOND_STAGE)


def test_biases_agree_with_one_rule_each(spark):
    rows = [(f"S1-{i % 7}", f"S2-{i % 11}", ((i * 37) % 101) / 101) for i in range(77)]
    pairs = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, p double")
    truth = pairs.where("p > 0.6").select("source1_entity_id", "candidate_entity_id")
    uni = pairs.select("source1_entity_id").distinct()
    got = {(r["bias"], r["owner"]): (r["f05"], r["n_pairs"]) for r in D.bias_sweep(pairs, truth, uni, [-0.5, 0.5]).collect()}
    for (bias, owner), (f05, n) in got.items():
        kept = D.select(pairs, D.Rule("p", "efo", bias, owner))
        assert n == kept.count() and abs(f05 - E.macro(E.scored_entities(uni, truth, kept)).first()["macro_f05"]) < 1e-6
