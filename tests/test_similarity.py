import random

import duckdb
import pytest

from tessella.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_against_tables():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert S.common_subsequence(a, b) == lcs(a, b)
        if a or b:
            assert S.ratio_score(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_partial_ratio_is_the_best_stretch():
    assert S.partial_score("abc", "xxabcxx") == 100
    assert S.partial_score("", "") == 100 and S.partial_score("", "a") == 0
    assert S.partial_score("abcd", "zzabc") == pytest.approx(200 * 3 / 7)


def test_token_ratios():
    assert S.token_sort_score("b a", "a b") == 100
    assert S.token_set_score("acme", "acme holdings") == 100
    assert S.token_set_score("", "a") == 0
    assert S.token_differences("crystal lending", "crystl lending group") == (1, 0, 5)
    assert S.token_differences("", "a bc") == (2, 0, 3)


def test_jaro_winkler_against_sql():
    rng = random.Random(2)
    pairs = [("abcd", "abxyzw"), ("", "a"), ("same", "same"), ("martha", "marhta")] + [tuple("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(2)) for _ in range(200)]
    for a, b in pairs:
        want = duckdb.sql(f"SELECT jaro_winkler_similarity('{a}', '{b}')").fetchall()[0][0]
        assert S.jaro_winkler_score(a, b) == pytest.approx(want, abs=1e-9), (a, b)


def test_guards(spark):
    from pyspark.sql import functions as F

    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([("", "x"), ("ab", "abcd")], "a string, b string")
    got = df.select(S.levenshtein_similarity(a, b), S.length_ratio(a, b), S.jaccard(F.array_distinct(F.split(a, "")), F.split(b, "")), S.f05(F.lit(0.0), F.lit(0.0)), S.unit(F.lit(7.0)), S.guarded(F.lit(1.0), F.lit(0.0))).collect()
    assert tuple(got[1])[:2] == (0.5, 0.5) and tuple(got[0])[:2] == (0.0, 0.0) and got[0][3] == 0.0 and got[0][4] == 1.0 and got[0][5] == 1e6
