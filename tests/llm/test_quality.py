import re
from collections import Counter

from conftest_llm import frame

from tessella.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark, docs, rows, empty):
    got = Q.judge(docs, labels(spark, [])).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in got) == sorted((str(i), *brute(t or "")) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"]) and r["llr"] == 0
    assert Q.judge(empty, labels(spark, [])).count() == 0


def test_junk_goes_and_clean_text_stays(spark):
    clean = [(i, f"the river {i} runs by the old mill and the people of the town walk there in the evening sun with their dogs and talk about day {i}") for i in range(40)]
    junk = [(100 + i, " ".join(f"X{j * i}!!" for j in range(60))) for i in range(1, 6)]
    df = frame(spark, clean + junk)
    lab = labels(spark, [(i, 1, 0) for i, _ in clean[:30]] + [(101, 0, 0), (None, 1, 0), (5, None, None)])
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(df, lab).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk)
    out = Q.keep(df, lab)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in clean}
    again = {r["doc_id"]: r["llr"] for r in Q.judge(df.repartition(7), lab).collect()}
    assert again == {r["doc_id"]: r["llr"] for r in Q.judge(df, lab).collect()}
