import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", block string, list string, copy long, mix_key string, fp string, rows long, score string, label string, _u string, _source string, own_fp string, held_out string, _block_of_text string, packed string"


def frame(spark, rows, extra=False):
    """documents of (doc_id, text); extra columns have names that operators use inside."""
    full = [(i, t, "en", None if i is None else f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    if extra:
        full = [(*r, "x", "y", 7, "k", "f", 3, "s", "l", "u", "o", "p", "h", "b", "z") for r in full]
    return spark.createDataFrame(full, SCHEMA + (EXTRA if extra else ""))


def corpus(n=60, seed=1):
    """Documents with shared passages, near and exact copies, repeated lines, and texts of all sizes."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    passages = [" ".join(rng.choices(words, k=k)) for k in (13, 14, 30, 60)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.randint(20, 160)))
        if i % 4 == 0:
            cut = rng.randint(0, len(t))
            t = t[:cut] + " " + rng.choice(passages) + " " + t[cut:]
        if i % 9 == 0 and i:
            t = rows[i // 2][1]
        if i % 9 == 1 and i > 1:
            w = rows[i // 2][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i * 3 + 1, t))
    edge = ["", None, " \n\t ", "one", "a " * 40, "ß é 日本語  x  y", "line one\nline one\nline two", "word " * 3000]
    return rows + [(1000 + i, t) for i, t in enumerate(edge)] + [(None, "a text without an id"), (None, None), rows[0], rows[0], (rows[3][0], "another text with the id of one before it")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows, extra=True).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
