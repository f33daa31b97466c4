"""Documents for the operators' tests: words, copies, near copies, nulls, long texts and clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=800):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_docs(seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append([i, sentence(rng, rng.randrange(5, 120)), "en", f"s{i % 4}"])
    base = sentence(rng, 150)
    for i in range(60, 75):  # near copies of one text
        words = base.split()
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append([i, " ".join(words), "en", "s0"])
    rows += [[75, rows[3][1], "en", "s1"], [76, rows[3][1].upper(), "en", "s1"], [77, None, None, None], [78, "", "en", ""], [79, " \n\t ", "en", "s1"], [80, "one two", "en", "s1"], [81, "One  TWO", "fr", "s2"], [82, sentence(rng, 20000), "en", "s3"]]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
