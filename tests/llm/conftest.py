"""A table with every awkward row: nulls, empty and long texts, ties, copies, repeated rows, clashing columns."""

import random

import pytest

LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, score double, hits string, id_key string, block string"


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "é", "ÄÖ", "日本", "x1", "#tag", "a&b"]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = words(70)
    texts = [None, "", " \n\t ", "one", "one two", "one two three", "One Two Three", "line a\nline a\n\nline a\n", "x" * 5000, words(9000)]
    base = words(200)
    texts += [base, base, base.upper(), base + " tail", "head " + base, base.replace("w1 ", "q1 ", 1)]
    texts += [f"{words(30)} {passage} {words(30)}" for _ in range(6)]
    texts += ["\n".join(words(6) for _ in range(8)) for _ in range(6)]
    texts += [f"{words(12)}\nshared line of all pages here\n{words(5)}" for _ in range(14)]
    texts += [words(r.randint(1, 120)) for _ in range(n - len(texts))]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t, "en", r.choice(["s1", "s2", "s3", None]), len(t or ""), 5, 7, 0.5, "h", "k", "b") for i, t in zip(ids, texts, strict=True)]
    # Repeated rows, and a row without an id.
    return [*rows, rows[10], rows[20], rows[4], (None, "no id here " + words(60), None, "s1", 3, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, LAYOUT).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], LAYOUT)


def sort_key(x):
    return tuple((v is None, v) for v in x)


@pytest.fixture(scope="session")
def same():
    def check(df, wanted):
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=sort_key) == sorted(wanted, key=sort_key)

    return check
