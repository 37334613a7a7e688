"""Small corpora with every awkward row."""

import random

import pytest

WORDS = ["the", "of", "and", "Alpha", "beta,", "gamma.", "delta", "épée", "naïve", "x1", "Über", "foo-bar", "zeta", "eta", "theta", "iota"]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: copies, near copies, shared passages, ties, repeated rows, nulls, empty, blank, short and long texts."""
    rnd = random.Random(5)
    passage = text(rnd, 60)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "two words"), (5, "two words"), (6, "a b c d"), (7, "A B C D"), (8, text(rnd, 5)), (9, text(rnd, 30000)), (10, "x" * 200_000)]
    for _ in range(8):
        base = text(rnd, rnd.randrange(30, 120)).split(" ")
        for _ in range(rnd.randrange(2, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(1000))
            rows.append((len(rows), " ".join(w)))
    for _ in range(25):
        rows.append((len(rows), text(rnd, 20) + " " + passage + "\n" + text(rnd, rnd.randrange(3, 40))))
    for _ in range(6):
        rows.append((len(rows), passage))
    rows += [rows[20], rows[20], (21, text(rnd, 12)), (None, text(rnd, 15)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1.0, 7, b"z") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, id int, ids binary").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
