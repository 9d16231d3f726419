"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = [a + b for a in ("al", "be", "cor", "din", "es", "fu", "gra", "hol") for b in ("a", "em", "is", "on", "ut", "ra")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows: originals, exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(11)
    shared = prose(rng, 60)
    rows = []
    for i in range(60):
        kind = i % 6
        own = "\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 4)))
        if kind == 1:
            own = own + "\n" + shared
        elif kind == 2 and rows:
            own = rows[-1][1]
        elif kind == 3 and rows:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            own = " ".join(words)
        rows.append((i, own))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One"), (105, "x " * 30_000), (None, rows[5][1]), (107, "é" * 250), (108, "é" * 250)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows, one of them repeated, with columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, 2.0, "k") for i, t in [*texts, texts[7]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, score double, text_key string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def ordered(rows):
    """Rows in one order, nulls first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
