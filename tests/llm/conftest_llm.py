import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu", "ve", "xi") for b in ("ban", "cor", "dil", "fen", "gus", "hal", "jet", "kin")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=DOCS):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in ((r + ("s",))[:3] for r in rows)]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text,
    and a column whose name clashes with names that operators use."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977} ." for i in range(60_000))
    rows = [(1, "plain words here", "a"), (1, "plain words here", "a"), (2, None, "a"), (3, "", None), (4, "  \n\t", "b"), (None, "no id at all", "b"), (None, None, None), (5, long, "b"), (6, "1 2 3 !!! ???", "c"), (7, "plain words here", "c")]
    df = documents(rows)
    for name in ("key", "leaf", "line", "_s", "_drawn", "_gone", "h", "block", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df
