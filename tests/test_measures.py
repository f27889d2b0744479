import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import measures

RNG = random.Random(5)
TEXTS = ["", "x", "ab", "the cat", "the the cat sat", "a  b\n a", "äöü", "日本 語", "x y"] + ["".join(RNG.choice("ab cé\n") for _ in range(RNG.randrange(1, 30))) for _ in range(20)]
PAIRS = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]


def words(t):
    return t.lower().split()


def tfidf(a, b, idf=True):
    x, y = Counter(words(a)), Counter(words(b))
    if not x or not y:
        return 1.0 if not x and not y else 0.0
    w = {t: max(math.log(2 / ((t in x) + (t in y))), 0) + 1 if idf else 1 for t in x | y}
    dot = sum(x[t] * y[t] * w[t] ** 2 for t in x)
    return min(1, dot / math.sqrt(sum((x[t] * w[t]) ** 2 for t in x)) / math.sqrt(sum((y[t] * w[t]) ** 2 for t in y)))


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def ngram(a, b):
    x, y = a.encode(), b.encode()
    if len(x) < 3 and len(y) < 3:
        return 1.0
    if not x or not y:
        return 0.0

    def windows(r):
        out = set()
        for i in range(len(r) - 2):
            try:
                out.add(r[i : i + 3].decode())
            except UnicodeDecodeError:
                pass
        return out

    return jaccard(windows(x), windows(y))


def dice(a, b):
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total())


BRUTE = {"jaccard": lambda a, b: jaccard(set(words(a)), set(words(b))), "cosine": lambda a, b: tfidf(a, b, False), "tfidf": tfidf, "ngram": ngram, "sorensen-dice": dice}


@pytest.mark.parametrize("name", BRUTE)
def test_bags(spark, name):
    df = spark.createDataFrame(PAIRS, "id int, a string, b string")
    got = {r.id: r.score for r in measures.bag_similarity(df, ["id"], "a", "b", name).collect()}
    assert len(got) == len(PAIRS)
    for i, a, b in PAIRS:
        assert got[i] == pytest.approx(BRUTE[name](a, b), abs=1e-9), (a, b)


def test_null_texts_are_empty(spark):
    df = spark.createDataFrame([(1, None, ""), (2, None, "abcd")], "id int, a string, b string")
    for name in BRUTE:
        assert {r.id: r.score for r in measures.bag_similarity(df, ["id"], "a", "b", name).collect()} == {1: 1.0, 2: 0.0}
        assert measures.bag_similarity(df.limit(0), ["id"], "a", "b", name).count() == 0


def test_positions_and_edits(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c", "d"], "kitten", "sitting"), ([], [], "", ""), ([], ["x"], "", "x")], "x array<string>, y array<string>, a string, b string")
    got = [tuple(round(v, 6) for v in r) for r in df.select(measures.hamming(F.col("x"), F.col("y")), measures.levenshtein(F.col("a"), F.col("b")), measures.damerau(F.col("a"), F.col("b")), measures.smith_waterman(F.col("x"), F.col("y"))).collect()]
    assert got == [(0.333333, 0.571429, 0.571429, 0.5), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)]
