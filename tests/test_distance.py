"""Edit distances by bit vectors against the table filled cell by cell."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pairloom.functions import distance
from pairloom.operators import measures


def plain(a, b, swaps):
    """Lowrance and Wagner, cell by cell."""
    far, n, m = len(a) + len(b), len(a), len(b)
    last, d = {}, [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        seen = 0
        for j in range(1, m + 1):
            l, k = last.get(b[j - 1], 0), seen
            if a[i - 1] == b[j - 1]:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1)
            if swaps:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], d[l][k] + i - l - 1 + 1 + j - k - 1)
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


def cases(seed):
    r = random.Random(seed)
    out = [("", ""), ("", "xy"), ("ca", "abc"), ("ab", "ba"), ("a" * 64, "a" * 65), None, ("\U0001f600x\n", "x\U0001f600")]
    for _ in range(60):
        letters = "abcdefghij\n é\U0001f600"[: r.choice((2, 3, 14))]
        a = "".join(r.choices(letters, k=r.choice((1, 9, 63, 64, 65, 129))))
        b = list(a) if r.random() < 0.6 else r.choices(letters, k=r.choice((1, 9, 63, 64, 128)))
        for _ in range(r.randint(0, 12)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.choice((0, 2, 3))] = b[i : i + 2][::-1] + r.choices(letters, k=r.choice((0, 0, 1)))
        out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("words, steps, dense", [(16384, 192, 1 << 22), (2, 5, 1 << 22), (4, 64, 16)])
@pytest.mark.parametrize("swaps", [False, True])
def test_against_the_table(monkeypatch, words, steps, dense, swaps):
    for name, v in (("WORDS", words), ("STEPS", steps), ("DENSE", dense)):
        monkeypatch.setattr(distance, name, v)
    x = cases(words)
    assert distance.edit_distances(x, swaps) == [None if p is None else plain(*p, swaps) for p in x]


def test_long_texts_take_seconds():
    """a pair of 40,000 characters took minutes with transpositions, filled a row at a time."""
    r = random.Random(3)
    a, b = ("".join(r.choices("abcdefghijklmnopqrstuvwxyz ,.ABCD", k=40_000)) for _ in range(2))
    began = time.process_time()
    one, two = (distance.edit_distances([(a, b)], s)[0] for s in (False, True))
    assert 20_000 < two <= one < 40_000 and time.process_time() - began < 60


def test_columns(spark):
    df = spark.createDataFrame([(k, *(p or (None, "x"))) for k, p in enumerate(cases(1))], "k long, a string, b string")
    got = {r.k: r for r in df.select("k", "a", "b", measures.text_levenshtein(F.col("a"), F.col("b")).alias("l"), measures.levenshtein(F.col("a"), F.col("b")).alias("w"), measures.damerau(F.col("a"), F.col("b")).alias("d")).collect()}
    for r in got.values():
        if r.a is not None:
            top = max(len(r.a), len(r.b))
            assert r.l == r.w and r.d == (1 - plain(r.a, r.b, True) / top if top else 1.0)
