"""Measures over characters on whole texts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.config import java_pattern, line_filter
from pairloom.functions import sequence as sq
from pairloom.operators import measures

RNG = random.Random(3)
TEXTS = ["", "x", "one line\n", "one line\r\ntwo lines\n", "äöü ß\n日本 語", "ca", "abc", "abcdef", "abdcfe"] + [
    "".join(RNG.choice("abc dé\n") for _ in range(RNG.randrange(2, 90))) for _ in range(14)
]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def damerau(a, b):
    """The whole table, as published."""
    last, far = {}, len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1] = [far, *range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        col = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), col
            if x == y:
                col = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[x] = i
    return d[-1][-1]


def jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    k, swaps = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(used))) // 2
    jaro = (k / len(a) + k / len(b) + (k - swaps) / k) / 3
    same = next((n for n in range(5) if a[:n] != b[:n] or n > min(len(a), len(b))), 5) - 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_measures_over_whole_texts(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    got = {r.id: r for r in df.select("id", *[f(F.col("a"), F.col("b")).alias(n) for n, f in (("l", measures.levenshtein), ("d", measures.damerau), ("j", measures.jaro_winkler))]).collect()}
    for i, a, b in pairs:
        top = max(len(a), len(b)) or 1
        assert got[i].l == pytest.approx(1 - levenshtein(a, b) / top)
        assert got[i].d == pytest.approx(1 - damerau(a, b) / top)
        assert got[i].j == pytest.approx(jaro_winkler(a, b))


def test_distance_of_long_texts_in_bounded_memory():
    import tracemalloc

    a = "".join(RNG.choice("abcdefg hij") for _ in range(2500))
    b = "".join(RNG.choice("abcdefg hij") for _ in range(2500))
    tracemalloc.start()
    sq.damerau_levenshtein(a, b)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("pattern,java", [(r"\p{L}+", r"\p{L}+"), (r"x\z", r"x\z"), ("[*+]", "[*+]"), ("(?P<y>[0-9]+)", "(?<y>[0-9]+)"), ("[[:digit:]_]", r"[\p{Digit}_]"), ("[]a]", r"[\]a]"), (r"\(?=", r"\(?=")])
def test_patterns_are_rewritten(spark, pattern, java):
    assert java_pattern(pattern) == java == line_filter(pattern)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "(?>a)", r"(a)\1", r"(?P<x>a)\k<x>", "a++", "[[:nope:]]", "([a"])
def test_patterns_are_refused(spark, pattern):
    with pytest.warns(UserWarning):
        assert line_filter(pattern) is None
