"""Alignments of two sequences of lines or characters, as Arrow functions.

Only what depends on order beyond neighbours is here. Lines are interned to numbers
once; the longest common subsequence is bit-parallel over Python's long integers
(Crochemore et al. 2001), so a line of one text costs one pass over a bit vector of the
other. One function returns score, script and diff together, so nothing runs twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .distance import edit_distances

SW_LIMIT, LCS_LIMIT = 2000, 5000


def _masks(b: Sequence) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | (1 << j)
    return out


def _row(v: int, m: int, full: int) -> int:
    u = v & m
    return ((v + u) | (v - u)) & full


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    lo = 0
    n = min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    full = (1 << len(b)) - 1
    v, masks = full, _masks(b)
    for x in a:
        v = _row(v, masks.get(x, 0), full)
    return lo + hi + len(b) - v.bit_count()


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """A shortest script as (tag, index in a, index in b), tag one of ``= - +``; deletions
    stand before insertions. Rows are kept every sqrt(len(a)) lines and filled in again
    on the way back, so memory stays at two such blocks."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    full, masks = (1 << len(y)) - 1, _masks(y)
    step = max(1, math.isqrt(len(x)))
    kept, v = [full], full
    for i, c in enumerate(x, 1):
        v = _row(v, masks.get(c, 0), full)
        if i % step == 0:
            kept.append(v)
    back: list[tuple[str, int, int]] = []
    i, j, block, rows = len(x), len(y), -1, []
    while i or j:
        if not i:
            j -= 1
            back.append(("+", lo, lo + j))
        elif not j:
            i -= 1
            back.append(("-", lo + i, lo))
        elif x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            back.append(("=", lo + i, lo + j))
        else:
            k = (i - 1) // step
            if k != block:
                block, v, rows = k, kept[k], []
                for c in x[k * step : (k + 1) * step]:
                    v = _row(v, masks.get(c, 0), full)
                    rows.append(v)
            if (rows[i - 1 - k * step] >> (j - 1)) & 1:  # y[j - 1] adds nothing in this row
                j -= 1
                back.append(("+", lo + i, lo + j))
            else:
                i -= 1
                back.append(("-", lo + i, lo + j))
    head = [("=", k, k) for k in range(lo)]
    tail = [("=", len(a) - hi + k, len(b) - hi + k) for k in range(hi)]
    return head + back[::-1] + tail


def encode_ranges(positions: Sequence[int]) -> str:
    """``1-3,5`` for ascending positions."""
    out, i = [], 0
    while i < len(positions):
        j = i
        while j + 1 < len(positions) and positions[j + 1] == positions[j] + 1:
            j += 1
        out.append(str(positions[i]) if i == j else f"{positions[i]}-{positions[j]}")
        i = j + 1
    return ",".join(out)


def _span(start: int, count: int) -> str:
    if count == 1:
        return str(start + 1)
    return f"{start + 1 if count else start},{count}"


def unified_diff(a: Sequence[str], b: Sequence[str], name_a: str, name_b: str, limit: int = 1 << 20, context: int = 3, script=None) -> tuple[str, bool]:
    """(diff, whether it was cut): hunks with ``context`` lines around changes; once the
    text has ``limit`` bytes it stops with a note."""
    script = edit_script(a, b) if script is None else script
    changed = [k for k, s in enumerate(script) if s[0] != "="]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][1] <= 2 * context:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    parts = [f"--- {name_a}\n+++ {name_b}\n"]
    size, cut = len(parts[0].encode()), False
    for first, last in groups:
        if size >= limit:
            cut = True
            break
        ops = script[max(0, first - context) : last + context + 1]
        na, nb = sum(o[0] != "+" for o in ops), sum(o[0] != "-" for o in ops)
        rows = [f"@@ -{_span(ops[0][1], na)} +{_span(ops[0][2], nb)} @@\n"]
        size += len(rows[0])
        for tag, i, j in ops:
            if size >= limit:
                cut = True
                break
            rows.append({"=": " ", "-": "-", "+": "+"}[tag] + (b[j] if tag == "+" else a[i]) + "\n")
            size += len(rows[-1].encode())
        parts += rows
        if cut:
            break
    return "".join(parts) + ("\n... [diff truncated] ...\n" if cut else ""), cut


def diff_ratio(n: int, m: int, common: int) -> float:
    return common / (n + m - common) if n + m else 1.0


def line_ratio(n: int, m: int, common: int) -> float:
    return 2 * common / (n + m) if n + m else 1.0


def lcs_similarity(a: Sequence, b: Sequence, common: int | None = None) -> float:
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    common = lcs_length(a, b) if common is None else common
    return line_ratio(n, m, common) if max(n, m) > LCS_LIMIT else common / max(n, m)


def smith_waterman(a: Sequence, b: Sequence, match: int = 2, mismatch: int = -1, gap: int = -1) -> float:
    """Best local alignment score over that of the shorter side, 1 at most; from
    ``SW_LIMIT`` lines on the ratio of common lines."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if max(n, m) > SW_LIMIT:
        return line_ratio(n, m, lcs_length(a, b))
    codes: dict = {}
    x = np.array([codes.setdefault(c, len(codes)) for c in a])
    y = np.array([codes.setdefault(c, len(codes)) for c in b])
    ramp = -gap * np.arange(m + 1)
    h, best = np.zeros(m + 1, np.int64), 0
    for c in x:
        row = np.zeros(m + 1, np.int64)
        np.maximum(h[:-1] + np.where(y == c, match, mismatch), h[1:] + gap, out=row[1:])
        np.maximum(row, 0, out=row)
        h = np.maximum.accumulate(row + ramp) - ramp
        best = max(best, int(h.max()))
    return min(1.0, best / (match * min(n, m)))


def _matched(a: str, b: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text that Jaro's measure matches, in order: each of a takes the first
    free equal one of b within ``reach``. Per character this is a queue: the places of b taken or
    passed after the t-th one of a are p[t] = min(high[t], max(p[t - 1], low[t]) + 1), with the
    numbers of places before and up to its reach. In r[t] = p[t] - t that is a clamp, and clamps of
    neighbours compose, so all characters of all places are found in log(length) rounds."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    small = np.uint16 if max(x.max(), y.max()) < 1 << 16 else np.uint32  # 16 bits are sorted by radix
    o, q = (np.argsort(s.astype(small), kind="stable") for s in (x, y))
    c, span = x[o].astype(np.int64), 1 << 34  # places are less; one number orders (character, place)
    places = y[q].astype(np.int64) * span + q
    first = np.searchsorted(places, c * span)
    low = np.searchsorted(places, c * span + np.maximum(o - reach, 0)) - first
    high = np.searchsorted(places, c * span + np.minimum(o + reach, span - 1), side="right") - first
    start = np.append(True, c[1:] != c[:-1])
    t = np.arange(len(c))
    t = t - np.maximum.accumulate(np.where(start, t, 0)) + 1
    top = high - t
    bottom = np.minimum(low - t + 1, top)
    r0 = np.minimum(top, np.maximum(low - t + 1, 0))  # p = 0 before the first of a character
    bottom, top = np.where(start, r0, bottom), np.where(start, r0, top)
    step, longest = 1, int(t.max())
    while step < longest:
        ok = t[step:] > step
        l, h = bottom[:-step], top[:-step]
        lo, hi = bottom[step:], top[step:]
        bottom, top = bottom.copy(), top.copy()
        bottom[step:] = np.where(ok, np.minimum(np.maximum(l, lo), hi), lo)
        top[step:] = np.where(ok, np.minimum(np.maximum(h, lo), hi), hi)
        step *= 2
    p = bottom + t
    before = np.where(start, 0, np.append(0, p[:-1]))
    at = np.maximum(before, low)
    ok = np.flatnonzero(at < high)
    i, j = o[ok], q[first[ok] + at[ok]]
    return x[np.sort(i)], y[np.sort(j)]


def jaro_winkler(a: str, b: str, scale: float = 0.1, prefix: int = 4, floor: float = 0.7) -> float:
    """Winkler (1990); the prefix counts from a Jaro similarity over ``floor`` on."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    x, y = _matched(a, b, max(0, max(n, m) // 2 - 1))
    k = len(x)
    if not k:
        return 0.0
    swaps = int(np.count_nonzero(x != y)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    same = 0
    while same < min(prefix, n, m) and a[same] == b[same]:
        same += 1
    return jaro + same * scale * (1 - jaro) if jaro > floor else jaro


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with transpositions of neighbours, unrestricted (Lowrance and Wagner 1975)."""
    return edit_distances([(a, b)], swaps=True)[0]


def _byte_windows(raw: bytes) -> np.ndarray:
    """Distinct runs of three bytes that begin and end between characters."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    edge = np.append((x & 0xC0) != 0x80, True)
    y = x.astype(np.uint32)
    return np.unique(((y[:-2] << 16) | (y[1:-1] << 8) | y[2:])[edge[:-3] & edge[3:]])


def ngram_similarity(a: str, b: str) -> float:
    """Shared over all distinct byte windows of three that are valid UTF-8."""
    x, y = a.encode(), b.encode()
    if len(x) < 3 and len(y) < 3:
        return 1.0
    if not x or not y:
        return 0.0
    p, q = _byte_windows(x), _byte_windows(y)
    both = len(np.intersect1d(p, q, assume_unique=True))
    union = len(p) + len(q) - both
    return both / union if union else 1.0


def normalized(distance: int, n: int, m: int) -> float:
    return 1 - distance / max(n, m) if n or m else 1.0


COMPARED = "common long, only1 long, only2 long, positions string, score double, diff string, truncated boolean"


def compare_lines(a: Sequence[str], b: Sequence[str], algorithm: str, name_a: str, name_b: str, limit: int, with_diff: bool = True):
    """One pair: counts, changed positions, the score where it hangs on order, and the diff."""
    script = edit_script(a, b)
    common = sum(s[0] == "=" for s in script)
    n, m = len(a), len(b)
    score = None
    if algorithm == "diff":
        score = diff_ratio(n, m, common)
    elif algorithm == "ratcliff-obershelp":
        score = line_ratio(n, m, common)
    elif algorithm == "lcs":
        score = lcs_similarity(a, b, common)
    elif algorithm == "smith-waterman":
        score = smith_waterman(a, b)
    elif algorithm == "char-jaro":
        score = jaro_winkler("\n".join(a), "\n".join(b))
    elif algorithm == "damerau-levenshtein":
        x, y = "\n".join(a), "\n".join(b)
        score = normalized(damerau_levenshtein(x, y), len(x), len(y))
    diff, cut = unified_diff(a, b, name_a, name_b, limit, script=script) if with_diff else (None, False)
    where = encode_ranges([k for k, s in enumerate(script) if s[0] != "="])
    return common, n - common, m - common, where, score, diff, cut


def comparer(algorithm: str, limit: int = 1 << 20, with_diff: bool = True):
    """Arrow function (lines1, lines2, name1, name2) -> struct of ``COMPARED``."""

    @F.pandas_udf(COMPARED)
    def run(l1: pd.Series, l2: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.DataFrame:
        rows = [compare_lines(list(a), list(b), algorithm, x, y, limit, with_diff) for a, b, x, y in zip(l1, l2, n1, n2)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COMPARED.split(", ")])

    return run


def _each(f):
    """Arrow function of ``f``, a pair of a batch at a time: only the batch and one pair are in memory."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b))
        return pa.array([None if x is None or y is None else float(f(x, y)) for x, y in pairs], pa.float64())

    return run


def _double(f):
    """Column function of ``f``; the UDF is made when called, as workers import this module too."""
    def of(a: Column, b: Column) -> Column:
        return F.arrow_udf(_each(f), "double")(a, b)

    return of


jaro_winkler_udf = _double(jaro_winkler)
lcs_length_udf = _double(lcs_length)
smith_waterman_udf = _double(smith_waterman)
ngram_udf = _double(ngram_similarity)
