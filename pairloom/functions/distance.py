"""Edit distances of whole texts by bit vectors, many pairs at a time.

A column of the table of distances is kept as its differences, a bit a character (Myers 1999,
Hyyro 2003), in words of 64. A word needs the carries of the word before in the same row, so it
runs one step behind: at each step all words of all pairs in hand do one row each, as one numpy
operation. Transpositions are unrestricted (Lowrance and Wagner 1975): of those only the ones
with nothing between on one side can be best, since others cost no less than substitutions,
and these follow from the same bits by a flood along the column or a register along the row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

WORDS, STEPS = 16384, 192  # words in hand, and steps between looks at what has ended
DENSE = 1 << 22  # entries of a table of masks; a pair with more looks its masks up
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _stripped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what both begin and end with: it costs nothing."""
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    lo = int(d[0]) if len(d) else n
    a, b, n = a[lo:], b[lo:], n - lo
    d = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    hi = n - 1 - int(d[-1]) if len(d) else n
    return a[: len(a) - hi], b[: len(b) - hi]


@dataclass
class _Pair:
    """``steps``: of each character of the shorter text, its row of masks times words (0: in none of
    the longer); keys and masks: the longer text's masks that aren't 0, by row and word."""

    number: int
    length: int
    words: int
    rows: int
    steps: np.ndarray
    keys: np.ndarray
    masks: np.ndarray
    done: int = 0
    distance: int = 0


def _pair(number: int, a: np.ndarray, b: np.ndarray) -> _Pair:
    """Of the texts, neither empty, the longer one as bits."""
    if len(a) > len(b):
        a, b = b, a
    words = -(-len(b) // 64)
    known = np.unique(a)
    row = np.searchsorted(known, b)
    row[row == len(known)] = 0
    at = np.flatnonzero(known[row] == b)
    key = (row[at] + 1) * words + (at >> 6)
    o = np.argsort(key, kind="stable")
    key, bit = key[o], np.left_shift(_ONE, (at[o] & 63).astype(np.uint64))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    masks = np.bitwise_or.reduceat(bit, first) if len(key) else bit
    return _Pair(number, len(b), words, len(known) + 1, (np.searchsorted(known, a) + 1) * words, key[first], masks)


class _Hand:
    """The pairs in hand, their words side by side."""

    NAMES = ("vp", "vn", "hp_in", "hn_in", "row")
    SWAPS = (*NAMES, "off", "mask", "reg", "off_in", "seed_in", "mask_in")

    def __init__(self, swaps: bool):
        self.swaps, self.pairs, self.state = swaps, [], {}

    def change(self, out: list[bool], new: list[_Pair]) -> None:
        """Drops the pairs marked in ``out`` and takes ``new`` ones."""
        names = self.SWAPS if self.swaps else self.NAMES
        stay = ~np.repeat(np.array(out, bool), [p.words for p in self.pairs]) if self.pairs else np.zeros(0, bool)
        size = sum(p.words for p in new)
        for c in names:
            kind = np.int64 if c == "row" else np.uint64
            old = self.state.get(c, np.zeros(0, kind))[stay]
            more = np.zeros(size, kind)
            if c == "vp":
                more[:] = ~np.uint64(0)
            self.state[c] = np.concatenate([old, more])
        self.pairs = [p for p, x in zip(self.pairs, out) if not x] + new
        words = np.array([p.words for p in self.pairs], np.int64)
        self.first = np.cumsum(words) - words
        self.last = self.first + words - 1
        self.state["hp_in"][self.first] = 1
        self.bit = np.array([(p.length - 1) & 63 for p in self.pairs], np.uint64)
        rows = np.array([p.rows for p in self.pairs], np.int64)
        sizes = words * rows
        self.dense = bool((sizes <= DENSE).all())
        starts = np.cumsum(sizes) - sizes
        self.base = np.repeat(starts - self.first, words) + np.arange(int(words.sum()))
        self.keys = np.concatenate([p.keys + s for p, s in zip(self.pairs, starts)] or [np.zeros(0, np.int64)])
        self.masks = np.concatenate([p.masks for p in self.pairs] or [np.zeros(0, np.uint64)])
        if self.dense:
            self.table = np.zeros(int(sizes.sum()), np.uint64)
            self.table[self.keys] = self.masks

    def _lookup(self, at: np.ndarray, out: np.ndarray) -> None:
        if self.dense:
            np.take(self.table, at, out=out, mode="clip")
            return
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        out[:] = np.where(self.keys[i] == at, self.masks[i], np.uint64(0)) if len(self.keys) else 0

    def run(self, steps: int) -> None:
        first, last, n, swaps = self.first, self.last, len(self.base), self.swaps
        into = np.zeros((steps, len(self.pairs)), np.int64)
        for k, p in enumerate(self.pairs):
            x = p.steps[p.done : p.done + steps]
            into[: len(x), k] = x
        ups, downs = np.empty((2, steps, len(self.pairs)), np.uint64)
        s = self.state
        vp, vn, hp_in, hn_in, row = (s[c] for c in self.NAMES)
        at, moved = np.empty(n, np.int64), np.empty(n, np.int64)
        e, d, hp, hn, t = np.empty((5, n), np.uint64)
        mask, other = np.empty((2, n), np.uint64)
        if swaps:
            off, before, reg, off_in, seed_in, mask_in = (s[c] for c in self.SWAPS[5:])
            u, f = np.empty((2, n), np.uint64)
        AND, OR, XOR, NOT, SHL, SHR, ADD = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.left_shift, np.right_shift, np.add

        def carry(x: np.ndarray, to: np.ndarray, start: int = 0) -> None:
            SHR(x[:-1], _TOP, out=to[1:])
            to[first] = start

        for k in range(steps):
            moved[1:] = row[:-1]
            moved[first] = into[k]
            row, moved = moved, row
            ADD(row, self.base, out=at)
            self._lookup(at, mask)
            OR(mask, hn_in, out=e)
            AND(e, vp, out=d)
            ADD(d, vp, out=d)
            XOR(d, vp, out=d)
            OR(d, e, out=d)
            OR(d, vn, out=d)
            if swaps:
                # off: where the row before is one more than on the diagonal, shifted by later use
                AND(mask, off, out=u)  # a character that stands before, and may be swapped with one behind
                SHL(u, _ONE, out=f)
                OR(f, seed_in, out=f)
                AND(f, vp, out=t)
                ADD(t, vp, out=t)
                XOR(t, vp, out=t)
                OR(f, t, out=f)
                AND(f, vp, out=t)
                OR(u, t, out=u)
                carry(u, seed_in)
                AND(f, before, out=f)
                OR(d, f, out=d)
                SHL(mask, _ONE, out=u)
                OR(u, mask_in, out=u)
                carry(mask, mask_in)
                AND(u, reg, out=u)
                OR(d, u, out=d)
            OR(d, vp, out=hp)
            NOT(hp, out=hp)
            OR(hp, vn, out=hp)
            AND(d, vp, out=hn)
            np.take(hp, last, out=ups[k], mode="clip")
            np.take(hn, last, out=downs[k], mode="clip")
            SHL(hp, _ONE, out=e)
            OR(e, hp_in, out=e)
            SHL(hn, _ONE, out=t)
            OR(t, hn_in, out=t)
            carry(hp, hp_in, 1)
            carry(hn, hn_in)
            OR(d, e, out=vp)
            NOT(vp, out=vp)
            OR(vp, t, out=vp)
            AND(d, e, out=vn)
            if swaps:
                NOT(d, out=off)
                SHL(off, _ONE, out=f)
                OR(f, off_in, out=f)
                carry(off, off_in)
                AND(reg, e, out=reg)
                AND(mask, f, out=f)
                OR(reg, f, out=reg)
                before, mask = mask, before
        s["row"] = row
        if swaps:
            s["mask"] = before
        for k, p in enumerate(self.pairs):
            lo = max(0, p.words - 1 - p.done)
            hi = min(steps, p.words - 1 + len(p.steps) - p.done)
            if lo < hi:
                p.distance += int((ups[lo:hi, k] >> self.bit[k] & _ONE).sum()) - int((downs[lo:hi, k] >> self.bit[k] & _ONE).sum())
            p.done += steps


def edit_distances(pairs: Iterable[tuple[str, str] | None], swaps: bool = False) -> list[int | None]:
    """The least number of insertions, deletions and substitutions, with ``swaps`` also of
    transpositions, that make one text of the other. Memory is that of the texts and of WORDS
    words, or of one pair where it has more."""
    out: list[int | None] = []

    def told() -> Iterator[_Pair]:
        for k, x in enumerate(pairs):
            out.append(None)
            if x is None:
                continue
            a, b = _stripped(_codes(x[0]), _codes(x[1]))
            if len(a) and len(b):
                yield _pair(k, a, b)
            else:
                out[k] = len(a) + len(b)

    hand, coming, held = _Hand(swaps), told(), deque()
    while True:
        ended = [p.done >= p.words - 1 + len(p.steps) for p in hand.pairs]
        for p, x in zip(hand.pairs, ended):
            if x:
                out[p.number] = p.length + p.distance
        size = sum(p.words for p, x in zip(hand.pairs, ended) if not x)
        new: list[_Pair] = []
        alone = any(p.words * p.rows > DENSE and not x for p, x in zip(hand.pairs, ended))
        while not alone and size < WORDS:
            p = held.popleft() if held else next(coming, None)
            if p is None:
                break
            large = p.words * p.rows > DENSE
            if large and size:
                held.append(p)  # waits until nothing else is in hand
                break
            new.append(p)
            size, alone = size + p.words, large
        if any(ended) or new:
            hand.change(ended, new)
        if not hand.pairs:
            return out
        hand.run(min(STEPS, max(1, max(p.words - 1 + len(p.steps) - p.done for p in hand.pairs))))


def _distance_udf(swaps: bool):
    """Column function; of a batch only the pairs in hand are Python's, the longest first."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        order = np.argsort(-pc.fill_null(pc.min_element_wise(pc.binary_length(a), pc.binary_length(b), skip_nulls=False), 0).to_numpy(zero_copy_only=False), kind="stable")
        texts = ((a[i].as_py(), b[i].as_py()) for i in order.tolist())
        found = edit_distances((None if x is None or y is None else (x, y) for x, y in texts), swaps)
        out = np.empty(len(order), object)
        out[order] = found
        return pa.array(out.tolist(), pa.float64())

    def of(a: Column, b: Column) -> Column:
        return F.arrow_udf(run, "double")(a, b)

    return of


levenshtein_udf = _distance_udf(False)
damerau_udf = _distance_udf(True)
