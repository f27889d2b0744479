"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow batches: a batch of texts is one byte
buffer, tokens are found by comparing neighbouring byte classes, and the hash of
every token is a difference of prefix sums, so that no Python code runs per word.
Batches are cut into chunks of about ``CHUNK_BYTES`` (never inside a text) to
bound memory; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}

#: Byte classes: 0 white space and control, 1 letters, digits and non-ASCII, 2 other ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASS[_lo:_hi] = 1
_TABLE = CLASS.tobytes()


class Tokens(NamedTuple):
    """Tokens of a chunk: ``hash`` (uint64), ``doc`` (row within the chunk, ascending),
    ``start`` and ``end`` (byte positions in the chunk) and ``kind`` (1 word, 2 symbols)."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"][:n], _POW["down"]


def buffers(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) rows of consecutive chunks of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def tokenize(data: np.ndarray, offsets: np.ndarray, symbols: bool = False) -> Tokens:
    """Maximal runs of one byte class; white space is dropped, runs of symbols unless ``symbols``."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(z.astype(np.uint64), z, z, z, z.astype(np.uint8))
    cls = np.frombuffer(data.tobytes().translate(_TABLE), np.uint8)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    change[inner] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    kind = cls[start]
    keep = kind > 0 if symbols else kind == 1
    start, end, kind = start[keep], end[keep], kind[keep]
    up, down = _powers(n)
    pre = np.empty(n + 1, np.uint64)
    pre[0] = 0
    np.cumsum(data.astype(np.uint64) * up, out=pre[1:])
    h = (pre[end] - pre[start]) * down[start]
    h = mix(h ^ (end - start).astype(np.uint64))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Tokens(h, doc, start, end, kind)


def grams(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that begins at token i, i) for all n-grams within one text."""
    m = len(tok.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tok.hash[:m].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(_BASE) + tok.hash[k : m + k])
    i = np.flatnonzero(tok.doc[:m] == tok.doc[n - 1 :])
    return h[i], i


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of one text, as ``tokenize`` gives them."""
    return tokenize(*buffers(pa.array([text], pa.string()))).hash
