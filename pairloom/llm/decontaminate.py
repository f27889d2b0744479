"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two scans of the corpus, neither of which shuffles a text. The first counts, over all
documents, the words that test items use; from these an n-gram's chance frequency is
the product of its words' frequencies (so a leaked item that was copied thousands of
times doesn't make its own n-grams common). The n-grams of an item that are rare by
this measure, and always at least its rarer half, are its seeds. The second scan looks
up every n-gram of every document among the seeds and aligns the item with the passage
around each group of hits. Items are handled in blocks of ``block_items``: what is
sent to executors is bounded, and a larger benchmark takes more scans, not more memory.

A match needs evidence: the share of the item that is aligned, times what its words say by
their frequency in the corpus, must reach ``min_nats``. A short item of common words ("yes")
can't, however often it occurs; three rare words can.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops


@dataclass(frozen=True)
class Params:
    n: int = 3
    rare: float = 1e-8
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    min_nats: float = 25.0
    block_items: int = 20_000


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray], p: Params = Params()) -> list[tuple[int, int, int]]:
    """(best local score, first, end) of each item in its passage, on word hashes; first
    and end bound the aligned words of the passage. Linear gaps; the rows of all pairs
    are filled together. Of equal scores the first end in the passage, of equal paths
    the latest first, holds."""
    c, n, m = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((c, n), np.uint64), np.ones((c, m), np.uint64)  # paddings never match
    for k in range(c):
        a[k, : len(items[k])], b[k, : len(passages[k])] = items[k], passages[k]
    real = np.arange(m)[None, :] < np.array([len(x) for x in passages])[:, None]
    ramp = -p.gap * np.arange(m + 1, dtype=np.int64)
    shift, big = 1 << 24, np.int64(1) << 24
    # a cell is score * 2**24 + first word, so one maximum carries the start along
    start = np.arange(m + 1, dtype=np.int64)
    h = np.broadcast_to(start, (c, m + 1)).copy()
    best, best_end = np.zeros(c, np.int64), np.zeros(c, np.int64)
    for i in range(n):
        s = np.where((a[:, i, None] == b) & real, p.match, p.mismatch) * big
        row = np.empty_like(h)
        row[:, 0] = 0
        np.maximum(h[:, :-1] + s, h[:, 1:] + p.gap * big, out=row[:, 1:])
        row[:, 1:] = np.where(row[:, 1:] >= big, row[:, 1:], start[1:])
        lifted = row + ramp * big
        np.maximum.accumulate(lifted, axis=1, out=lifted)
        row = lifted - ramp * big
        h = np.where(row >= big, row, start)
        top = (h // shift * real_pad(real)).argmax(1)
        v = h[np.arange(c), top]
        up = v // shift > best // shift
        best, best_end = np.where(up, v, best), np.where(up, top, best_end)
    return [(int(v // shift), int(v % shift), int(e)) for v, e in zip(best, best_end)]


def real_pad(real: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(real), 1), bool), real], 1)


class Seeds:
    """Sorted seed n-grams of a block of items with the items and places they come from."""

    def __init__(self, ids: list[int], words: list[np.ndarray], counts: dict[int, int], total: int, p: Params):
        self.ids, self.words = np.array(ids, np.int64), words
        rows: dict[int, list] = {}
        self.nats = np.zeros(len(words))
        for k, w in enumerate(words):
            n = min(p.n, len(w))
            f = np.log([max(1, counts.get(int(x), 0)) / max(1, total) for x in w])
            self.nats[k] = -f.sum()
            if self.nats[k] < p.min_nats:
                continue
            chance = np.array([f[i : i + n].sum() for i in range(len(w) - n + 1)])
            tok = textops.Tokens(w, np.zeros(len(w), np.int64), *[np.zeros(len(w), np.int64)] * 3)
            h, at = textops.grams(tok, n)
            ok = chance[at] <= max(np.log(p.rare), np.median(chance))
            rows.setdefault(n, []).append((h[ok], np.full(ok.sum(), k), at[ok]))
        self.by_n = {}
        for n, parts in rows.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(h, kind="stable")
            self.by_n[n] = (h[o], item[o], at[o])

    def hits(self, tok: textops.Tokens):
        """(doc, item, word of the text, word of the item) of every seed occurrence."""
        out = []
        for n, (h, item, at) in self.by_n.items():
            g, i = textops.grams(tok, n)
            lo = np.searchsorted(h, g)
            lo[lo == len(h)] = 0
            x = np.flatnonzero(h[lo] == g)
            if not len(x):
                continue
            lo, hi = lo[x], np.searchsorted(h, g[x], side="right")
            reps = hi - lo
            src = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            pos = np.repeat(i[x], reps)
            out.append((tok.doc[pos], item[src], pos, at[src]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        return tuple(np.concatenate(x) for x in zip(*out))


def _align(tok: textops.Tokens, seeds: Seeds, n_docs: int, p: Params):
    """(doc, item, score, first, end) of the best alignment of each (doc, item) with a hit."""
    doc, item, pos, at = seeds.hits(tok)
    if not len(doc):
        return []
    first = np.searchsorted(tok.doc, np.arange(n_docs + 1))
    guess = pos - at
    o = np.lexsort((guess, item, doc))
    doc, item, guess = doc[o], item[o], guess[o]
    length = np.array([len(w) for w in seeds.words])[item]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (guess[1:] - guess[:-1] > np.maximum(4, length[1:] // 2))]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(doc)] - 1
    pad = np.maximum(4, length[s] // 2)
    lo = np.maximum(first[doc[s]], guess[s] - pad)
    hi = np.minimum(first[doc[s] + 1], guess[e] + length[s] + pad)
    # chains of hits that run far beyond an item are aligned in overlapping windows
    reach = 4 * length[s] + 2 * pad
    jobs = []
    for k in range(len(s)):
        step = max(1, int(reach[k] - 2 * length[s[k]]))
        x = int(lo[k])
        while True:
            y = min(int(hi[k]), x + int(reach[k]))
            jobs.append((int(doc[s[k]]), int(item[s[k]]), x, y))
            if y >= hi[k]:
                break
            x += step
    jobs.sort(key=lambda j: (j[3] - j[2]))
    best: dict[tuple[int, int], tuple] = {}
    for b in range(0, len(jobs), 64):
        part = jobs[b : b + 64]
        got = smith_waterman([seeds.words[j[1]] for j in part], [tok.hash[j[2] : j[3]] for j in part], p)
        for (d, it, x, _), (v, f, g) in zip(part, got):
            r = (v / (p.match * len(seeds.words[it])), -(x + f - int(first[d])), -(x + g - int(first[d])))
            if (d, it) not in best or r > best[d, it]:
                best[d, it] = r
    return [(d, it, r[0], -r[1], -r[2]) for (d, it), r in sorted(best.items())]


def _items(benchmark: DataFrame, p: Params):
    """Blocks of (ids, word hashes); items without an id or a word are left out, equal rows count once."""
    ids, words, seen = [], [], set()
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where(
        "i is not null and t is not null"
    ).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        w = textops.words_of(r.t)
        key = (r.i, w.tobytes())
        if len(w) and key not in seen:
            seen.add(key)
            ids.append(r.i)
            words.append(w)
        if len(ids) == p.block_items:
            yield ids, words
            ids, words, seen = [], [], set()
    if ids:
        yield ids, words


def _word_counts(docs: DataFrame, vocab: np.ndarray) -> tuple[dict[int, int], int]:
    """Occurrences in all documents of each hash of ``vocab`` (sorted), and of all words."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(it):
        v = known.value
        n, total = np.zeros(len(v), np.int64), 0
        for b in it:
            data, offsets = textops.buffers(b.column(0))
            for i, j in textops.chunks(data, offsets):
                h = textops.tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).hash
                x = np.searchsorted(v, h)
                x[x == len(v)] = 0
                n += np.bincount(x[v[x] == h], minlength=len(v))
                total += len(h)
        x = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.r_[x, -1]), pa.array(np.r_[n[x], total])], ["w", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r.w: r.n for r in rows}
    return {int(vocab[w]): n for w, n in got.items() if w >= 0}, got.get(-1, 0)


def _blocks(docs: DataFrame, benchmark: DataFrame, p: Params):
    for ids, words in _items(benchmark, p):
        counts, total = _word_counts(docs, np.unique(np.concatenate(words)))
        yield docs.sparkSession.sparkContext.broadcast(Seeds(ids, words, counts, total, p))


def _scan(texts: pa.Array, seeds: Seeds, p: Params):
    data, offsets = textops.buffers(texts)
    for i, j in textops.chunks(data, offsets):
        tok = textops.tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for d, it, v, f, g in _align(tok, seeds, j - i, p):
            if v >= p.threshold and v * seeds.nats[it] >= p.min_nats:
                yield i + d, int(seeds.ids[it]), round(v, 6), f, g


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every leak: score is the
    alignment score over that of a full copy, at least ``threshold``; the words are
    those of the document that are aligned.

    Null texts, texts and items without words match nothing; an item shorter than n
    words seeds with all of it; one with less than ``min_nats`` to say matches nothing. Equal documents are each reported, rows of one doc_id
    once, with the best; rows of one item_id with different texts are items of their own, and the best one is reported.
    """
    out = None
    for seeds in _blocks(docs, benchmark, p):

        def run(it, seeds=seeds):
            for b in it:
                ids = b.column(0).to_pylist()
                rows = [(ids[d], *r) for d, *r in _scan(b.column(1), seeds.value, p)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(
            run, "doc_id long, item_id long, score double, first_word long, end_word long"
        )
        out = part if out is None else out.unionAll(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), (-F.col("end_word")).alias("e"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).selectExpr(
        "doc_id", "item_id", "b.score as score", "-b.f as first_word", "-b.e as end_word"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``contaminated`` finds nothing; no shuffle.
    Rows stay or go by their text alone: nulls, empty texts and rows without an id that match
    nothing stay, repeated rows fare alike. An empty benchmark drops nothing."""
    at = docs.columns.index("text")
    out = docs
    for seeds in _blocks(docs, benchmark, p):

        def run(it, seeds=seeds):
            for b in it:
                keep = np.ones(len(b), bool)
                for d, *_ in _scan(b.column(at), seeds.value, p):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
