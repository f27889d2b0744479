"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 128 bits: each bit is the majority, over the distinct words of the
text, of one bit of the word's hash. Texts are near-duplicates when their fingerprints
differ in at most ``max_distance`` bits; groups are the connected components. No such
pair is missed, at any number of documents:

1. Texts of equal fingerprint fold into one row, so that thousands of copies cost one.
2. Fingerprints that close differ in at most max_distance // parts bits of one part of the
   bits, t say; of t + k bands of that part k at least are equal. They meet in a bucket of
   the table of those k bands: there is one for every choice. ``plan`` takes the least k
   that keeps chance company in a bucket under ``occupancy``, so that the number of
   tables follows the number of fingerprints, and the answer doesn't. No bucket is capped.
   Tables are spread in waves, a fingerprint taking 17 bytes in each.
3. Within a bucket every fingerprint has its Hamming distances to ``pivots`` reference
   fingerprints; pairs whose distances differ by more than ``max_distance`` anywhere are
   discarded (triangle inequality, no loss), and the rest are verified on all bits. A
   bucket yields spanning edges of its groups, not all pairs; in large buckets groups grow
   breadth first, so members of one group aren't compared with each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textops
from .packing import bucket_of, pack, starts, unpack
from .plumbing import connected_components, discard, fresh, materialize

WORDS = 2  # 64-bit words of a fingerprint
BITS = 64 * WORDS


@dataclass(frozen=True)
class Params:
    max_distance: int = 20
    pivots: int = 16
    occupancy: int = 512
    parts: int = 3
    seed: int = 20240229
    bucket: int = 1 << 18  # rows of an exchange's bucket, a task's share
    wave: int = 84  # tables that are spread at a time, so that disk doesn't follow their number

    def plan(self, n: int) -> int:
        """Equal bands that make a bucket, for ``n`` fingerprints."""
        t, width = self.max_distance // self.parts, BITS // self.parts
        return next((k for k in range(1, width - t) if n * 2.0 ** -(width * k / (t + k)) <= self.occupancy), width - t)

    def tables(self, n: int) -> list[np.ndarray]:
        """The bits whose equality makes a bucket, for each table."""
        t, k = self.max_distance // self.parts, self.plan(n)
        order = np.random.default_rng(self.seed + 1).permutation(BITS)
        return [
            np.sort(np.concatenate(chosen))
            for part in np.array_split(order, self.parts)
            for chosen in combinations(np.array_split(part, t + k), k)
        ]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """[n, WORDS] uint64. A text without words is taken as one word, its characters
    without outer white space; where nothing is left the fingerprint is 0."""
    data, offsets = textops.buffers(texts)
    out = np.zeros((len(texts), WORDS), np.uint64)
    for i, j in textops.chunks(data, offsets):
        tok = textops.tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        key = np.unique((tok.doc.astype(np.uint64) << np.uint64(44)) | (tok.hash >> np.uint64(20)))
        out[i:j] = _majority(key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.int64), j - i)
        for r in np.flatnonzero(np.bincount(tok.doc, minlength=j - i) == 0):
            raw = bytes(data[offsets[i + r] : offsets[i + r + 1]]).strip()
            if raw:
                whole = np.full(len(raw), 97, np.uint8)
                whole[:] = np.frombuffer(raw, np.uint8) | 128  # any byte as a letter
                h = textops.tokenize(whole, np.array([0, len(raw)])).hash
                out[i + r] = [textops.mix(h + np.uint64(k + 1))[0] for k in range(WORDS)]
    return out


def _majority(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Bitwise majority of the hashes of each row (ascending); ties give 0."""
    out = np.zeros((n, WORDS), np.uint64)
    if not len(rows):
        return out
    words = np.stack([textops.mix(hashes + np.uint64(7919 * k + 1)) for k in range(WORDS)], 1)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    # eight byte counters to a number: add at most 255 rows, then widen
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[first, len(rows)])
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    part = np.add.reduceat(bits, first[owner] + 255 * nth, axis=0).view(np.uint8)
    total = np.add.reduceat(part.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[rows[first]] = np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def references(p: Params) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(p.seed).integers(0, 1 << 64, (p.pivots, WORDS), np.uint64, endpoint=False)


def pivot_table(fp: np.ndarray, p: Params) -> np.ndarray:
    """[n, pivots] uint8 Hamming distances."""
    ref = references(p)
    return np.stack([np.bitwise_count(fp ^ r).sum(1, dtype=np.uint8) for r in ref], 1)


def close(fa: np.ndarray, ta: np.ndarray, fb: np.ndarray, tb: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with fa[i] within the distance of fb[j]: pivot coordinates
    first, all bits of the survivors after."""
    k = np.uint8(p.max_distance)
    a, b = np.ascontiguousarray(ta.T) + k, np.ascontiguousarray(tb.T)
    alive, ok, gap = np.ones((len(fa), len(fb)), bool), np.empty((len(fa), len(fb)), bool), np.empty((len(fa), len(fb)), np.uint8)
    for x, y in zip(a, b):
        np.subtract(x[:, None], y[None, :], out=gap)  # |difference| <= k in wrapping bytes
        np.less_equal(gap, 2 * k, out=ok)
        np.logical_and(alive, ok, out=alive)
    if np.count_nonzero(alive) > alive.size // 16:  # many survivors: all bits of whole rows are cheaper than of single pairs
        gap[:] = 0
        for w in range(WORDS):
            gap += np.bitwise_count(fa[:, w, None] ^ fb[None, :, w])
        return np.nonzero(alive & (gap <= k))
    i, j = np.nonzero(alive)
    d = np.zeros(len(i), np.uint8)
    for w in range(WORDS):
        d += np.bitwise_count(fa[i, w] ^ fb[j, w])
    ok = d <= k
    return i[ok], j[ok]


def group_bucket(fp: np.ndarray, table: np.ndarray, p: Params, small: int = 768, block: int = 128) -> np.ndarray:
    """Least index of the group of each row, groups by closeness within the bucket."""
    m = len(fp)
    label = np.arange(m)
    rest, gone = np.arange(m), np.zeros(m, bool)
    while len(rest) > small:  # a block of roots at a time; those without company are done with
        roots = rest[:block]
        i, j = close(fp[roots], table[roots], fp[rest], table[rest], p)
        i, j = i[i != j], j[i != j]
        for k, root in enumerate(roots):
            if gone[root]:
                continue
            gone[root] = True
            frontier = rest[j[i == k]]
            frontier = frontier[~gone[frontier]]
            while len(frontier):  # breadth first
                gone[frontier], label[frontier] = True, root
                left = rest[~gone[rest]]
                hit = np.zeros(len(left), bool)
                for s in range(0, len(frontier), block):
                    f, todo = frontier[s : s + block], np.flatnonzero(~hit)
                    _, x = close(fp[f], table[f], fp[left[todo]], table[left[todo]], p)
                    hit[todo[x]] = True
                frontier = left[hit]
        rest = rest[~gone[rest]]
    if len(rest) > 1:
        found = []
        for s in range(0, len(rest), block):  # each pair once
            f, g = rest[s : s + block], rest[s:]
            i, j = close(fp[f], table[f], fp[g], table[g], p)
            found.append((f[i[i < j]], g[j[i < j]]))
        i, j = (np.concatenate(x) for x in zip(*found))
        while True:
            a, b = label[i], label[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            if (lo == hi).all():
                break
            np.minimum.at(label, hi, lo)
            while (label[label] != label).any():
                label = label[label]
    return label


def node(fp: np.ndarray) -> np.ndarray:
    """The hash by which components know a fingerprint."""
    return textops.mix(textops.mix(fp[:, 0]) * np.uint64(textops._BASE) + fp[:, 1]).view(np.int64)


def _fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, node) of the rows whose text isn't null or blank."""

    def run(it):
        for b in it:
            f = fingerprints(b.column(1))
            keep = pa.array((f != 0).any(1))
            cols = [b.column(0), *[pa.array(f[:, w].view(np.int64)) for w in range(WORDS)], pa.array(node(f))]
            yield pa.record_batch(cols, ["doc_id", "f0", "f1", "node"]).filter(keep)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "doc_id long, f0 long, f1 long, node long")


def _keys(fp: np.ndarray, t: int, chosen: np.ndarray) -> np.ndarray:
    """A hash, of table ``t``, of the bits of each fingerprint that make its bucket."""
    mask = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(mask, chosen >> 6, np.uint64(1) << (chosen & 63).astype(np.uint64))
    masked = fp & mask
    return textops.mix(textops.mix(masked[:, 0] + np.uint64(t + 1)) * np.uint64(textops._BASE) + masked[:, 1])


def edges(reps: DataFrame, n: int, p: Params = Params()) -> list[DataFrame]:
    """Kept tables (a, b): spanning edges between the ``node`` of close fingerprints, for
    ``n`` distinct rows of (f0, f1)."""
    tables, found = p.tables(n), []
    for first in range(0, len(tables), p.wave):
        found.append(materialize(_wave(reps, n, dict(list(enumerate(tables))[first : first + p.wave]), p), "pairs"))
    return found


def _wave(reps: DataFrame, n: int, tables: dict[int, np.ndarray], p: Params) -> DataFrame:
    buckets = max(1, -(-n * len(tables) // p.bucket))
    least = min(tables)

    def spread(it):
        for b in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            fp = np.stack(cols, 1).view(np.uint64)
            for t, chosen in tables.items():
                bucket = bucket_of(_keys(fp, t, chosen), buckets)
                yield pack(bucket, [np.full(len(fp), t - least, np.uint8 if p.wave < 256 else np.uint32), *cols], ["t", "f0", "f1"])

    def verify(rows: pa.Table) -> pa.Table:
        t = unpack(rows["t"], np.uint8 if p.wave < 256 else np.uint32)
        every = np.stack([unpack(rows[c], np.uint64) for c in ("f0", "f1")], 1)
        by_table = np.argsort(t, kind="stable")
        cut = np.searchsorted(t[by_table], np.arange(len(tables) + 1))
        a, c = [], []
        for k, (number, chosen) in enumerate(sorted(tables.items())):
            fp = every[by_table[cut[k] : cut[k + 1]]]
            key = _keys(fp, number, chosen)
            o = np.lexsort((fp[:, 1], fp[:, 0], key))
            key, fp = key[o], fp[o]
            first = starts(key)
            size = np.diff(np.append(first, len(o)))
            ids = node(fp)
            for s, m in zip(first[size > 1], size[size > 1]):
                f = fp[s : s + m]
                label = group_bucket(f, pivot_table(f, p), p)
                x = np.flatnonzero(label != np.arange(m))
                a.append(ids[s + x])
                c.append(ids[s + label[x]])
        z = np.zeros(0, np.int64)
        pair = np.stack([np.concatenate(a or [z]), np.concatenate(c or [z])], 1)
        pair = np.unique(pair, axis=0) if len(pair) else pair
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    packed = reps.select("f0", "f1").mapInArrow(spread, "bucket int, t binary, f0 binary, f1 binary")
    return packed.groupBy("bucket").applyInArrow(verify, "a long, b long").distinct()


def _losers(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, f0, f1, dup_of) of every document, a doc_id and a fingerprint, that isn't
    the one of its group to stay: the least doc_id, or the least fingerprint where none has an id."""
    fps = materialize(_fingerprint_table(docs).distinct(), "fingerprints")
    reps = materialize(fps.select("f0", "f1").distinct(), "representatives")
    found = edges(reps, reps.count(), p)
    every = found[0]
    for x in found[1:]:
        every = every.unionAll(x)
    comp = connected_components(every)
    own = fps.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("f0"), F.col("f1"))
    best = own.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = own.join(best, "component").where(order != F.col("best")).select("doc_id", "f0", "f1", F.col("best.doc_id").alias("dup_of"))
    out = materialize(out, "duplicates")
    for t in (fps, reps, *found, comp):
        discard(t)
    return out


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, dup_of): each document of a group but its least doc_id, with that doc_id.

    Rows without a doc_id, or whose text is null or blank, aren't listed (those without an
    id still link others). Repeated rows of one doc_id and text are one document; texts of
    one doc_id that aren't close are documents of their own, so that a doc_id may be listed
    once for each. Groups of equal texts count as ties: the least doc_id stays. An empty
    table gives no rows; other columns play no part.
    """
    return _losers(docs, p).where("doc_id <> dup_of").select("doc_id", "dup_of").distinct()


def drop_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates.

    That of the least doc_id stays; rows without an id only where their group has none
    with one. Of rows with one doc_id and close texts one stays, by the hash of all its
    columns. Rows whose text is null or blank all stay. An empty table gives no rows.
    Rows of one document within a batch fold before they are moved; the decisions grow
    with the documents, so they are merged with them at every size and never broadcast.
    """
    f0, f1, mark, order, nth = fresh(docs, "f0", "f1", "mark", "order", "nth")
    at, ids, cols = docs.columns.index("text"), docs.columns.index("doc_id"), len(docs.columns)

    def run(it):
        for b in it:
            f = fingerprints(b.column(at)).view(np.int64)
            out = pa.record_batch([*b.columns, *[pa.array(f[:, w]) for w in range(WORDS)]], [*b.schema.names, f0, f1])
            rank = b.column(cols - 1).to_numpy()
            doc = b.column(ids)
            same = np.lexsort((rank, doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), f[:, 1], f[:, 0]))
            first = starts(doc.fill_null(0).to_numpy(zero_copy_only=False)[same], doc.is_null().to_numpy(zero_copy_only=False)[same], f[same, 0], f[same, 1])
            keep = (f == 0).all(1)
            keep[same[first]] = True
            yield out.filter(pa.array(keep))

    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long")) if dict(docs.dtypes)["doc_id"] != "bigint" else docs
    row = typed.withColumn(order, F.xxhash64(*docs.columns))
    cols += 1
    marked = row.mapInArrow(run, StructType([*row.schema.fields, StructField(f0, LongType()), StructField(f1, LongType())]))
    blank = (F.col(f0) == 0) & (F.col(f1) == 0)
    marked = marked.withColumn(mark, F.when(blank, F.col(order)).otherwise(F.xxhash64("doc_id", f0, f1)))
    gone = _losers(docs, p).select(F.xxhash64("doc_id", "f0", "f1").alias(nth)).hint("merge")
    left = marked.join(gone, marked[mark] == gone[nth], "left_anti")
    one = left.withColumn(nth, F.row_number().over(Window.partitionBy(mark).orderBy(order))).where(blank | (F.col(nth) == 1))
    return one.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
