"""Line dedup by a tree of log templates.

A line goes down a fixed-depth tree by its number of tokens and its ``lead`` first tokens
to a leaf (He et al. 2017, Drain). Tokens that hold a digit are variable. Within a leaf,
lines join the template that they agree with in at least ``similarity`` of the tokens;
where they differ the template gets a wildcard. Templates that recur in ``min_docs``
documents or more are dropped from all.

The tree is a hash of the path, so leaves are spread over the cluster. A first scan counts,
for each leaf, the documents that reach it; no template recurs where fewer than
``min_docs`` do, so most leaves, and all their lines, are done with. The busy leaves set
bits of a Bloom filter of bounded size, by which a second scan emits the tokens of their
lines alone (what it lets through by chance is joined away). Equal lines fold into one, a
busy leaf of one distinct line needs no work, and the others are solved leaf by leaf in the
order of their hashes, whatever the partitioning. The decisions that return to the
documents are line numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops
from .plumbing import discard, materialize

_SPACE = bytes(0 if b <= 32 else 1 for b in range(256))
_DIGIT = bytes(1 if 48 <= b < 58 else 0 for b in range(256))
VARIABLE = np.uint64(0x2A2A2A2A2A2A2A2A)  # stands for every token with a digit
WILD = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Params:
    """``max_bloom_bits`` bounds what is sent to executors; beyond about a tenth as many
    busy leaves the filter lets more through, and the join has more to do."""

    lead: int = 3
    similarity: float = 0.6
    min_docs: int = 5
    max_bloom_bits: int = 1 << 27


def lines(data: np.ndarray, offsets: np.ndarray, p: Params):
    """For each line of a chunk that has a token: (row, line number, leaf, line hash,
    first token, past token), and all token hashes, variable ones equal."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z, z, z.astype(np.uint64)
    raw = data.tobytes()
    cls = np.frombuffer(raw.translate(_SPACE), np.uint8)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change[offsets[(offsets > 0) & (offsets < n)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    real = cls[start] > 0
    start, end = start[real], end[real]
    up, down = textops._powers(n)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up, out=pre[1:])
    h = textops.mix(((pre[end] - pre[start]) * down[start]) ^ (end - start).astype(np.uint64))
    digits = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw.translate(_DIGIT), np.uint8), out=digits[1:])
    h[digits[end] > digits[start]] = VARIABLE
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, start)  # line breaks before the token, over all rows
    line = before - np.searchsorted(breaks, offsets[:-1])[row]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z, z, h
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])])
    past = np.r_[first[1:], len(start)]
    length = past - first
    leaf = textops.mix(length.astype(np.uint64))
    for k in range(p.lead):
        has = length > k
        tok = np.where(has, h[np.minimum(first + k, len(h) - 1)], np.uint64(0))
        leaf = textops.mix(leaf * np.uint64(textops._BASE) + tok)
    # order-sensitive hash of all tokens: prefix sums weighted by powers, as for tokens
    tup, tdown = textops._powers(len(h))
    tpre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tup, out=tpre[1:])
    whole = textops.mix((tpre[past] - tpre[first]) * tdown[first] ^ length.astype(np.uint64))
    return row[first], line[first], leaf, whole, first, past, h


def cluster(rows: list[np.ndarray], p: Params) -> np.ndarray:
    """Template number of each row of a leaf, rows of equal length in their order: the
    most similar template from ``similarity`` on, of equal ones the oldest."""
    kinds = np.zeros((0, len(rows[0])), np.uint32)
    out = np.zeros(len(rows), np.int64)
    n = 0
    for i, r in enumerate(rows):
        if n:
            agree = (kinds[:n] == r).sum(1)
            k = int(agree.argmax())
            if agree[k] >= p.similarity * len(r):
                out[i] = k
                kinds[k, kinds[k] != r] = WILD
                continue
        if n == len(kinds):
            kinds = np.concatenate([kinds, np.zeros((max(8, n), len(r)), np.uint32)])
        kinds[n] = r
        out[i] = n
        n += 1
    return out


def _leaves(docs: DataFrame, p: Params) -> DataFrame:
    """(leaf, contested) of the leaves that rows of ``min_docs`` or more reach: contested
    ones have several distinct lines. Counted are rows, at least as many as documents."""

    def run(it):
        for b in it:
            data, offsets = textops.buffers(b.column(0), lower=False)
            for i, j in textops.chunks(data, offsets):
                row, _, leaf, whole, *_ = lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)
                if not len(row):
                    continue
                o = np.lexsort((row, leaf))
                row, leaf, whole = row[o], leaf[o], whole[o].view(np.int64)
                first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                new = np.r_[True, (leaf[1:] != leaf[:-1]) | (row[1:] != row[:-1])]
                yield pa.record_batch(
                    [pa.array(leaf[first].view(np.int64)), pa.array(np.add.reduceat(new.astype(np.int64), first)), pa.array(np.minimum.reduceat(whole, first)), pa.array(np.maximum.reduceat(whole, first))],
                    ["leaf", "n", "lo", "hi"],
                )

    seen = docs.where("text is not null").select("text").mapInArrow(run, "leaf long, n long, lo long, hi long")
    g = seen.groupBy("leaf").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.where(F.col("n") >= p.min_docs).select("leaf", (F.col("lo") != F.col("hi")).alias("contested"))


def _bits(leaf: np.ndarray, m: int) -> np.ndarray:
    """[4, n] bits of a filter of m that each leaf sets."""
    return np.stack([textops.mix(leaf + np.uint64(k * 0x9E3779B9 + 1)) & np.uint64(m - 1) for k in range(4)]).astype(np.int64)


def bloom(leaves: DataFrame, p: Params = Params()) -> np.ndarray:
    """Words of a Bloom filter of the leaves, made by the tasks and folded word by word."""
    n = leaves.count()
    m = min(p.max_bloom_bits, max(1 << 13, 1 << (12 * n).bit_length()))

    def run(it):
        words = np.zeros(m // 64, np.uint64)
        for b in it:
            x = _bits(b.column(0).to_numpy().view(np.uint64), m).ravel()
            np.bitwise_or.at(words, x >> 6, np.uint64(1) << (x & 63).astype(np.uint64))
        i = np.flatnonzero(words)
        yield pa.record_batch([pa.array(i), pa.array(words[i].view(np.int64))], ["i", "w"])

    t = leaves.select("leaf").mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # m / 64 rows at most
    out = np.zeros(m // 64, np.uint64)
    out[t["i"].to_numpy()] = t["w"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    x = _bits(leaf, 64 * len(words))
    return ((words[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1)).all(0)


def _occurrences(docs: DataFrame, words: np.ndarray, p: Params) -> DataFrame:
    """(key, doc, line_no, leaf, line, tokens) of every line whose leaf the filter may hold;
    key tells rows apart by doc_id and text."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(it):
        for b in it:
            data, offsets = textops.buffers(b.column(2), lower=False)
            for i, j in textops.chunks(data, offsets):
                row, line, leaf, whole, first, past, h = lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)
                x = np.flatnonzero(may_hold(known.value, leaf))
                if not len(x):
                    continue
                at = pa.array(i + row[x])
                small = np.minimum((h >> np.uint64(32)).astype(np.uint32), WILD - np.uint32(1)).astype("<u4")
                toks = [small[f:e].tobytes() for f, e in zip(first[x], past[x])]
                yield pa.record_batch(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(line[x]), pa.array(leaf[x].view(np.int64)), pa.array(whole[x].view(np.int64)), pa.array(toks, pa.binary())],
                    ["key", "doc", "line_no", "leaf", "line", "tokens"],
                )

    keyed = docs.where("text is not null").select(_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), _key()).alias("doc"), "text")
    return keyed.mapInArrow(run, "key long, doc long, line_no long, leaf long, line long, tokens binary")


def _key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")


def _clusters(contested: DataFrame, p: Params) -> DataFrame:
    """(line, template) of distinct lines of leaves with several, the template named by its first line."""

    def run(it):
        held = None

        def solve(leaf, line, toks):
            names = line.copy()
            cut = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            for s, e in zip(cut, np.r_[cut[1:], len(leaf)]):
                k = cluster([np.frombuffer(t, "<u4") for t in toks[s:e]], p)
                head = np.full(k.max() + 1, -1)
                head[k[::-1]] = np.arange(e - s)[::-1]
                names[s:e] = line[s + head[k]]
            return pa.record_batch([pa.array(line), pa.array(names)], ["line", "template"])

        for b in it:
            if not len(b):
                continue
            rows = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(b.column(2).to_pylist() + [None], object)[:-1]]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            new = np.flatnonzero(held[0] != held[0][-1])  # the last leaf may go on
            whole = int(new[-1]) + 1 if len(new) else 0
            if whole:
                yield solve(*(c[:whole] for c in held))
                held = [c[whole:] for c in held]
        if held is not None:
            yield solve(*held)

    return contested.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(run, "line long, template long")


def recurring(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(key, line_no, template, n_docs) of every line whose template recurs in
    ``min_docs`` documents or more."""
    busy = materialize(_leaves(docs, p), "leaves")
    found = _occurrences(docs, bloom(busy, p), p)
    occ = materialize(found.join(busy.hint("merge"), "leaf"), "lines")
    distinct = occ.where("contested").groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    named = materialize(_clusters(distinct, p), "templates")
    told = occ.select("key", "doc", "line_no", "line").join(named, "line", "left").select(
        "key", "doc", "line_no", F.coalesce("template", "line").alias("template")
    )
    often = told.groupBy("template", "doc").agg(F.lit(1).alias("x")).groupBy("template").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= p.min_docs)
    out = materialize(told.join(often, "template").select("key", "line_no", "template", "n_docs").distinct(), "recurring")
    for t in (busy, occ, named):
        discard(t)
    return out


def drop_recurring(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_lines, dropped, text) for every row of ``docs``: text without the lines
    whose template recurs across documents, and their numbers, from 0, in dropped.

    Lines end at line feeds; blank lines have no template and stay. A null text stays
    null with 0 lines. Rows of one doc_id are one document when documents are counted;
    rows without a doc_id are one for each text. Repeated rows are each cleaned.
    """
    gone = recurring(docs, p).groupBy("key").agg(F.array_sort(F.collect_list("line_no")).alias("gone")).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    j = rows.join(gone, "key", "left").withColumn("dropped", F.coalesce("gone", F.expr("cast(array() as array<bigint>)")))
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(dropped, cast(i as bigint))), '\\n')")
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept)
    return j.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"), "dropped", text.alias("text"))
