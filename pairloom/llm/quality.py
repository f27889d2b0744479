"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops


@dataclass(frozen=True)
class Params:
    """``max_train`` bounds the labelled sample that is brought to the driver for
    fitting: the labelled documents that come first by hash of doc_id. Scoring has no
    bound. A document is rejected when its probability of good quality is under
    ``threshold``, which was set on held-out labels: most documents are good, so those
    near an even chance are doubtful."""

    bits: int = 18
    max_n: int = 2
    max_train: int = 6000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2
    threshold: float = 0.65


def _sparse(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a chunk, rows ascending. The value of a
    feature is 1 / sqrt(features of the row); symbols are tokens too. Tokens equal to
    the one before, or to the one before that, are n-grams of any word: a feature for
    each power of two that their number in the text reaches."""
    tok = textops.tokenize(data, offsets, symbols=True)
    keys = []
    for n in range(1, p.max_n + 1):
        h, i = textops.grams(tok, n)
        f = textops.mix(h + np.uint64(n)) >> np.uint64(64 - p.bits)
        keys.append((tok.doc[i].astype(np.uint64) << np.uint64(p.bits)) | f)
    for lag in (1, 2):
        same = (tok.hash[lag:] == tok.hash[:-lag]) & (tok.doc[lag:] == tok.doc[:-lag])
        often = np.bincount(tok.doc[lag:][same])
        for power in range(int(often.max(initial=0)).bit_length()):
            row = np.flatnonzero(often >= 1 << power).astype(np.uint64)
            f = textops.mix(np.array([1000 * lag + power], np.uint64)) >> np.uint64(64 - p.bits)
            keys.append((row << np.uint64(p.bits)) | f)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(p.bits)).astype(np.int64), (key & np.uint64((1 << p.bits) - 1)).astype(np.int64)


def _batches(texts: pa.Array, p: Params) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = textops.buffers(texts)
    for i, j in textops.chunks(data, offsets):
        yield i, j, *_sparse(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)


def probabilities(texts: pa.Array, weights: np.ndarray, bias: float, p: Params) -> np.ndarray:
    """Probability of good quality of each text; a text without tokens gets the prior."""
    out = np.full(len(texts), 1 / (1 + np.exp(-bias)))
    for i, _, row, feat in _batches(texts, p):
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            n = np.diff(np.r_[first, len(row)])
            z = np.add.reduceat(weights[feat], first) / np.sqrt(n) + bias
            out[i + row[first]] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return out


def ftrl(rows: list[tuple[np.ndarray, int]], p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias (McMahan et al. 2013, algorithm 1). The bias is not regularised."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    last = 1 << p.bits
    l1, l2 = p.l1, p.l2

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + l2)
        w[np.abs(zi) <= l1] = 0
        w[-1] = -zi[-1] / ((p.beta + np.sqrt(n[last])) / p.alpha)
        return w

    for _ in range(p.epochs):
        for feat, label in rows:
            i = np.append(feat, last)
            x = np.full(len(i), 1 / np.sqrt(max(1, len(feat))))
            x[-1] = 1.0
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(last + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Fits on at most ``p.max_train`` labelled documents. Labels that are null, or not
    0 or 1, are left out; of contradicting labels the lower holds; a repeated doc_id is
    one document, that with the least features, compared as bytes. Without labelled documents all weights
    are 0 and every probability is 0.5."""
    spark = docs.sparkSession
    lab = (
        labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("y"))
        .where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    )
    first = lab.orderBy(F.xxhash64("i"), "i").limit(p.max_train).collect()
    if not first:
        return np.zeros(1 << p.bits), 0.0
    at = {r.i: k for k, r in enumerate(first)}
    sample = spark.createDataFrame([(r.i,) for r in first], "i long")
    mine = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).join(
        F.broadcast(sample), "i"
    )

    def features(it):
        for b in it:
            feats = [b""] * len(b)
            for i, j, row, feat in _batches(b.column(1), p):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    feats[i + k] = feat[cut[k] : cut[k + 1]].astype("<i4").tobytes()
            yield pa.record_batch([b.column(0), pa.array(feats, pa.binary())], ["i", "f"])

    got: dict[int, bytes] = {}
    for r in mine.mapInArrow(features, "i long, f binary").collect():
        got[r.i] = min(got[r.i], bytes(r.f)) if r.i in got else bytes(r.f)
    rows = [
        (np.frombuffer(got[r.i], "<i4").astype(np.int64), r.y)
        for r in sorted(first, key=lambda r: at[r.i]) if r.i in got
    ]
    return ftrl(rows, p) if rows else (np.zeros(1 << p.bits), 0.0)


def _least(weights: np.ndarray, bias: float, p: Params) -> float:
    """The score from which a document is kept; without a model every one is."""
    return p.threshold if bias or weights.any() else 0.0


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``.

    score is the probability of good quality, rounded to 6 digits. Null and empty
    texts, and texts without a token, get the prior. Repeated rows are scored each, rows without
    an id too; other columns play no part. Without labelled documents all score 0.5 and are kept.
    """
    weights, bias = fit(docs, labels, p)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2 ** bits numbers
    least = _least(weights, bias, p)

    def run(it):
        w, b0 = model.value
        for b in it:
            s = np.round(probabilities(b.column(1), w, b0, p), 6)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array(s >= least)], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` keeps; no shuffle. Rows stay or go by
    their text alone; without labelled documents there is no model and all stay. An empty
    table gives no rows."""
    weights, bias = fit(docs, labels, p)
    model, least = docs.sparkSession.sparkContext.broadcast((weights, bias)), _least(weights, bias, p)
    at = docs.columns.index("text")

    def run(it):
        w, b0 = model.value
        for b in it:
            s = np.round(probabilities(b.column(at), w, b0, p), 6)
            yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)
