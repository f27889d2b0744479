"""Mixing sources to target weights by balanced sampling, the cube method.

Inclusion probabilities follow from the target weights of the sources. The flight phase
(Deville and Tille 2004, in the fast form of Chauvet and Tille 2006) moves three units at
a time along the null space of two constraints, the totals of documents and of tokens,
until at most two units of a block keep a fraction. Blocks lie within a source; what they
leave flies again, by source, then over all sources, until two units at most are left:
the landing problem, solved by giving up the token constraint and then the other.
Of the documents only ids, sources and token counts are shuffled while units are drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .plumbing import discard, fresh, materialize


@dataclass(frozen=True)
class Params:
    """``targets`` gives the weight of each source in the tokens drawn; where None, a
    source weighs its tokens to the power ``temperature``. ``budget`` is the share of
    all tokens to draw. A source that can't give its share is taken whole, and the
    others share what it lacks."""

    targets: tuple[tuple[str, float], ...] | None = None
    temperature: float = 0.5
    budget: float = 0.6
    block: int = 4096
    seed: int = 7


def inclusion(tokens: dict, p: Params = Params()) -> dict:
    """Inclusion probability of the documents of each source, by filling up the budget."""
    weight = dict(p.targets) if p.targets is not None else {s: float(t) ** p.temperature for s, t in tokens.items() if t}
    weight = {s: w for s, w in weight.items() if w > 0 and tokens.get(s)}
    left, out = p.budget * sum(tokens.values()), {s: 0.0 for s in tokens}
    while weight:
        rate = left / sum(weight.values())
        full = [s for s, w in weight.items() if w * rate >= tokens[s] * (1 - 1e-12)]
        if not full:
            return out | {s: w * rate / tokens[s] for s, w in weight.items()}
        for s in full:
            out[s] = 1.0
            left = max(0.0, left - tokens[s])
            del weight[s]
    return out


def flight(prob: np.ndarray, rows: np.ndarray, tokens: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """``prob`` after the flight phase: 0 or 1 but for two units at most, with the
    totals of prob * rows and prob * tokens kept. ``draws``: uniform numbers, one for
    each unit at least."""
    out, eps = prob.copy(), 1e-9
    held: list[int] = []
    used = 0
    waiting = iter(np.flatnonzero((prob > eps) & (prob < 1 - eps)).tolist())
    while True:
        while len(held) < 3 and (k := next(waiting, None)) is not None:
            held.append(k)
        if len(held) < 3:
            return np.where(out < eps, 0.0, np.where(out > 1 - eps, 1.0, out))
        (i, j, k) = held
        r, t = rows, tokens
        u = [float(r[j] * t[k] - r[k] * t[j]), float(r[k] * t[i] - r[i] * t[k]), float(r[i] * t[j] - r[j] * t[i])]
        if u == [0.0, 0.0, 0.0]:  # the constraints agree on these three
            a, b = (float(r[i]), float(r[j])) if r[i] or r[j] else (float(t[i]), float(t[j]))
            u = [b, -a, 0.0] if a or b else [1.0, 0.0, 0.0]
        _step(out, held, u, draws[used])
        used += 1
        held = [h for h in held if eps < out[h] < 1 - eps]


def _step(out: np.ndarray, units: list[int], u: list[float], draw: float) -> None:
    """Moves the units along u or against it until one is 0 or 1, keeping expectations."""
    top = max(map(abs, u))
    u = [x / top for x in u]
    up = down = np.inf
    for h, x in zip(units, u):
        v = out[h]
        if x > 0:
            up, down = min(up, (1 - v) / x), min(down, v / x)
        elif x < 0:
            up, down = min(up, -v / x), min(down, -(1 - v) / x)
    by = up if draw < down / (up + down) else -down
    for h, x in zip(units, u):
        v = out[h] + by * x
        out[h] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v


def landing(prob: np.ndarray, rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settles what the flight left: pairs at a constant number of documents, then one
    unit by chance."""
    out = prob.copy()
    left = np.flatnonzero((out > 0) & (out < 1)).tolist()
    n = 0
    while len(left) > 1:
        i, j = left[:2]
        u = [float(rows[j]), -float(rows[i])] if rows[i] and rows[j] else [1.0, -1.0]
        _step(out, [i, j], u, draws[n])
        n += 1
        left = [k for k in left if 0 < out[k] < 1]
    for k in left:
        out[k] = float(draws[n] < out[k])
    return out


def _fly(df: DataFrame, keys: list[str], p: Params, land: bool, salt: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        seed = np.bitwise_xor.reduce(pdf.h.to_numpy().view(np.uint64)) if len(pdf) else 0
        rng = np.random.default_rng([p.seed, salt, int(seed)])
        rows, tokens = pdf.n_rows.to_numpy(), pdf.n_tokens.to_numpy()
        prob = flight(pdf.p.to_numpy(), rows, tokens, rng.random(len(pdf) + 1))
        return pdf.assign(p=landing(prob, rows, rng.random(8)) if land else prob)

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def unit(source: str = "source"):
    """The hash of the unit that a row belongs to: its doc_id, or else its source and text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("no id"), F.col(source).cast("string"), "text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))


def _units(docs: DataFrame, p: Params) -> DataFrame:
    """(h, doc_id, has_id, source, n_rows, n_tokens, pi, p) of every unit; p is 0 or 1, kept in the shared folder."""
    spark = docs.sparkSession
    units = materialize(
        docs.select(
            unit().alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"),
            F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit("\\S+")), F.lit(0)).cast("long").alias("n"),
        ).groupBy("h", "doc_id", "has_id").agg(F.min("source").alias("source"), F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens")), "units",
    )
    totals = units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    pi = inclusion({r.source: r.t for r in totals}, p)
    share = spark.createDataFrame(
        [(r.source, float(min(1.0, pi[r.source])), -(-r.n // p.block)) for r in totals], "s string, pi double, blocks long"
    )
    cols = ["h", "doc_id", "has_id", "source", "n_rows", "n_tokens", "pi", "p"]
    first = units.join(share, units["source"].eqNullSafe(share["s"])).select(
        *cols[:-1], F.col("pi").alias("p"), F.expr("pmod(h, blocks)").alias("block")
    )
    done = materialize(_fly(first, ["source", "block"], p, False, 0), "flight")
    parts, cur, salt = [done], done.where("p > 0 and p < 1"), 1
    while True:
        # by source while a source fills more than one block, then over all sources
        most = cur.groupBy("source").count().agg(F.max("count"), F.sum("count")).first()
        by_source = (most[0] or 0) > p.block
        last = not by_source and (most[1] or 0) <= p.block
        n = -(-(most[0] if by_source else most[1] or 1) // p.block) if not last else 1
        keyed = cur.select(*cols, F.expr(f"pmod(xxhash64(h, {salt}L), {n}L)").alias("block"))
        nxt = materialize(_fly(keyed, ["source", "block"] if by_source else ["block"], p, last, salt), "flight")
        parts.append(nxt)
        if last:
            break
        cur, salt = nxt.where("p > 0 and p < 1"), salt + 1
    out = parts[0].where("p = 0 or p = 1")
    for t in parts[1:]:
        out = out.unionAll(t.where("p = 0 or p = 1"))
    out = materialize(out.select(*cols), "drawn")
    for t in (units, *parts):
        discard(t)
    return out


def sample(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, source, n_rows, n_tokens, pi, selected) for each unit of ``docs``.

    Tokens are runs of characters other than white space; a null text has none. Rows of
    one doc_id are one unit, with their tokens added and the least of their sources; so are
    rows without a doc_id that have one source and text. A null source is a source. The draw
    is fixed by ``seed`` and the rows, whatever the partitioning; ties among units go by hash.
    Other columns play no part. An empty table gives no rows.
    """
    out = _units(docs, p)
    return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "source", "n_rows", "n_tokens", "pi", (F.col("p") == 1).alias("selected"))


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, of the units that ``sample`` draws: rows of one
    doc_id stay or go together, as do rows without an id of one source and text; null and
    empty texts are units without tokens. At a budget of 1 every row whose source has a weight
    stays. An empty table gives no rows. The drawn ids grow with the documents, so they are
    merged with them at every size and never broadcast."""
    mark, drawn = fresh(docs, "unit", "drawn")
    chosen = _units(docs, p).where("p = 1").select(F.col("h").alias(drawn)).hint("merge")
    marked = docs.withColumn(mark, unit())
    return marked.join(chosen, marked[mark] == chosen[drawn], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
