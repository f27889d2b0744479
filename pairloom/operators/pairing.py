"""Pairing of two sets of files.

A set is a DataFrame with path, rel_path, name, size, file_type, extension, content_hash,
simhash and schema_signature. Exact copies meet by hash and ordinal; others by extension
group and kind within a size range, and each left file keeps its best ``topk``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import Config
from ..functions.fingerprint import BITS, estimate_similarity

GROUPS = {
    "text": ("txt", "log", "md", "rst", ""),
    "table": ("csv", "tsv", "tab", "xlsx", "xls", "xlsm", "xlsb", "ods"),
    "code": ("rs", "py", "js", "ts", "java", "c", "cpp", "h", "hpp", "go"),
    "settings": ("json", "yaml", "yml", "toml", "ini", "cfg"),
}
FIELDS = ("path", "rel_path", "name", "size", "file_type", "extension", "content_hash", "simhash", "schema_signature")
RATIO = 10


def extension_group(ext: Column) -> Column:
    """Extensions are compatible if and only if their groups are equal."""
    out = F.concat(F.lit("e:"), ext)
    for name, members in GROUPS.items():
        out = F.when(ext.isin(*members), f"g:{name}").otherwise(out)
    return out


def sizes_compatible(a: Column, b: Column) -> Column:
    """Neither more than ten times the other, or one of them 0."""
    return (a <= 0) | (b <= 0) | ((a <= RATIO * b) & (b <= RATIO * a))


def block_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(extension, pairs, allowed): of the left files of each extension, the pairs with right ones
    of a compatible extension, and how many of these have compatible sizes. No pair is made: files
    are folded to sizes, and the right ones of a size range are the difference of two running
    sums. A group's distinct sizes are one task's work."""
    def sizes(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("g", extension_group(F.col("extension"))).groupBy("g", *by, F.greatest(F.col("size"), F.lit(0)).alias("size")).agg(F.count("*").alias("n"))

    l, r, none = sizes(left, "extension"), sizes(right), F.lit(None).cast("string")
    ends = F.array(  # of a left size, the last right one below the range and the last within
        F.struct(F.ceil(F.col("size") / RATIO).cast("long").alias("at"), F.lit(0).alias("top")), F.struct((F.col("size") * RATIO).alias("at"), F.lit(1).alias("top")),
    )
    asked = l.where("size > 0").select("g", "extension", F.col("n").alias("files"), F.explode(ends).alias("e"), F.lit(0).cast("long").alias("n"))
    asked = asked.select("g", F.when(F.col("e.top") == 1, F.col("e.at")).otherwise(F.col("e.at") - 1).alias("at"), F.lit(1).alias("last"), "extension", "files", F.col("e.top").alias("top"), "n")
    there = r.where("size > 0").select("g", F.col("size").alias("at"), F.lit(0).alias("last"), none.alias("extension"), F.lit(0).cast("long").alias("files"), F.lit(0).alias("top"), "n")
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, 0))
    ranged = asked.unionByName(there).withColumn("upto", upto).where("last = 1").groupBy("g", "extension").agg(F.sum(F.col("files") * F.col("upto") * (2 * F.col("top") - 1)).alias("ranged"))
    own = l.groupBy("g", "extension").agg(F.sum("n").alias("files"), F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("empty"))
    other = r.groupBy("g").agg(F.sum("n").alias("files2"), F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("empty2"))
    x = own.join(other, "g").join(ranged, ["g", "extension"], "left")
    allowed = F.col("empty") * F.col("files2") + (F.col("files") - F.col("empty")) * F.col("empty2") + F.coalesce("ranged", F.lit(0))
    return x.select("extension", (F.col("files") * F.col("files2")).alias("pairs"), allowed.alias("allowed"))


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sets with prefixed columns and the blocking keys."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *[F.col(c).alias(f"{p}_{c}") for c in FIELDS], extension_group(F.col("extension")).alias(f"{p}_group"),
            (F.col("file_type") == "Binary").alias(f"{p}_binary"),
        )

    return side(left, "l"), side(right, "r")


def _out(df: DataFrame, exact: Column, sim: Column) -> DataFrame:
    return df.select(F.col("l_path").alias("path1"), F.col("r_path").alias("path2"), sim.cast("double").alias("est_sim"), exact.alias("exact_hash_match"))


def _same_hash() -> Column:
    return F.coalesce(F.col("l_content_hash") == F.col("r_content_hash"), F.lit(False))


def match_by_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of equal path below their roots."""
    l, r = _sides(left, right)
    return _out(l.join(r, l["l_rel_path"] == r["r_rel_path"]), _same_hash(), estimate_similarity("l_", "r_"))


def match_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left file the most similar one of its name; of equals the last path."""
    l, r = _sides(left, right)
    j = l.join(r, l["l_name"] == r["r_name"]).withColumn("sim", estimate_similarity("l_", "r_"))
    w = Window.partitionBy("l_path").orderBy(F.desc("sim"), F.desc("r_path"))
    return _out(j.withColumn("n", F.row_number().over(w)).where("n = 1"), _same_hash(), F.col("sim"))


def match_exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal hashes one to one, in the order of the paths."""
    l, r = _sides(left, right)

    def nth(df: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy(f"{p}_content_hash").orderBy(f"{p}_path")
        return df.where(F.col(f"{p}_content_hash") != "").withColumn(f"{p}_n", F.row_number().over(w)).select(f"{p}_path", f"{p}_content_hash", f"{p}_n")

    l, r = nth(l, "l"), nth(r, "r")
    return _out(l.join(r, (l["l_content_hash"] == r["r_content_hash"]) & (l["l_n"] == r["r_n"])), F.lit(True), F.lit(1.0))


def _best(topk: int):
    """(left, right) Arrow tables of one block of either side to the best right files of each left one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("path")  # so that the first of equals has the least path
        l, r = ({c: t[c].fill_null(0).to_numpy() for c in ("size", "content", "signature")} for t in (left, right))
        known = {p: {c: t[c].is_valid().to_numpy() for c in ("content", "print", "signature")} for p, t in (("l", left), ("r", right))}
        prints = [t["print"].fill_null(0).to_numpy().view(np.uint64) for t in (left, right)]
        path1, path2, sims = [], [], []
        step = max(1, (1 << 20) // max(1, len(right)))
        for s in range(0, len(left), step):
            e = min(len(left), s + step)

            def both(c):
                return known["l"][c][s:e, None] & known["r"][c][None]

            def same(c):
                return both(c) & (l[c][s:e, None] == r[c][None])

            a, b = l["size"][s:e, None].astype(float), r["size"][None].astype(float)
            sized = (a > 0) & (b > 0)
            sim = np.where(sized, 0.3 * np.minimum(a, b) / np.where(sized, np.maximum(a, b), 1), 0.0)
            sim[same("signature")] = 0.5
            distance = np.bitwise_count(prints[0][s:e, None] ^ prints[1][None])
            sim = np.where(both("print"), 1 - distance / BITS, sim)
            sim[same("content")] = 1.0
            sim[~(~sized | ((a <= RATIO * b) & (b <= RATIO * a)))] = -1.0
            rows = np.arange(e - s)
            for _ in range(min(topk, len(right))):
                j = sim.argmax(1)
                v = sim[rows, j]
                ok = v >= 0
                path1.append(s + rows[ok])
                path2.append(j[ok])
                sims.append(v[ok])
                sim[rows, j] = -1.0
        i, j = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (path1, path2))
        return pa.table([left["path"].take(pa.array(i)), right["path"].take(pa.array(j)), pa.array(np.concatenate(sims or [np.zeros(0)]))], ["l_path", "r_path", "sim"])

    return run


def match_similar(left: DataFrame, right: DataFrame, topk: int = 3, block: int = 16_384) -> DataFrame:
    """The ``topk`` best right files of each left file among those it may be compared with,
    with their rank; of equals the first path.

    An exact top-k compares every pair of files of one extension group and kind: in blocks of
    about ``block`` files of either side, each pair of blocks a task's work on arrays, from which
    the best of each left file go on. No group is one task's work, however large.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.select(
            "path", F.col("size").cast("long").alias("size"), F.xxhash64(extension_group(F.col("extension")), F.col("file_type") == "Binary").alias("g"),
            *[F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(n) for c, n in (("content_hash", "content"), ("schema_signature", "signature"))],
            F.col("simhash").cast("long").alias("print"),
        )

    l, r = side(left), side(right)
    n1, n2 = (x.groupBy("g").agg(F.ceil(F.count("*") / block).alias(n)) for x, n in ((l, "n1"), (r, "n2")))
    blocks = n1.join(n2, "g")

    def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        x = df.join(blocks, "g").withColumn(mine, F.pmod(F.xxhash64("path"), F.col(own)))
        named = ("g", mine, "path", "size", "content", "signature", "print")
        return x.select(*[F.col(c).alias(c) for c in named], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(theirs))

    a = spread(l, "n1", "n2", "i", "j").groupBy("g", "i", "j")
    b = spread(r, "n2", "n1", "j", "i").groupBy("g", "i", "j")
    found = a.cogroup(b).applyInArrow(_best(topk), "l_path string, r_path string, sim double")
    w = Window.partitionBy("l_path").orderBy(F.desc("sim"), "r_path")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)
    return best.select(F.col("l_path").alias("path1"), F.col("r_path").alias("path2"), F.col("sim").alias("est_sim"), F.lit(False).alias("exact_hash_match"), "rank")


def match_all(left: DataFrame, right: DataFrame, topk: int = 3, max_pairs: int | None = None) -> DataFrame:
    """Exact copies first; the files left on both sides by similarity; ``max_pairs`` keeps
    the most similar, if given."""
    exact = match_exact(left, right)
    l = left.join(exact.select(F.col("path1").alias("path")), "path", "left_anti")
    r = right.join(exact.select(F.col("path2").alias("path")), "path", "left_anti")
    out = exact.withColumn("rank", F.lit(0)).unionByName(match_similar(l, r, topk))
    if max_pairs is not None:
        out = out.orderBy(F.desc("est_sim"), F.desc("exact_hash_match"), "path1", "rank").limit(max_pairs)
    return out.drop("rank")


def candidates(left: DataFrame, right: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(path1, path2, est_sim, exact_hash_match) by the pairing of ``cfg``."""
    if cfg.pairing == "same-path":
        return match_by_path(left, right)
    if cfg.pairing == "same-name":
        return match_by_name(left, right)
    return match_all(left, right, cfg.topk, cfg.max_pairs)
