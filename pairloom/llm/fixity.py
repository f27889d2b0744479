"""WARC fixity: Merkle trees over records in offset order, compared between replicas.

A file holds the records of ``16 ** LEVELS`` consecutive ids; a leaf is a slot of it. A
missing record empties its slot and shifts no other. The hash of an inner node is that
of its children's in order. All texts are hashed once, where they are read; what is
shuffled is a hash and a length per record. Replicas are compared root by root, and a
level's nodes only where their parents differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .plumbing import materialize

LEVELS = 3  # below the root
FANOUT_BITS = 4
SLOTS = 1 << (LEVELS * FANOUT_BITS)


def _field(c: Column) -> Column:
    """Null and empty text differ."""
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c))


def leaves(records: DataFrame) -> DataFrame:
    """(file, slot, hash, first, past): the hash of the records of each occupied slot and
    their range of byte offsets in the file."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    rows = records.select(
        F.expr(f"cast((page_id - pmod(page_id, {SLOTS}L)) div {SLOTS}L as bigint)").alias("file"),
        F.expr(f"pmod(page_id, {SLOTS}L)").alias("slot"),
        F.sha2(F.concat(_field(url), F.lit("\n"), _field(html)), 256).alias("h"),
        (F.coalesce(F.octet_length(url), F.lit(0)) + F.coalesce(F.octet_length(html), F.lit(0))).cast("long").alias("n"),
    )
    slots = rows.groupBy("file", "slot").agg(F.array_sort(F.collect_list("h")).alias("hs"), F.sum("n").alias("n"))
    past = F.sum("n").over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return slots.select(
        "file", "slot", F.sha2(F.array_join("hs", ""), 256).alias("hash"), (past - F.col("n")).alias("first"), past.alias("past")
    )


def nodes(leaf: DataFrame, height: int) -> DataFrame:
    """(file, node, hash, first, past) of the nodes ``height`` above the leaves."""
    out = leaf.select("file", F.col("slot").alias("node"), "hash", "first", "past")
    for _ in range(height):
        parent = F.shiftright("node", FANOUT_BITS)
        out = out.groupBy("file", parent.alias("up")).agg(
            F.array_join(F.expr("transform(array_sort(collect_list(struct(node, hash))), x -> concat(x.node, ':', x.hash))"), ";").alias("hs"),
            F.min("first").alias("first"), F.max("past").alias("past"),
        ).select("file", F.col("up").alias("node"), F.sha2("hs", 256).alias("hash"), "first", "past")
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(height, file, node, page_id, status, first, past): every tree node in which
    replica ``b`` departs from ``a``, from the file's root (height 3) down to the record
    (height 0); status is ``corrupt``, ``missing`` (only in a) or ``extra`` (only in b),
    first and past the byte range in a, of an extra node in b.

    Records are (page_id, url, html). Null fields differ from empty ones; records of
    one page_id share a leaf, in the order of their hashes; those without a page_id are
    one leaf of a file of their own. Equal or empty replicas give no rows.
    """
    la, lb = materialize(leaves(a), "leaves"), materialize(leaves(b), "leaves")
    out = parents = None
    for height in range(LEVELS, -1, -1):
        na, nb = nodes(la, height), nodes(lb, height)
        if parents is not None:
            def below(n):
                return n.join(parents, n["file"].eqNullSafe(parents["pf"]) & F.shiftright(n["node"], FANOUT_BITS).eqNullSafe(parents["pn"]), "left_semi")

            na, nb = below(na), below(nb)
        x, y = na.alias("x"), nb.alias("y")
        j = x.join(y, F.col("x.file").eqNullSafe(F.col("y.file")) & F.col("x.node").eqNullSafe(F.col("y.node")), "full")
        diff = j.where(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select(
            F.lit(height).alias("height"), F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.node", "y.node").alias("node"),
            F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("corrupt").alias("status"),
            F.coalesce("x.first", "y.first").alias("first"), F.coalesce("x.past", "y.past").alias("past"),
        )
        diff = materialize(diff, "differences")
        parents = diff.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        out = diff if out is None else out.unionAll(diff)
    page = F.when(F.col("height") == 0, F.col("file") * SLOTS + F.col("node"))
    return out.select("height", "file", "node", page.alias("page_id"), "status", "first", "past")


def decayed(records: DataFrame) -> DataFrame:
    """A replica with simulated decay: of the records, by hash of their url, one in 64
    has a byte more and one in 64 is gone."""
    h = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    html = F.when(h < "04", F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))
    return records.where(~h.between("04", "07")).select("page_id", "url", html.alias("html"))


def oracle() -> str:
    """The audit of ``pages`` against ``decayed`` in DuckDB; it compares all nodes of each level."""
    def tree(name: str, rows: str) -> str:
        sql = f"""
{name}r AS ({rows}),
{name}s AS (SELECT (page_id - (page_id % {SLOTS} + {SLOTS}) % {SLOTS}) // {SLOTS} AS file, (page_id % {SLOTS} + {SLOTS}) % {SLOTS} AS slot,
  sha256(CASE WHEN url IS NULL THEN 'n' ELSE 'v' || url END || chr(10) || CASE WHEN html IS NULL THEN 'n' ELSE 'v' || html END) AS h,
  coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS n FROM {name}r),
{name}l AS (SELECT file, slot, sha256(string_agg(h, '' ORDER BY h)) AS hash, sum(n) AS n FROM {name}s GROUP BY ALL),
{name}0 AS (SELECT file, slot AS node, hash, sum(n) OVER w - n AS first, sum(n) OVER w AS past FROM {name}l WINDOW w AS (PARTITION BY file ORDER BY slot ROWS UNBOUNDED PRECEDING))"""
        for k in range(1, LEVELS + 1):
            sql += f""",
{name}{k} AS (SELECT file, node >> {FANOUT_BITS} AS node, sha256(string_agg(node || ':' || hash, ';' ORDER BY node)) AS hash, min(first) AS first, max(past) AS past FROM {name}{k - 1} GROUP BY file, node >> {FANOUT_BITS})"""
        return sql

    h = "substr(sha256(coalesce(url, '')), 1, 2)"
    b = f"SELECT page_id, url, CASE WHEN {h} < '04' THEN coalesce(html, '') || '~' ELSE html END AS html FROM pages WHERE {h} NOT BETWEEN '04' AND '07'"
    parts = [
        f"""SELECT CAST({k} AS INTEGER) AS height, CAST(coalesce(x.file, y.file) AS BIGINT) AS file, CAST(coalesce(x.node, y.node) AS BIGINT) AS node,
 {'CAST(coalesce(x.file, y.file) * ' + str(SLOTS) + ' + coalesce(x.node, y.node) AS BIGINT)' if k == 0 else 'CAST(NULL AS BIGINT)'} AS page_id,
 CASE WHEN y.hash IS NULL THEN 'missing' WHEN x.hash IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
 CAST(coalesce(x.first, y.first) AS BIGINT) AS first, CAST(coalesce(x.past, y.past) AS BIGINT) AS past
FROM left{k} x FULL JOIN right{k} y ON x.file IS NOT DISTINCT FROM y.file AND x.node IS NOT DISTINCT FROM y.node WHERE x.hash IS DISTINCT FROM y.hash"""
        for k in range(LEVELS, -1, -1)
    ]
    return "WITH " + tree("left", "SELECT page_id, url, html FROM pages") + "," + tree("right", b) + "\n" + "\nUNION ALL\n".join(parts)
