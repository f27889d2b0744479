"""Tables kept in the shared folder, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import discard, materialize


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Alternating large-star and small-star (Kiveris et al. 2014): each round is two
    aggregations and joins on the node, all combined map-side, with no state on any one
    machine; rounds grow with the logarithm of the diameter. Loops and null ends are
    ignored (a node with only a loop has no row); repeated edges count once. The result is a
    kept table.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Links the larger (large) or smaller neighbours of each node to its least neighbour."""
        if large:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
            j = both.join(least, both["a"] == least["u"]).where("b > a")
            return j.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        least = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        j = e.join(least, e["a"] == least["u"])
        return (
            j.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        )

    x, y = F.col(a), F.col(b)
    cur = materialize(
        edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges"
    )

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = sign(cur)
    while True:
        new = materialize(star(star(cur, True), False), "edges")
        now = sign(new)
        discard(cur)
        cur = new
        if now == seen:
            break
        seen = now
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(stars.unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    discard(cur)
    return out
