"""Minimum-cost-flow resharding: the fewest bytes moved from old shards to new capacities.

A shard falls into blocks by hash of doc_id; a flow network of the old shards, the new
ones and a hub (staying is free, a byte through the hub costs 1) gives the bytes that go
from each old shard to each new one; whole blocks fill these flows. Sizes are counted in
two scans, the network has as many nodes as shards and lies on the driver, and the plan,
a row per block, is broadcast to the documents: no text is shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .plumbing import fresh

NONE = "(none)"  # the shard of documents without one


@dataclass(frozen=True)
class Params:
    """New shards are the old ones, of equal capacity: their mean size and ``slack``.
    A block holds about ``1 / blocks`` of a mean shard; there are at most ``max_rows``
    blocks and one a shard, so that the plan stays small enough to plan on the driver and
    to broadcast: with more than max_rows / blocks shards, blocks are larger."""

    slack: float = 0.05
    blocks: int = 256
    max_rows: int = 500_000


class Network:
    """Minimum-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self):
        self.edges: list[list] = []  # to, capacity left, cost; the reverse of edge e is e ^ 1
        self.out: dict = defaultdict(list)

    def add(self, a, b, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def flow(self, e: int) -> int:
        return self.edges[e ^ 1][1]

    def solve(self, source, sink) -> tuple[int, int]:
        """(flow, cost) of the greatest flow of least cost."""
        potential, total, cost = defaultdict(int), 0, 0
        while True:
            dist, via, heap, n = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b, cap, c = self.edges[e]
                    if cap > 0:
                        x = d + c + potential[a] - potential[b]
                        if b not in dist or x < dist[b]:
                            dist[b], via[b], n = x, e, n + 1
                            heapq.heappush(heap, (x, n, b))
            if sink not in dist:
                return total, cost
            far = max(dist.values())
            for a in self.out:
                potential[a] += dist.get(a, far)
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.edges[via[b] ^ 1][0]
            by = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= by
                self.edges[e ^ 1][1] += by
                cost += by * self.edges[e][2]
            total += by


def transfers(sizes: dict[str, int], capacities: dict[str, int]) -> dict[tuple[str, str], int]:
    """Bytes from each old shard to each new one (staying included) that move the fewest
    bytes. Raises ValueError where the capacities can't hold the sizes."""
    net = Network()
    for s, n in sizes.items():
        net.add("source", ("old", s), n, 0)
        net.add(("old", s), "hub", n, 1)
    stay = {s: net.add(("old", s), ("new", s), n, 0) for s, n in sizes.items() if s in capacities}
    into = {}
    for s, c in capacities.items():
        into[s] = net.add("hub", ("new", s), c, 0)
        net.add(("new", s), "sink", c, 0)
    total, _ = net.solve("source", "sink")
    if total < sum(sizes.values()):
        raise ValueError(f"capacities hold {total} of {sum(sizes.values())} bytes")
    out = {(s, s): net.flow(e) for s, e in stay.items() if net.flow(e)}
    give = [[s, n - out.get((s, s), 0)] for s, n in sorted(sizes.items())]
    take = [[s, net.flow(e)] for s, e in sorted(into.items())]
    i = j = 0
    while i < len(give) and j < len(take):  # every pairing through the hub costs the same
        by = min(give[i][1], take[j][1])
        if by:
            out[give[i][0], take[j][0]] = out.get((give[i][0], take[j][0]), 0) + by
        give[i][1] -= by
        take[j][1] -= by
        i, j = i + (not give[i][1]), j + (not take[j][1])
    return out


def assign(blocks: dict[tuple[str, int], int], capacities: dict[str, int], strict: bool = True) -> dict[tuple[str, int], str]:
    """New shard of each (old shard, block): whole blocks, so a flow is met to within a block.
    A block that fits nowhere is an error, or else (not ``strict``) goes where most room is left."""
    sizes: dict[str, int] = defaultdict(int)
    of: dict[str, list] = defaultdict(list)
    for (s, b), n in sorted(blocks.items()):
        sizes[s] += n
        of[s].append((n, b))
    flows: dict[str, dict[str, int]] = defaultdict(dict)
    for (s, t), n in transfers(dict(sizes), capacities).items():
        flows[s][t] = n
    room, plan = dict(capacities), {}
    later = []
    for s in sorted(of):
        want = dict(flows[s])
        for n, b in sorted(of[s], key=lambda x: (-x[0], x[1])):
            # the largest block goes where most is wanted: at home if it can stay
            fits = [t for t, w in want.items() if w >= n and room[t] >= n]
            t = max(fits, key=lambda t: (t == s, want[t], t), default=None)
            if t is None:
                later.append((n, s, b))
                continue
            want[t] -= n
            room[t] -= n
            plan[s, b] = t
    for n, s, b in sorted(later, key=lambda x: (-x[0], x[1:])):  # remainders under a block
        t = s if room.get(s, -1) >= n else max(room, key=lambda t: (room[t], t))
        if room[t] < n and strict:
            raise ValueError(f"a block of {n} bytes fits no shard: at most {room[t]} bytes are left in one")
        room[t] -= n
        plan[s, b] = t
    return plan


def _bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def reshard(docs: DataFrame, p: Params = Params(), capacities: dict[str, int] | None = None, shard: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, with old_shard, block, new_shard, moved and
    affected (the new shard's file must be rewritten: it gains or loses a row).

    A row's size is the bytes of its text, 0 for null; a null shard is the shard
    ``(none)``; a null doc_id has a hash like any other. Rows of equal doc_id and shard
    stay together. A column of ``docs`` that is named like one of those added is replaced,
    other names never clash. Given ``capacities`` are kept, or ValueError is raised; by default,
    where a block (say, one long text) fits no shard, that with most room goes over. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    old, size = F.coalesce(F.col(shard).cast("string"), F.lit(NONE)), _bytes()
    sizes = {r.s: r.n for r in docs.groupBy(old.alias("s")).agg(F.sum(size).alias("n")).collect()}
    given = capacities is not None
    if not given:
        capacities = {s: int(sum(sizes.values()) / len(sizes) * (1 + p.slack)) + 1 for s in sizes} if sizes else {}
    blocks = max(1, min(p.blocks * max(1, len(sizes)), p.max_rows))
    unit = max(1, sum(sizes.values()) // blocks)
    count = {s: max(1, -(-n // unit)) for s, n in sizes.items()}
    key, number, key2, number2 = fresh(docs, "shard", "blocks", "shard2", "block2")
    added = ["old_shard", "block", "new_shard", "moved", "affected"]
    rest = [c for c in docs.columns if c.lower() not in added]
    home, place = fresh(docs, "old", "place")
    counts = spark.createDataFrame(sorted(count.items()), f"`{key}` string, `{number}` long")
    keyed = docs.withColumn(home, old).join(F.broadcast(counts), F.col(home) == F.col(key))  # a row per shard
    keyed = keyed.withColumn(place, F.expr(f"pmod(xxhash64(doc_id), `{number}`)"))
    rows = keyed.groupBy(home, place).agg(F.sum(size).alias("n")).collect()
    plan = assign({(r[0], r[1]): r[2] for r in rows}, capacities, strict=given)
    touched = {x for (s, _), t in plan.items() if s != t for x in (s, t)}
    table = spark.createDataFrame(
        [(s, b, t, s != t, t in touched) for (s, b), t in sorted(plan.items())],
        f"`{key2}` string, `{number2}` long, new_shard string, moved boolean, affected boolean",
    )
    clean = keyed.select(*[F.col(f"`{c}`") for c in rest], home, place)
    out = clean.join(F.broadcast(table), (F.col(home) == F.col(key2)) & (F.col(place) == F.col(number2)))  # p.max_rows and one a shard
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col(home).alias("old_shard"), F.col(place).alias("block"), "new_shard", "moved", "affected")


def rewrite(resharded: DataFrame, path: str) -> None:
    """Writes the affected new shards, and only them, as ``path``/new_shard=<name>/, with all
    columns of the documents; where none is affected, or the table is empty, no shard is written."""
    resharded.where("affected").drop("old_shard", "block", "moved", "affected").write.partitionBy("new_shard").parquet(path)
