"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROUND = 2_000_000
DEALS, HUB = 64, 50_000  # a node of more edges than these is dealt out


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        if up.setdefault(x, x) == x:
            return x
        path = []
        while up[x] != x:
            path.append(x)
            x = up[x]
        for y in path:
            up[y] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars; after every ``ROUND`` edges the memory is let go."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > ROUND:
            yield stars()
            forest = Forest()
    yield stars()


def _with_least(edges: DataFrame, hubs: bool) -> DataFrame:
    """Edges with ``m``, the least neighbour of ``u``; where there are hubs, the edges of a node are dealt out over ``DEALS`` tasks."""
    if not hubs:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    dealt = edges.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALS)))
    part = dealt.groupBy("u", "deal").agg(F.min("v").alias("m"))
    least = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("deal").alias("deals"))
    return dealt.join(least.select("u", "m", F.explode("deals").alias("deal")), ["u", "deal"])


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hubs).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    near = _with_least(edges, hubs)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b) of longs; the component is its smallest member."""
    edges = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "components")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(edges)
    while seen[0]:
        # on either side of its edges a node is counted
        ends = edges.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        hubs = not ends.where(F.col("n") > HUB).isEmpty()
        edges = staged(_small_star(_large_star(edges, hubs), hubs), "components")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
