"""Connected components of a graph of edges, by alternating large and small stars, on DataFrames.

Each part's edges are first replaced by a spanning forest of their own, so that a part passes on no more than an edge
for each node it has seen; then parts are united up to a bound on edges. Unless that tells all, each node points its
larger neighbours, and next its smaller ones, at the least node near it, until every node has one parent that has none;
every round is written to the shared folder. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import written


#: Edges that one task holds at a time.
EDGES_A_TASK = 500_000


class UnionFind:
    """Roots are the least members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x] = top
            x = up
        return top

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.root(x)) != x]


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of a part's edges, as stars (a, least member)."""
    seen = UnionFind()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            seen.unite(a, b)
    yield pd.DataFrame(seen.stars(), columns=["a", "b"], dtype="int64")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node is pointed at the node's least neighbour (or itself). Small: so is every smaller one, and the node."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    pointed = both.join(least, "u")
    if large:
        return pointed.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    moved = pointed.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(stars: DataFrame) -> bool:
    """Every node has one parent at most, and no parent has one: the components are told."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("child")).union(stars.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("child").alias("up"), F.min("child").alias("least"))
    return seen.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).alias("n")).collect()[0]["n"] == 0


def components(edges: DataFrame, what: str, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(a, b) of long edges to (node, component): the least node reachable. Nodes without edges are not in it, nor are the least ones."""
    schema = "a long, b long"
    parts = written(edges.mapInPandas(forest, schema), f"{what}-parts")
    # what the parts leave is mostly little: as many parts as a task can unite are read together
    stars = written(parts.coalesce(max(1, -(-parts.count() // edges_a_task))).mapInPandas(forest, schema), f"{what}-forest")
    while not _settled(stars):
        stars = written(_star(_star(stars, True), False), f"{what}-stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
