"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch


def _to_least(pairs: DataFrame) -> DataFrame:
    """(v, m) for each pair (u, v), m the least of u and all its v. The least is summed before the shuffle, so a node with
    very many neighbours is one row a task there; the join back is a plain one, whose large partitions Spark splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) for every node of edges (u, v). Rounds grow with the logarithm of the longest path.

    Every round is a table in the shared folder; two numbers a round come to the driver. Nulls, loops and repeats are dropped.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, name)
    edges = edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long"))
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = scratch.write(pairs, "edges0")
    nodes = scratch.write(edges.select("u").union(edges.select("v")).distinct(), "nodes")
    seen, k = None, 0
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _to_least(large)
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        pairs = scratch.write(small, f"edges{k}")
        if k > 1:
            scratch.drop(f"edges{k - 1}")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(pairs.groupBy("u").agg(F.min("v").alias("least")), "u", "left").select(F.col("u").alias("node"), F.coalesce("least", "u").alias("component"))


def forest(n: int, left, right) -> list[tuple[int, int]]:
    """Edges (i, root) of 0..n-1 that join what the pairs of two index arrays join: at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = root(int(a)), root(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, r) for i in range(n) if (r := root(i)) != i]
