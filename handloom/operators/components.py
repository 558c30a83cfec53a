"""Connected components of an undirected graph by alternating star contraction.

Each round hangs every node's larger neighbours, then its smaller ones, on the least neighbour. The tree height falls by
a constant factor or more, so rounds are few whatever the diameter. Rows that carry a hub are combined before they travel,
and a hub's edges are spread where they meet its least neighbour; no task collects a component or the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.runtime import HOT_ROWS, materialise, quoted, scratch, spread_join

ROUNDS = 60


def _hang(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """``(v, m)``: every edge's far end with the least neighbour of its near end."""
    if not many:
        return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spread_join(edges, materialise(least, "least"), "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return _hang(both.filter("v > u"), least, many).filter("u <> v").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if many:
        least = materialise(least, "least")
    return _hang(down, least, many).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame):
    h = F.xxhash64("u", "v")
    return edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()


def components(nodes: DataFrame, node: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node: component is the least node that it is joined to, directly or through others.

    * nodes without an edge: a component of their own; nodes that only edges name: included;
    * self-loops, edges in both directions, repeated edges: no effect; null ends and null nodes: left out;
    * no edges or no nodes: what there is; further columns are not carried on.
    """
    links = edges.select(quoted(src).alias("u"), quoted(dst).alias("v")).filter("u is not null and v is not null")
    named = nodes.select(quoted(node).alias("node")).filter("node is not null")
    with scratch(edges.sparkSession):
        links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        named = named.unionByName(links.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
        current = materialise(links.filter("u <> v"), "edges")
        before = _digest(current)
        for _ in range(ROUNDS if before[0] else 0):
            many = before[0] > HOT_ROWS
            current = materialise(_large_star(current, many), "edges")
            current = materialise(_small_star(current, many), "edges")
            now = _digest(current)
            if now == before:
                break
            before = now
        else:
            if before[0]:
                raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
        hung = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        found = named.join(hung, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        return materialise(found, "components", keep=True)
