"""Connected components of an undirected graph, as joins over edges that shrink to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenetlog.llm import common


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours its least neighbour (or itself)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Each node (a > b everywhere) ties itself and its other smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    passed = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that an edge (a, b) touches; label: the component's least node.

    Both steps alternate until nothing changes; the number of rounds grows with the
    logarithm of the graph's size. Loops, doubled edges and empty input are fine.
    """
    current = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                            "component-edges")
    mark = _mark(current)
    while True:
        following = common.stored(_smaller_to_least(_towards_least(current)), "component-edges")
        now = _mark(following)
        common.drop_stored(current)
        current = following
        if now == mark:
            break
        mark = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
