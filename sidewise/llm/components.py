"""Connected components of an edge table, by contracting neighbourhoods to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sidewise.plans.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``); the component is its smallest node.

    Two steps alternate (Kiveris et al., 2014): neighbours above a node move to the smallest neighbour, then those below it
    do. Both keep components whole, and the edges end as stars around the smallest node after a few rounds. A hub's
    edges are a plain equi-join that adaptive execution may split, and its minimum is aggregated before the shuffle.
    """
    current = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        current = cut(_small_star(_large_star(current)), "edges")
        # Stars do not change any more; equal sums of two hashes say so without comparing tables.
        row = current.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
        ).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    centres = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        centres.select("node", F.col("node").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
    return (
        both.filter("b > a").join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    ).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them. Edges point down (``a > b``)."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), "low")
    below = edges.join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return below.unionByName(lowest.select(F.col("n").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()
