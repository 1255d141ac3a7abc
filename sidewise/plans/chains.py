"""Reachability in deep graphs: chains are contracted, so that a chain of any length costs a few steps.

A link is an edge that is the only one out of its source and the only one into its target. Links form chains; the place of a
vertex in its chain is found by pointer doubling, in as many rounds as the logarithm of the longest chain. Chains are cut into
segments of ``SEGMENT`` places. All other edges lead from the end of a segment to the start of one, so a search over segments
finds when each start is reached, and the places behind follow from it by one window per segment.

The search takes one round per segment on the longest of the shortest paths. Deep graphs without chains (a vertex with two
ways on at every step) gain nothing by it. Links that run in a circle belong to no chain and are taken one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sidewise.plans.storage import cut

VERTEX, DEGREE = "vertex", "degree"
SEGMENT = 1024


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``vertex, degree`` of everything reachable over ``edges(s, t)`` from ``seeds(vertex, degree)``, those included.

    Degrees are the smallest sums of a seed's degree and the edges from it. A vertex may be a seed once.
    """
    known = cut(edges.filter("s is not null and t is not null").distinct(), "deep-edges")
    links = cut(_links(known), "links")
    places = cut(_places(known, links, seeds), "places")
    ends = cut(places.groupBy("segment").agg(F.max("place").alias("end")), "segment-ends")
    steps = cut(_segment_edges(known, links, places), "segment-edges")
    start = cut(seeds.select(F.col(VERTEX).alias("seed"), F.col(DEGREE).cast("long").alias("d")).join(places, F.col("seed") == F.col(VERTEX)), "entries")
    leaving = start.join(ends, "segment").groupBy("segment").agg(F.min(F.col("d") + F.col("end") - F.col("place")).alias("leaves"))
    reached = _search(steps, ends, leaving)
    return _behind(places, start, reached)


def _links(edges: DataFrame) -> DataFrame:
    """``s, t`` of the edges that are alone at both ends."""
    alone_out = edges.groupBy(F.col("s").alias("one_s")).count().filter("count = 1").drop("count")
    alone_in = edges.groupBy(F.col("t").alias("one_t")).count().filter("count = 1").drop("count")
    found = edges.filter(F.col("s") != F.col("t"))
    return found.join(alone_out, F.col("s") == F.col("one_s"), "left_semi").join(alone_in, F.col("t") == F.col("one_t"), "left_semi")


def _places(edges: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``vertex, segment, place`` of all vertices."""
    pointers = cut(links.select(F.col("t").alias("v"), F.col("s").alias("head"), F.lit(1).cast("long").alias("hops")), "pointers")
    count, covered = pointers.count(), 1
    open_ends = count
    while open_ends and covered <= count:
        via = pointers.select(F.col("v").alias("via"), F.col("head").alias("further"), F.col("hops").alias("more"))
        pointers = cut(
            pointers.join(via, F.col("head") == F.col("via"), "left").select(
                "v", F.coalesce("further", "head").alias("head"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")
            ),
            "pointers",
        )
        covered *= 2
        open_ends = pointers.join(links.select(F.col("t").alias("inner")), F.col("head") == F.col("inner"), "left_semi").count()
    # What still points into a chain runs in a circle.
    ended = pointers.join(links.select(F.col("t").alias("inner")), F.col("head") == F.col("inner"), "left_anti")
    vertices = edges.select(F.col("s").alias(VERTEX)).unionByName(edges.select(F.col("t").alias(VERTEX))).unionByName(seeds.select(VERTEX))
    placed = vertices.distinct().join(ended, F.col(VERTEX) == F.col("v"), "left")
    hops = F.coalesce("hops", F.lit(0))
    segment = F.struct(F.coalesce("head", VERTEX).alias("head"), F.floor(hops / SEGMENT).alias("number"))
    return placed.select(VERTEX, segment.alias("segment"), (hops % SEGMENT).alias("place"))


def _segment_edges(edges: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """``segment, onto``: edges from the end of a segment to the start of one; those inside a segment are left out."""
    of_s = places.select(F.col(VERTEX).alias("at_s"), "segment")
    of_t = places.select(F.col(VERTEX).alias("at_t"), F.col("segment").alias("onto"))
    marked = edges.join(links.select("s", "t", F.lit(True).alias("linked")), ["s", "t"], "left")
    both = marked.join(of_s, F.col("s") == F.col("at_s")).join(of_t, F.col("t") == F.col("at_t"))
    return both.filter(F.col("linked").isNull() | (F.col("segment") != F.col("onto"))).select("segment", "onto").distinct()


def _search(steps: DataFrame, ends: DataFrame, leaving: DataFrame) -> DataFrame:
    """``segment, d``: when the start of each segment is reached, from when segments are left."""
    onto = ends.select(F.col("segment").alias("of"), "end")
    best = None
    while True:
        arriving = steps.join(leaving, "segment").groupBy(F.col("onto").alias("segment")).agg(F.min(F.col("leaves") + 1).alias("d"))
        if best is None:
            better = cut(arriving, "arrivals")
        else:
            known = best.select(F.col("segment").alias("known"), F.col("d").alias("before"))
            better = arriving.join(known, F.col("segment") == F.col("known"), "left")
            better = cut(better.filter(F.col("before").isNull() | (F.col("d") < F.col("before"))).select("segment", "d"), "arrivals")
        best = better if best is None else cut(best.unionByName(better).groupBy("segment").agg(F.min("d").alias("d")), "reached")
        if better.isEmpty():
            return best
        leaving = better.join(onto, F.col("segment") == F.col("of")).select("segment", (F.col("d") + F.col("end")).alias("leaves"))


def _behind(places: DataFrame, start: DataFrame, reached: DataFrame) -> DataFrame:
    """All places behind an entry of their segment, with the smallest degree; a segment has a bounded number of places."""
    entries = start.select("segment", "place", "d").unionByName(reached.select("segment", F.lit(0).cast("long").alias("place"), "d"))
    entered = places.join(entries.select(F.col("segment").alias("entered")).distinct(), F.col("segment") == F.col("entered"), "left_semi")
    rows = entered.select("segment", "place", VERTEX, F.lit(None).cast("long").alias("lead")).unionByName(
        entries.groupBy("segment", "place").agg(F.min(F.col("d") - F.col("place")).alias("lead")).withColumn(VERTEX, F.lit(None).cast(places.schema[VERTEX].dataType)),
    )
    upto = Window.partitionBy("segment").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    led = rows.withColumn("least", F.min("lead").over(upto))
    return led.filter(F.col("lead").isNull() & F.col("least").isNotNull()).select(
        VERTEX, (F.col("place") + F.col("least")).cast("int").alias(DEGREE)
    )
