"""Reachability in a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.plans import chains
from sidewise.plans.chains import DEGREE, VERTEX
from sidewise.plans.storage import cut

PARENT, CHILD = "parent", "child"
UP, DOWN = "up", "down"
# Levels that are taken one by one before chains are looked for.
PLAIN_LEVELS = 24
# A frontier is broadcast only while its measured size stays below this; larger ones are joined by shuffling.
BROADCAST_BYTES = 32 * 1024 * 1024


def closure(
    edges: DataFrame, seeds: DataFrame, direction: str = DOWN, max_degree: int | None = None, stored: bool = False
) -> DataFrame:
    """``vertex, degree``: the seeds (degree 0) and everything reachable from them, with the shortest distance.

    ``edges`` holds ``parent, child`` and ``seeds`` holds ``vertex``; any type with equality will do. One pass per
    degree: the frontier meets the edges, what was seen before is dropped, the rest is stored and becomes the next
    frontier. Cycles end because vertices are visited once. Graphs deeper than ``PLAIN_LEVELS`` are gone on with by
    ``plans.chains``, which takes long chains in one step.
    """
    if direction not in (UP, DOWN):
        raise ComparisonError(f"Direction is {UP!r} or {DOWN!r}, not {direction!r}")
    return closures(edges, seeds, [direction], max_degree, stored)[0]


def closures(
    edges: DataFrame, seeds: DataFrame, directions: Sequence[str], max_degree: int | None = None, stored: bool = False
) -> list[DataFrame]:
    """The closure in each direction; edges and seeds are computed once for all. ``stored`` edges are read as they are."""
    steps = edges.select(PARENT, CHILD)
    if not stored:
        steps = cut(steps, "edges")
    start = cut(seeds.select(VERTEX).distinct(), "seeds")
    return [_spread(steps, start, direction, max_degree) for direction in directions]


def _spread(steps: DataFrame, start: DataFrame, direction: str, max_degree: int | None) -> DataFrame:
    """All levels reached from stored seeds; each level is stored before the next is planned."""
    levels = [start.withColumn(DEGREE, F.lit(0))]
    size = _size(start)
    while size.count and (max_degree is None or len(levels) <= max_degree):
        if max_degree is None and len(levels) > PLAIN_LEVELS:
            source, target = (PARENT, CHILD) if direction == DOWN else (CHILD, PARENT)
            onward = chains.spread(steps.select(F.col(source).alias("s"), F.col(target).alias("t")), levels[-1])
            seen = reduce(DataFrame.unionByName, levels).unionByName(onward)
            return cut(seen.groupBy(VERTEX).agg(F.min(DEGREE).alias(DEGREE)), "closure")
        level = cut(_next_level(steps, levels, direction, size.bytes <= BROADCAST_BYTES), "level")
        size = _size(level)
        if size.count:
            levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _next_level(steps: DataFrame, levels: list[DataFrame], direction: str, small: bool) -> DataFrame:
    source, target = (PARENT, CHILD) if direction == DOWN else (CHILD, PARENT)
    # The frontier has each vertex once: the join emits at most one row per edge, however many edges a hub has.
    frontier = levels[-1].select(VERTEX)
    reached = steps.join(F.broadcast(frontier) if small else frontier, F.col(source) == F.col(VERTEX))
    seen = reduce(DataFrame.unionByName, levels).select(F.col(VERTEX).alias("__seen"))
    return (
        reached.select(F.col(target).alias(VERTEX))
        .filter(F.col(VERTEX).isNotNull())
        .distinct()
        .join(seen, F.col(VERTEX) == F.col("__seen"), "left_anti")
        .withColumn(DEGREE, F.lit(len(levels)))
    )


class _Size(NamedTuple):
    count: int
    bytes: int


def _size(level: DataFrame) -> _Size:
    width = F.octet_length(F.col(VERTEX).cast("string")) + 16
    row = level.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return _Size(row["n"], row["b"])
