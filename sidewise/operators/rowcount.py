"""Row counts of many tables at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sidewise.functions.labels import (
    delta_label,
    delta_pct_of_base,
    delta_pct_of_current,
    direction,
    presence_status,
)
from sidewise.plans.sides import BASE, CURRENT
from sidewise.sources.environments import OK, EnvPair


def row_count(env: EnvPair, names: Sequence[str], side: str = CURRENT) -> DataFrame:
    """``name, row_count, status`` for each table; the count is NULL unless the status is ok."""
    return _counts(env, names, (side,)).select("name", "row_count", "status")


def row_count_diff(env: EnvPair, names: Sequence[str]) -> DataFrame:
    """``name, base, curr, base_status, curr_status`` for each table."""
    of = {side: F.col("side") == side for side in (BASE, CURRENT)}
    return (
        _counts(env, names, (BASE, CURRENT))
        .groupBy("name")
        .agg(
            F.max(F.when(of[BASE], F.col("row_count"))).alias("base"),
            F.max(F.when(of[CURRENT], F.col("row_count"))).alias("curr"),
            F.max(F.when(of[BASE], F.col("status"))).alias("base_status"),
            F.max(F.when(of[CURRENT], F.col("status"))).alias("curr_status"),
        )
    )


def row_count_labels(counts: DataFrame) -> DataFrame:
    """A row-count diff with its delta as number and text, percentages of either side, direction and status."""
    base, current = F.col("base"), F.col("curr")
    return counts.select(
        "name",
        "base",
        "curr",
        (current - base).alias("delta"),
        delta_label(base, current).alias("delta_label"),
        delta_pct_of_base(base, current).alias("delta_pct_of_base"),
        delta_pct_of_current(base, current).alias("delta_pct_of_current"),
        direction(base, current).alias("direction"),
        presence_status(base, current).alias("status"),
    )


def _counts(env: EnvPair, names: Sequence[str], sides: Sequence[str]) -> DataFrame:
    """``side, name, status, row_count``: all tables counted in one stage, one partial count per task and table."""
    found = {(side, name): env.side(side).resolve(name) for name in names for side in sides}
    spark = env.side(sides[0]).spark
    status = spark.createDataFrame(
        [(*key, resolved.status) for key, resolved in found.items()], "side string, name string, status string"
    )
    tables = [
        resolved.frame.select(F.lit(side).alias("side"), F.lit(name).alias("name"))
        for (side, name), resolved in found.items()
        if resolved.frame is not None
    ]
    if not tables:
        return status.withColumn("row_count", F.lit(None).cast("long"))
    rows = reduce(DataFrame.unionByName, tables)
    counts = rows.groupBy("side", "name").agg(F.count(F.lit(1)).alias("counted"))
    # An empty table has no group: its count is zero, while a table that was not found has none.
    count = F.when(F.col("status") == OK, F.coalesce("counted", F.lit(0)))
    return status.join(counts, ["side", "name"], "left").select("side", "name", "status", count.alias("row_count"))
