"""Profiles and distributions from stored sketches: any set of parts of either side, without reading a table again.

The tables of sketches come from ``plans.sketches.sketch``; filter them by ``part`` for a subset. Values are approximate within the
errors given there; counts, bounds, sums and means are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.operators.distribution import CUT_FRACTIONS, TOP_VALUES, assembled, practically_unique
from sidewise.plans.sketches import DISTINCT_ERROR, RANK_ERROR, merged
from sidewise.plans.storage import cut

_PROFILE = ("row_count", "not_null_proportion", "distinct_count", "min", "max", "avg", "median")


def profile(sketches: DataFrame) -> DataFrame:
    """One row per column: ``column_name, data_type, row_count, not_null_proportion, distinct_proportion, distinct_count, is_unique,
    min, max, avg, median``. Bounds are numbers (times as epoch seconds); ``is_unique`` is whether the distinct values may be
    as many as the rows. Mean and median are those of numbers, as in ``profile.profile``.
    """
    both = merged(sketches, [0.5])
    rows, distinct = F.col("rows"), F.least("distinct_count", "filled")
    of_numbers = F.col("class") == "numeric"
    return both.select(
        F.col("column").alias("column_name"),
        "data_type",
        rows.alias("row_count"),
        F.try_divide(F.col("filled").cast("double"), rows.cast("double")).alias("not_null_proportion"),
        F.try_divide(distinct.cast("double"), rows.cast("double")).alias("distinct_proportion"),
        distinct.alias("distinct_count"),
        F.when(rows > 0, distinct >= rows * (1 - 3 * DISTINCT_ERROR)).alias("is_unique"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        F.when(of_numbers, F.try_divide("total", F.col("filled").cast("double"))).alias("avg"),
        F.when(of_numbers, F.get("quantiles", F.lit(0))).alias("median"),
    )


def distribution_diff(base: DataFrame | None, current: DataFrame | None, k: int = TOP_VALUES) -> DataFrame:
    """``distribution.distribution_diff`` of two tables of sketches, of which one may be missing."""
    sides = {side: sketches for side, sketches in (("base", base), ("curr", current)) if sketches is not None}
    if not sides:
        raise ComparisonError("The table exists on neither side")
    found = {side: cut(merged(sketches, CUT_FRACTIONS, k), "merged") for side, sketches in sides.items()}
    # One row per column and side.
    facts = {
        side: rows.select("column", "class", F.col("rows").alias("total"), F.least("distinct_count", "filled").alias("distinct_count")).collect()
        for side, rows in found.items()
    }
    unique = list(practically_unique(facts))
    described = {
        side: rows.select(
            "column", "class", F.col("rows").alias("total"), F.col("low").alias("min"), F.col("high").alias("max"),
            F.col("quantiles").alias("cuts"), F.when(~F.col("column").isin(unique), F.col("top")).alias("top"),
        )
        for side, rows in found.items()
    }
    return assembled(described, k)


def profile_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Both profiles by column, with what differs by more than the sketches' errors: ``column_name``, the fields of either
    side, ``status`` (added, removed, modified or NULL) and ``changed_fields``.

    Counts, proportions of filled cells, bounds and means are exact and differ at once; distinct counts when they are farther apart
    than six standard errors. Medians differ when the other side's rank of the median is off by more than twice the rank error,
    which the quantiles around the middle tell.
    """
    around = [0.5 - 2 * RANK_ERROR, 0.5 + 2 * RANK_ERROR]
    left, right = (
        profile(side).join(merged(side, around).select(F.col("column").alias("column_name"), F.col("quantiles").alias("around")), "column_name")
        for side in (base, current)
    )
    names = [c for c in left.columns if c != "column_name"]
    joined = left.select("column_name", *[F.col(c).alias(f"base__{c}") for c in names]).join(
        right.select("column_name", *[F.col(c).alias(f"current__{c}") for c in names]), "column_name", "full_outer"
    )
    pair = lambda name: (F.col(f"base__{name}"), F.col(f"current__{name}"))

    def differs(name: str):
        b, c = pair(name)
        if name == "distinct_count":
            return F.abs(b - c) > 6 * DISTINCT_ERROR * F.greatest(b, c)
        if name == "median":
            near = [F.get(F.col(f"{side}__around"), F.lit(i)) for side in ("base", "current") for i in (0, 1)]
            outside = ((c < near[0]) | (c > near[1])) & ((b < near[2]) | (b > near[3]))
            return F.coalesce(outside, b.isNull() != c.isNull())
        if name in ("avg", "not_null_proportion"):
            return ~F.coalesce(F.abs(b - c) <= 1e-9 * F.greatest(F.abs(b), F.abs(c)), b.isNull() & c.isNull())
        return ~b.eqNullSafe(c)

    changed = F.array_compact(F.array(*[F.when(differs(name), F.lit(name)) for name in ("data_type", *_PROFILE)]))
    status = (
        F.when(F.col("base__row_count").isNull(), "added")
        .when(F.col("current__row_count").isNull(), "removed")
        .when(F.size("changed_fields") > 0, "modified")
    )
    fields = [f"{side}__{name}" for name in names if name != "around" for side in ("base", "current")]
    return joined.withColumn("changed_fields", changed).withColumn("status", status).select(
        "column_name", *fields, "status", "changed_fields"
    )
