"""Most frequent categories on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.functions.columns import classify_column, col, common_columns, resolve_columns
from sidewise.functions.labels import OTHERS_LABEL, category_label
from sidewise.plans.heavy import heavy_values
from sidewise.plans.sides import BASE, CURRENT, of_side, stack

# Fixed value: categories shown.
TOP_K = 10


def category_counts(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Rows per category, as text, on both sides; NULLs are left out."""
    return (
        _categories(base, current, column)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count_if(of_side(BASE)).alias("base_count"), F.count_if(of_side(CURRENT)).alias("curr_count"))
    )


def _categories(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    names = [resolve_columns([column], df.columns)[0] for df in (base, current)]
    sides = [df.select(col(name).cast("string").alias("category")) for df, name in zip((base, current), names)]
    return stack(*sides, ["category"])


def column_totals(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """All rows and non-NULL rows of a column, one row per side."""
    parts = []
    for side, df in ((BASE, base), (CURRENT, current)):
        value = col(resolve_columns([column], df.columns)[0])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("total"), F.count(value).alias("valids")).select(
                F.lit(side).alias("side"), "total", "valids"
            )
        )
    return parts[0].unionByName(parts[1])


def top_k_diff(base: DataFrame, current: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` categories most frequent in current, then in base, then by name; NULLs are left out.

    Every row carries the totals: ``base_total, base_valids, curr_total, curr_valids``.
    """
    if k < 1:
        raise ComparisonError("k must be positive")
    # Counted from a scan of the one column, without the shuffle that the categories need.
    totals = _categories(base, current, column).agg(
        F.struct(
            *[
                F.count(F.when(of_side(side), value)).alias(f"{name}_{kind}")
                for side, name in ((BASE, "base"), (CURRENT, "curr"))
                for kind, value in (("total", F.lit(1)), ("valids", F.col("category")))
            ]
        )
    ).scalar()
    return (
        category_counts(base, current, column)
        .orderBy(F.col("curr_count").desc(), F.col("base_count").desc(), F.col("category").asc())
        .limit(k)
        .select("*", totals.alias("t"))
        .select("category", "base_count", "curr_count", "t.*")
    )


def top_k_diffs(base: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_K) -> DataFrame:
    """``top_k_diff`` of many columns (by default all common ones that are not nested) in three scans at most, with ``column_name``.

    Frequent values are found by bounded counters and proven by bucket counts (``plans.heavy``), so that columns with few
    frequent values among many are not shuffled whole.
    """
    if k < 1:
        raise ComparisonError("k must be positive")
    names = common_columns(base, current, columns=columns)
    names = [n for n in names if all(classify_column(df.schema[n].dataType) != "skip" for df in (base, current))]
    if not names:
        raise ComparisonError("No common column has categories")
    texts = [df.select(*[col(n).cast("string").alias(n) for n in names]) for df in (base, current)]
    found = heavy_values(stack(*texts, names), names, of_side(BASE), k)
    return (
        found.values.join(F.broadcast(found.totals), "column")
        .orderBy("column", "place")
        .select(
            F.col("column").alias("column_name"), "category", "base_count", "curr_count",
            "base_total", "base_valids", "curr_total", "curr_valids",
        )
    )


def top_k_shares(top: DataFrame) -> DataFrame:
    """A top-k diff as shares of the non-NULL rows, with one row for all categories not shown, if there are any."""
    shown = top.agg(
        F.sum("base_count").alias("base_shown"),
        F.sum("curr_count").alias("curr_shown"),
        F.max("base_valids").alias("base_valids"),
        F.max("curr_valids").alias("curr_valids"),
    )
    others = shown.select(
        F.lit(OTHERS_LABEL).alias("label"),
        (F.col("base_valids") - F.col("base_shown")).alias("base_count"),
        (F.col("curr_valids") - F.col("curr_shown")).alias("curr_count"),
        "base_valids",
        "curr_valids",
    ).filter((F.col("base_count") > 0) | (F.col("curr_count") > 0))
    rows = top.select(
        category_label(F.col("category")).alias("label"), "base_count", "curr_count", "base_valids", "curr_valids"
    ).unionByName(others)
    return rows.select(
        "label",
        "base_count",
        "curr_count",
        (F.col("base_count") / F.greatest("base_valids", F.lit(1))).alias("base_share"),
        (F.col("curr_count") / F.greatest("curr_valids", F.lit(1))).alias("curr_share"),
    )
