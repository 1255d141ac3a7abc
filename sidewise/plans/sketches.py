"""Sketches of tables, stored per part and merged for any set of parts without reading the table again.

One scan describes all columns of all parts. A row of a sketch table is one column of one part: exact counts, bounds and sums,
and three sketches that can be merged. Distinct values: HyperLogLog. Quantiles of numbers and times: KLL. Frequent values of
the rest: frequent items. A new part is described alone and its rows are appended; a comparison reads sketch tables only.

Errors: distinct counts are off by about ``1.04 / sqrt(2 ** HLL_BITS)`` (one standard deviation), the rank of a quantile by ``RANK_ERROR``
of the rows (99 of 100 cases), and counts of frequent values are exact while a column has fewer than three quarters of ``TRACKED``
values in the merged parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import classify_column, col, select_ignoring_case
from sidewise.functions.times import epoch_micros
from sidewise.plans.storage import shared_path

HLL_BITS, KLL_SIZE, TRACKED = 14, 1024, 4096
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (HLL_BITS / 2), 0.005
PART = "part"
_FACTS = ("rows", "filled", "low", "high", "total", "hll", "kll", "top")


def sketch(
    df: DataFrame, part: Column | None = None, columns: Sequence[str] | None = None, path: str | None = None, append: bool = False
) -> DataFrame:
    """Store one row per part and column; returns the stored table.

    ``part`` says which part a row belongs to, as text (NULL is a part of its own); without it the table is one part. Nested and
    binary columns are left out. ``append`` adds parts to a table at ``path``: describe each part once.
    """
    fields = [f for f in (df.schema[name] for name in select_ignoring_case(df, columns)) if classify_column(f.dataType) != "skip"]
    if not fields:
        raise ComparisonError("No column can be described")
    spark = df.sparkSession
    path = path or shared_path(spark, "sketches")
    key = F.lit("") if part is None else part.cast("string")
    facts = [fact.alias(f"{name}_{i}") for i, f in enumerate(fields) for name, fact in zip(_FACTS, _facts(f))]
    parts = df.groupBy(key.alias(PART)).agg(*facts)
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(classify_column(f.dataType)).alias("class"), F.lit(f.dataType.simpleString()).alias("data_type"),
            *[F.col(f"{name}_{i}").alias(name) for name in _FACTS],
        )
        for i, f in enumerate(fields)
    ]
    stored = parts.select(PART, F.inline(F.array(*rows)))
    stored.write.mode("append" if append else "errorifexists").parquet(path)
    return spark.read.parquet(path)


def number(value: Column, dtype: T.DataType) -> Column | None:
    """A column as a number: its value, or epoch seconds for dates and timestamps."""
    kind = classify_column(dtype)
    if kind == "datetime":
        return epoch_micros(value, dtype) / F.lit(1e6)
    return value.cast("double") if kind == "numeric" else None


def _facts(field: T.StructField) -> list[Column]:
    value = col(field.name)
    figure = number(value, field.dataType)
    none = F.max(F.lit(None))
    # Every row needs one to be merged; that of a number tracks a constant and is not looked at.
    label = value.cast("string") if figure is None else F.lit("")
    tracked = F.call_function("approx_top_k_accumulate", label, F.lit(TRACKED))
    # Sketches take no NaN; it is neither a bound nor a quantile.
    plain = None if figure is None else F.when(~F.isnan(figure), figure)
    return [
        F.count(F.lit(1)),
        F.count(value),
        (none if plain is None else F.min(plain)).cast("double"),
        (none if plain is None else F.max(plain)).cast("double"),
        (none if plain is None else F.sum(plain)).cast("double"),
        F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), HLL_BITS),
        (none if plain is None else F.kll_sketch_agg_double(plain, KLL_SIZE)).cast("binary"),
        tracked,
    ]


def merged(sketches: DataFrame, fractions: Sequence[float] = (), k: int = 12) -> DataFrame:
    """One row per column over all given parts; filter the parts beforehand.

    ``column, class, data_type, rows, filled, low, high, total, distinct_count, quantiles, top``: ``quantiles`` at ``fractions`` and ``top``
    the ``k`` most frequent values with their counts, each NULL for columns of the other kind.
    """
    both = sketches.groupBy("column").agg(
        *[F.max(c).alias(c) for c in ("class", "data_type")],
        *[F.sum(c).alias(c) for c in ("rows", "filled")],
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll", KLL_SIZE).alias("kll"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED)).alias("top"),
    )
    points = F.array(*[F.lit(float(f)) for f in fractions]).cast("array<double>")
    is_number = F.col("class") != "categorical"
    quantiles = F.when(is_number & F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("kll", points))
    # One more than k, in case NULL is among the frequent values.
    items = F.call_function("approx_top_k_estimate", F.col("top"), F.lit(k + 1))
    named = F.transform(
        F.slice(F.filter(items, lambda i: i["item"].isNotNull()), 1, k),
        lambda i: F.struct(i["item"].alias("value"), i["count"].alias("count")),
    )
    return both.select(
        "column", "class", "data_type", "rows", "filled", "low", "high", "total",
        F.hll_sketch_estimate("hll").alias("distinct_count"),
        quantiles.alias("quantiles"),
        F.when(~is_number, named).alias("top"),
    )
