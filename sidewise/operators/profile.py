"""Column profiles of one table, and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, select_ignoring_case, type_family
from sidewise.functions.compare import within_tolerance
from sidewise.plans.codes import countable, encode
from sidewise.plans.quantiles import ACCURACY, Request, exact_quantiles
from sidewise.plans.sides import added, base_of, current_of, match, removed

EXACT, APPROX, CODES = "exact", "approx", "codes"

PROFILE_SCHEMA = (
    "column_name string, data_type string, row_count long, not_null_proportion double, distinct_proportion double, "
    "distinct_count long, is_unique boolean, min string, max string, avg double, median double"
)
# The fields computed in floating point, which compare within the float tolerance.
FLOAT_FIELDS = ("not_null_proportion", "distinct_proportion", "avg", "median")
EXACT_FIELDS = ("data_type", "row_count", "distinct_count", "is_unique", "min", "max")


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: str = EXACT, median: str = EXACT
) -> DataFrame:
    """One row per column: counts, proportions, uniqueness, extremes, mean and median.

    Numbers have all fields, dates and timestamps no mean or median, booleans a mean (share of true), arrays the figures
    of their length; distinct values are not counted for arrays, structs and maps. An empty table has NULL proportions
    and NULL uniqueness.

    ``distinct="exact"`` counts each column in a scan of that column alone, so the rows are never multiplied by the
    number of columns; ``"codes"`` is exact too and counts all columns in two scans, before the frame is returned, over
    stored values and bitmaps (``plans.codes``); ``"approx"`` needs one scan for everything. Exact medians are located
    before the frame is returned.
    """
    for mode, known in ((distinct, (EXACT, APPROX, CODES)), (median, (EXACT, APPROX))):
        if mode not in known:
            raise ComparisonError(f"Mode is one of {known}, not {mode!r}")
    fields = [df.schema[name] for name in select_ignoring_case(df, columns)]
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    medians = _medians(df, fields) if median == EXACT else {}
    coded = _coded_counts(df, fields) if distinct == CODES else {}
    parts = [_column_aggregates(f, distinct, median, coded.get(f.name)) for f in fields]
    if distinct == EXACT:
        rows = [df.agg(*part).select(_profile_row(f, medians).alias("p")) for f, part in zip(fields, parts)]
        return reduce(DataFrame.unionByName, rows).select("p.*")
    merged = [
        c.alias(f"{name}_{i}") for i, part in enumerate(parts) for name, c in zip(_AGGREGATE_NAMES, part)
    ]
    rows = [_profile_row(f, medians, f"_{i}") for i, f in enumerate(fields)]
    return df.agg(*merged).select(F.inline(F.array(*rows)))


def profile_diff(
    base: DataFrame,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    distinct: str = EXACT,
    median: str = EXACT,
) -> DataFrame:
    """Both profiles aligned by column name, with ``status`` (added, removed, modified or NULL) and the changed fields."""
    left, right = (profile(df, columns, distinct, median) for df in (base, current))
    fields = [name for name in left.columns if name != "column_name"]
    joined = match(left, right, ["column_name"], fields, fields)
    changed = F.array_compact(F.array(*[F.when(_field_changed(f), F.lit(f)) for f in fields]))
    status = F.when(added(), "added").when(removed(), "removed").when(F.size("changed_fields") > 0, "modified")
    return (
        joined.withColumn("changed_fields", changed)
        .withColumn("status", status)
        .select(
            "column_name", *[f(name) for name in fields for f in (base_of, current_of)], "status", "changed_fields"
        )
    )


def _field_changed(name: str) -> Column:
    base, current = col(base_of(name)), col(current_of(name))
    return ~(within_tolerance(base, current) if name in FLOAT_FIELDS else base.eqNullSafe(current))


def _measured(field: T.StructField) -> Column | None:
    """What the figures of a column are taken of: its value, an array's length, or nothing."""
    if isinstance(field.dataType, T.ArrayType):
        return F.array_size(col(field.name))
    return col(field.name) if type_family(field.dataType) in ("numeric", "datetime") else None


def _has_mean(field: T.StructField) -> bool:
    return type_family(field.dataType) in ("numeric", "array")


def _medians(df: DataFrame, fields: Sequence[T.StructField]) -> dict[str, float | None]:
    numeric = [f for f in fields if _has_mean(f)]
    found = exact_quantiles([Request(df, _measured(f), [0.5]) for f in numeric])
    return {f.name: values[0] for f, values in zip(numeric, found)}


def _coded_counts(df: DataFrame, fields: Sequence[T.StructField]) -> dict[str, int]:
    names = [f.name for f in fields if countable(f.dataType)]
    return {r["column_name"]: r["distinct_count"] for r in encode(df, columns=names).counts().collect()} if names else {}


_AGGREGATE_NAMES = ("rows", "filled", "distinct", "low", "high", "mean", "middle")


def _column_aggregates(field: T.StructField, distinct: str, median: str, coded: int | None = None) -> list[Column]:
    value, measured = col(field.name), _measured(field)
    none = F.max(F.lit(None))
    if distinct == CODES:
        count = F.lit(coded).cast("long")
    else:
        count = F.count_distinct(value) if distinct == EXACT else F.approx_count_distinct(value)
    mean = F.avg(F.when(value, 1).otherwise(0)) if type_family(field.dataType) == "boolean" else none
    if _has_mean(field):
        mean = F.avg(measured)
    middle = none
    if median == APPROX and _has_mean(field):
        middle = F.percentile_approx(measured, F.lit(0.5), F.lit(ACCURACY))
    found = [
        F.count(F.lit(1)),
        F.count(value),
        count if countable(field.dataType) else none,
        none if measured is None else F.min(measured),
        none if measured is None else F.max(measured),
        mean,
        middle,
    ]
    return [c.alias(name) for c, name in zip(found, _AGGREGATE_NAMES)]


def _profile_row(field: T.StructField, medians: dict[str, float | None], suffix: str = "") -> Column:
    rows, filled, distinct, low, high, mean, middle = (F.col(n + suffix) for n in _AGGREGATE_NAMES)
    if field.name in medians:
        middle = F.lit(medians[field.name])
    share = rows.cast("double")
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("data_type"),
        rows.alias("row_count"),
        F.try_divide(filled.cast("double"), share).alias("not_null_proportion"),
        F.try_divide(distinct.cast("double"), share).alias("distinct_proportion"),
        distinct.cast("long").alias("distinct_count"),
        F.when(rows > 0, distinct == rows).alias("is_unique"),
        low.cast("string").alias("min"),
        high.cast("string").alias("max"),
        mean.cast("double").alias("avg"),
        middle.cast("double").alias("median"),
    )
