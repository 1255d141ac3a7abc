"""Histograms of both sides over common bins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError, UnsupportedTypeError
from sidewise.functions.columns import col, common_columns, comparison_class, histogram_supported, resolve_columns, type_family
from sidewise.functions.times import epoch_micros
from sidewise.plans.sides import BASE, IN_BASE, of_side, stack

# Default bin count, spans in days above which bins are years and months, and bins aimed at for years.
NUM_BINS = 50
YEARLY_ABOVE_DAYS = 365 * 4
MONTHLY_ABOVE_DAYS = 60
YEARLY_BINS = 50
NON_FINITE = ("base_non_finite", "curr_non_finite")
_SCHEMA = (
    "bin long, bin_start {edge}, bin_end {edge}, label string, base_count long, curr_count long, "
    "base_total long, curr_total long, base_non_finite long, curr_non_finite long"
)


def column_bounds(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Joint minimum and maximum of a column over both sides and the non-NULL rows of each; one row."""
    value = F.col("value")
    return _values(base, current, column).agg(F.min(value).alias("min"), F.max(value).alias("max"), *_totals())


def histogram_diff(base: DataFrame, current: DataFrame, column: str, num_bins: int = NUM_BINS) -> DataFrame:
    """Rows of both sides per bin, empty bins included.

    ``bin, bin_start, bin_end, label, base_count, curr_count, base_total, curr_total, base_non_finite, curr_non_finite``;
    integers get integer-wide bins, other numbers ``num_bins`` equal ones, dates and timestamps whole years, months or days
    depending on their span. The last bin includes its end. NaN and infinities lie in no bin; the totals hold them and the
    last two columns count them. Without any finite value there are no bins.
    """
    if num_bins < 1:
        raise ComparisonError("num_bins must be positive")
    values = _values(base, current, column)
    dtype = values.schema["value"].dataType
    if not histogram_supported(dtype):
        raise UnsupportedTypeError(f"Column type {dtype.simpleString()} is not supported for histograms")
    facts = values.agg(*[fact.alias(name) for name, fact in _facts(F.col("value"), dtype).items()]).first().asDict()
    layout = _layout(dtype, facts, num_bins)
    if layout is None:
        return _empty(values, _edge_type(dtype))
    return _counted(values, layout, _edge_type(dtype), facts)


def histogram_diff_all(
    base: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, num_bins: int = NUM_BINS
) -> DataFrame:
    """``histogram_diff`` of many columns at once: ``column`` in front, the edges as text.

    By default all numbers and times that both sides have. Whatever their number, both sides are read twice: once for all
    bounds, which come back as one row, and once to count all bins.
    """
    if num_bins < 1:
        raise ComparisonError("num_bins must be positive")
    names = common_columns(base, current, (), columns)
    if columns is None:
        names = [n for n in names if all(histogram_supported(df.schema[n].dataType) for df in (base, current))]
    stacked = stack(base, current, names).toDF(*[f"v{i}" for i in range(len(names))], IN_BASE)
    dtypes = [f.dataType for f in stacked.schema.fields[:-1]]
    for name, dtype in zip(names, dtypes):
        if not histogram_supported(dtype):
            raise UnsupportedTypeError(f"Column {name} of type {dtype.simpleString()} is not supported for histograms")
    schema = "column string, " + _SCHEMA.format(edge="string")
    if not names:
        return base.sparkSession.createDataFrame([], schema)
    wanted = {(i, name): fact for i, dtype in enumerate(dtypes) for name, fact in _facts(F.col(f"v{i}"), dtype).items()}
    row = stacked.agg(*[fact.alias(f"{name}_{i}") for (i, name), fact in wanted.items()]).first()
    facts = [{name: row[f"{name}_{j}"] for j, name in wanted if j == i} for i in range(len(names))]
    layouts = {i: _layout(dtype, own, num_bins) for i, (dtype, own) in enumerate(zip(dtypes, facts))}
    layouts = {i: layout for i, layout in layouts.items() if layout is not None}
    if not layouts:
        return base.sparkSession.createDataFrame([], schema)
    # A row gives one bin number per column; they are counted before anything is shuffled.
    numbers = F.array(*[F.struct(F.lit(i).alias("i"), _bin(layout, F.col(f"v{i}")).alias("bin")) for i, layout in layouts.items()])
    counts = (
        stacked.select(IN_BASE, F.explode(numbers).alias("b"))
        .groupBy("b.i", "b.bin")
        .agg(F.count_if(F.col(IN_BASE)).alias("base_count"), F.count_if(~F.col(IN_BASE)).alias("curr_count"))
        .filter(F.col("bin").isNotNull())
    )
    parts = [
        base.sparkSession.range(layout.bins).select(
            F.lit(i).alias("i"), F.lit(names[i]).alias("column"), F.col("id").alias("bin"),
            *[edge.cast(_edge_type(dtypes[i])).cast("string").alias(f"bin_{n}") for n, edge in zip(("start", "end"), layout.edges(F.col("id")))],
            *_constants(facts[i]),
        )
        for i, layout in layouts.items()
    ]
    every = reduce(DataFrame.unionByName, parts)
    label = F.concat_ws("-", "bin_start", "bin_end").alias("label")
    return every.join(counts, ["i", "bin"], "left").select(
        "column", "bin", "bin_start", "bin_end", label,
        F.coalesce("base_count", F.lit(0)).alias("base_count"), F.coalesce("curr_count", F.lit(0)).alias("curr_count"),
        "base_total", "curr_total", *NON_FINITE,
    )


class _Layout(NamedTuple):
    """How values become bin numbers, how many bins there are, and where a bin starts and ends."""

    index: Callable[[Column], Column]
    bins: int
    edges: Callable[[Column], tuple[Column, Column]]


def _edge_type(dtype: T.DataType) -> str:
    if type_family(dtype) == "datetime":
        return "date"
    return "long" if comparison_class(dtype) == "integer" else "double"


def _facts(value: Column, dtype: T.DataType) -> dict[str, Column]:
    """What has to be known of a column before its bins are laid out, as aggregates."""
    filled = {name: total for name, total in zip(("base_total", "curr_total"), _of_sides(value.isNotNull()))}
    low, high = F.min(value), F.max(value)
    if _edge_type(dtype) == "date":
        return filled | {
            "days": (epoch_micros(high, dtype) - epoch_micros(low, dtype)) / 86_400_000_000,
            "first_year": F.year(low), "first_month": F.month(low), "last_year": F.year(high), "last_month": F.month(high),
            "last_day": F.date_diff(high.cast("date"), low.cast("date")), "first_date": low.cast("date").cast("string"),
        }
    if _edge_type(dtype) == "long":
        return filled | {"low": low, "high": high}
    finite = _finite(value)
    odd = _of_sides(value.isNotNull() & finite.isNull())
    return filled | {"low": F.min(finite), "high": F.max(finite)} | dict(zip(NON_FINITE, odd))


def _finite(value: Column) -> Column:
    number = value.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def _layout(dtype: T.DataType, facts: dict, num_bins: int) -> _Layout | None:
    """The bins of a column; None if it has no finite value."""
    kind = _edge_type(dtype)
    if kind == "date":
        return None if facts["days"] is None else _calendar_layout(facts)
    if facts["low"] is None:
        return None
    return (_integer_layout if kind == "long" else _numeric_layout)(facts["low"], facts["high"], num_bins)


def _integer_layout(low: int, high: int, num_bins: int) -> _Layout:
    bins = min(num_bins, high - low + 1)
    size = max(-(-(high - low) // bins), 1)

    def index(value: Column) -> Column:
        wide = value.cast("decimal(38,0)") if high - low >= 2**63 else value
        return F.call_function("div", wide - F.lit(low), F.lit(size)).cast("long")

    def edges(number: Column) -> tuple[Column, Column]:
        start = F.lit(low) + number * F.lit(size)
        return start, start + F.lit(size)

    return _Layout(index, bins, edges)


def _numeric_layout(low: float, high: float, num_bins: int) -> _Layout:
    size = (high - low) / num_bins
    if size == 0:
        return _Layout(lambda value: F.when(_finite(value).isNotNull(), 0), 1, lambda number: (F.lit(low), F.lit(high)))

    def edges(number: Column) -> tuple[Column, Column]:
        start = F.lit(low) + number * F.lit(size)
        return start, start + F.lit(size)

    return _Layout(lambda value: F.floor((_finite(value) - F.lit(low)) / F.lit(size)), num_bins, edges)


def _calendar_layout(facts: dict) -> _Layout:
    first_year, first_month = facts["first_year"], facts["first_month"]
    end_year = facts["last_year"] + 1
    days = math.floor(facts["days"])
    if days > YEARLY_ABOVE_DAYS:
        years = math.ceil((end_year - first_year) / YEARLY_BINS)
        bins = math.ceil((end_year - first_year) / years)
        index = lambda value: F.floor((F.year(value) - F.lit(first_year)) / F.lit(years))
        origin, months = f"{first_year:04d}-01-01", 12 * years
    elif days > MONTHLY_ABOVE_DAYS:
        bins = (facts["last_year"] - first_year) * 12 + facts["last_month"] + 1 - first_month
        index = lambda value: (F.year(value) - F.lit(first_year)) * 12 + F.month(value) - F.lit(first_month)
        origin, months = f"{first_year:04d}-{first_month:02d}-01", 1
    else:
        bins = facts["last_day"] + 1
        origin, months = facts["first_date"], 0
        index = lambda value: F.date_diff(value.cast("date"), F.lit(origin).cast("date"))

    def edge(number: Column) -> Column:
        start = F.lit(origin).cast("date")
        if not months:
            return F.date_add(start, number.cast("int"))
        return F.add_months(start, (number * months).cast("int"))

    return _Layout(lambda value: index(value).cast("long"), bins, lambda number: (edge(number), edge(number + 1)))


def _bin(layout: _Layout, value: Column) -> Column:
    """The bin of a value; the last bin includes its end."""
    index = layout.index(value)
    return F.when(index.isNotNull(), F.least(index, F.lit(layout.bins - 1))).cast("long")


def _constants(facts: dict) -> list[Column]:
    return [F.lit(facts.get(name, 0)).cast("long").alias(name) for name in ("base_total", "curr_total", *NON_FINITE)]


def _values(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    names = [resolve_columns([column], df.columns)[0] for df in (base, current)]
    return stack(*[df.select(col(n).alias("value")) for df, n in zip((base, current), names)], ["value"])


def _totals() -> list[Column]:
    """Non-NULL rows of either side."""
    return [total.alias(name) for name, total in zip(("base_total", "curr_total"), _of_sides(F.col("value").isNotNull()))]


def _of_sides(condition: Column) -> list[Column]:
    in_base = of_side(BASE)
    return [F.count_if(in_base & condition), F.count_if(~in_base & condition)]


def _counted(values: DataFrame, layout: _Layout, edge_type: str, facts: dict) -> DataFrame:
    """Count both sides per bin in one shuffle of bin numbers, then fill in the bins without rows.

    ``facts`` is the row of bounds, which holds the totals of both sides too.
    """
    in_base = of_side(BASE)
    counts = (
        values.select(_bin(layout, F.col("value")).alias("bin"), IN_BASE, "value")
        .groupBy("bin")
        .agg(
            F.count(F.when(in_base, F.col("value"))).alias("base_count"),
            F.count(F.when(~in_base, F.col("value"))).alias("curr_count"),
        )
    )
    every = values.sparkSession.range(layout.bins).select(F.col("id").alias("bin"))
    filled = every.join(counts.filter(F.col("bin").isNotNull()), "bin", "left")
    start, end = layout.edges(F.col("bin"))
    return filled.select(
        "bin",
        start.cast(edge_type).alias("bin_start"),
        end.cast(edge_type).alias("bin_end"),
        F.concat_ws("-", start.cast(edge_type).cast("string"), end.cast(edge_type).cast("string")).alias("label"),
        F.coalesce("base_count", F.lit(0)).alias("base_count"),
        F.coalesce("curr_count", F.lit(0)).alias("curr_count"),
        *_constants(facts),
    )


def _empty(values: DataFrame, edge_type: str) -> DataFrame:
    return values.sparkSession.createDataFrame([], _SCHEMA.format(edge=edge_type))
