"""Distributions of whole tables: equal-area histograms for numbers and times, top categories for the rest.

``mode="approx"`` reads each side twice whatever the number of columns: once for distinct counts and bounds, once for
the sketches. ``mode="exact"`` computes the same payload from exact quantiles and counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import classify_column, col, select_ignoring_case
from sidewise.functions.times import epoch_micros
from sidewise.operators.profile import APPROX, EXACT
from sidewise.plans.quantiles import ACCURACY, Request, exact_quantiles

# Bins of equal area, their inner cuts, categories kept, and the share of distinct values from which a
# column counts as practically unique.
DENSITY_BINS = 11
CUT_FRACTIONS = tuple(round(i / DENSITY_BINS, 6) for i in range(1, DENSITY_BINS))
TOP_VALUES = 12
UNIQUE_SHARE = 0.95

_POINTS = "array<double>"
_TOP = "array<struct<value:string,count:bigint>>"


def distribution_probe(df: DataFrame, columns: Sequence[str] | None = None, mode: str = APPROX) -> DataFrame:
    """One row per describable column: ``column, class, total, distinct_count, min, max``; times as epoch seconds."""
    fields = _described(df, columns)
    distinct = F.approx_count_distinct if mode == APPROX else F.count_distinct

    def aggregates(field: T.StructField) -> list[Column]:
        number = _number(field)
        return [
            F.count(F.lit(1)).alias("total"),
            distinct(col(field.name)).alias("distinct_count"),
            (F.max(F.lit(None)) if number is None else F.min(number)).cast("double").alias("min"),
            (F.max(F.lit(None)) if number is None else F.max(number)).cast("double").alias("max"),
        ]

    names = ("total", "distinct_count", "min", "max")

    def head(field: T.StructField) -> list[Column]:
        return [F.lit(field.name).alias("column"), F.lit(classify_column(field.dataType)).alias("class")]

    if not fields:
        schema = "column string, class string, total long, distinct_count long, min double, max double"
        return df.sparkSession.createDataFrame([], schema)
    if mode == EXACT:
        return reduce(DataFrame.unionByName, [df.agg(*aggregates(f)).select(*head(f), *names) for f in fields])
    merged = [c.alias(f"{n}_{i}") for i, f in enumerate(fields) for n, c in zip(names, aggregates(f))]
    rows = [F.struct(*head(f), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, f in enumerate(fields)]
    return df.agg(*merged).select(F.inline(F.array(*rows)))


def quantile_edges(df: DataFrame, columns: Sequence[str] | None = None, mode: str = APPROX) -> DataFrame:
    """``column, cuts``: the ten inner cuts of each numeric or time column."""
    fields = [f for f in _described(df, columns) if _number(f) is not None]
    if not fields:
        return df.sparkSession.createDataFrame([], f"column string, cuts {_POINTS}")
    if mode == EXACT:
        return _exact_cuts({"": (df, fields)})[""]
    fractions = F.array(*[F.lit(f) for f in CUT_FRACTIONS])
    sketches = [
        F.percentile_approx(_number(f), fractions, F.lit(ACCURACY)).cast(_POINTS).alias(f"cuts_{i}")
        for i, f in enumerate(fields)
    ]
    rows = [F.struct(F.lit(f.name).alias("column"), F.col(f"cuts_{i}").alias("cuts")) for i, f in enumerate(fields)]
    return df.agg(*sketches).select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES, mode: str = APPROX) -> DataFrame:
    """``column, top``: the ``k`` most frequent values of each categorical column with their counts, NULLs left out."""
    fields = [f for f in _described(df, columns) if _number(f) is None]
    if not fields:
        return df.sparkSession.createDataFrame([], f"column string, top {_TOP}")
    if mode == EXACT:
        return _exact_top(df, fields, k)
    # One more than k, in case NULL is among the frequent items.
    sketches = [F.call_function("approx_top_k", col(f.name), F.lit(k + 1)).alias(f"top_{i}") for i, f in enumerate(fields)]
    rows = []
    for i, field in enumerate(fields):
        items = F.filter(F.col(f"top_{i}"), lambda item: item["item"].isNotNull())
        items = F.transform(
            F.slice(items, 1, k),
            lambda item: F.struct(item["item"].cast("string").alias("value"), item["count"].alias("count")),
        )
        rows.append(F.struct(F.lit(field.name).alias("column"), items.cast(_TOP).alias("top")))
    return df.agg(*sketches).select(F.inline(F.array(*rows)))


def _exact_top(df: DataFrame, fields: Sequence[T.StructField], k: int) -> DataFrame:
    counts = [
        df.select(col(f.name).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(f.name).alias("column"), "value", "count")
        for f in fields
    ]
    # The rank filter is applied before the shuffle too, so each task passes on k rows per column.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc()))
    kept = reduce(DataFrame.unionByName, counts).withColumn("rank", rank).filter(F.col("rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    top = F.transform(ranked, lambda item: F.struct(item["value"].alias("value"), item["count"].alias("count")))
    return kept.groupBy("column").agg(top.cast(_TOP).alias("top"))


def density_edges(low: Column, high: Column, cuts: Column) -> tuple[Column, Column]:
    """``(edges, density)`` of one side from its bounds and inner cuts.

    Density is the share of rows between two edges over their distance, 0 where edges coincide; without bounds both
    arrays are empty.
    """

    def point(value: Column, share: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), share.cast("double").alias("share"))

    fractions = F.array(*[F.lit(f) for f in CUT_FRACTIONS])
    inner = F.zip_with(F.coalesce(cuts, F.array().cast(_POINTS)), fractions, point)
    inner = F.filter(inner, lambda p: p["value"].isNotNull())
    points = F.array_sort(F.concat(F.array(point(low, F.lit(0.0))), inner, F.array(point(high, F.lit(1.0)))))
    bounded = low.isNotNull() & high.isNotNull()
    edges = F.transform(points, lambda p: p["value"])
    pairs = F.zip_with(
        F.slice(points, F.lit(1), F.size(points) - 1),
        F.slice(points, F.lit(2), F.size(points) - 1),
        lambda p, q: F.struct((q["value"] - p["value"]).alias("width"), (q["share"] - p["share"]).alias("rise")),
    )
    density = F.transform(
        pairs, lambda p: F.when((p["width"] > 0) & (p["rise"] > 0), p["rise"] / p["width"]).otherwise(F.lit(0.0))
    )
    empty = F.array().cast(_POINTS)
    return F.when(bounded, edges).otherwise(empty), F.when(bounded, density).otherwise(empty)


def quantile_density(df: DataFrame, low: str = "min", high: str = "max", cuts: str = "cuts") -> DataFrame:
    """``df`` with ``edges`` and ``density`` added, from columns holding bounds and inner cuts."""
    edges, density = density_edges(col(low), col(high), col(cuts))
    return df.withColumn("edges", edges).withColumn("density", density)


def fair_union(base: Column, current: Column, k: int = TOP_VALUES) -> Column:
    """At most ``k`` values of two ranked lists: taken in turns, base first, then listed base before current-only."""

    def slots(values: Column, offset: int) -> Column:
        return F.transform(values, lambda v, i: F.struct((i * 2 + offset).alias("slot"), v.alias("value")))

    in_turns = F.array_sort(F.concat(slots(base, 0), slots(current, 1)))
    kept = F.slice(F.array_distinct(F.transform(in_turns, lambda s: s["value"])), 1, k)
    from_base = F.filter(base, lambda v: F.array_contains(kept, v))
    only_current = F.filter(current, lambda v: F.array_contains(kept, v) & ~F.array_contains(base, v))
    return F.concat(from_base, only_current)


def distribution_diff(
    base: DataFrame | None,
    current: DataFrame | None,
    columns: Sequence[str] | None = None,
    mode: str = APPROX,
    k: int = TOP_VALUES,
) -> DataFrame:
    """One row per column: ``kind`` histogram (edges and densities of each side) or topk (values, ranks and counts).

    A categorical column that is practically unique has an empty value list. One side may be missing.
    """
    if base is None and current is None:
        raise ComparisonError("The table exists on neither side")
    if mode not in (EXACT, APPROX):
        raise ComparisonError(f"Mode is {EXACT!r} or {APPROX!r}, not {mode!r}")
    sides = {side: df for side, df in (("base", base), ("curr", current)) if df is not None}
    probes = _probes(sides, columns, mode)
    unique = practically_unique(probes)
    cuts = _cuts(sides, probes, mode)
    return assembled({s: _described_side(df, probes[s], cuts[s], unique, mode, k) for s, df in sides.items()}, k)


def _probes(sides: dict[str, DataFrame], columns: Sequence[str] | None, mode: str) -> dict[str, list]:
    """The probes of all sides, from one job; one row per column and side."""
    parts = [distribution_probe(df, columns, mode).select(F.lit(s).alias("side"), "*") for s, df in sides.items()]
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {side: [row for row in rows if row["side"] == side] for side in sides}


def _cuts(sides: dict[str, DataFrame], probes: dict[str, list], mode: str) -> dict[str, DataFrame]:
    """Inner cuts of the continuous columns of each side; exact ones are searched for on all sides together."""
    continuous = {s: [r["column"] for r in rows if r["class"] != "categorical"] for s, rows in probes.items()}
    if mode == EXACT:
        return _exact_cuts({s: (df, _described(df, continuous[s]) if continuous[s] else []) for s, df in sides.items()})
    schema = f"column string, cuts {_POINTS}"
    return {
        s: quantile_edges(df, continuous[s]) if continuous[s] else df.sparkSession.createDataFrame([], schema)
        for s, df in sides.items()
    }


def _exact_cuts(tables: dict[str, tuple[DataFrame, list[T.StructField]]]) -> dict[str, DataFrame]:
    found = iter(
        exact_quantiles([Request(df, _number(f), CUT_FRACTIONS) for df, fields in tables.values() for f in fields])
    )
    result = {}
    for side, (df, fields) in tables.items():
        rows = [(f.name, next(found)) for f in fields]
        rows = [(name, None if cuts[0] is None else cuts) for name, cuts in rows]
        result[side] = df.sparkSession.createDataFrame(rows, f"column string, cuts {_POINTS}")
    return result


def practically_unique(probes: dict[str, list]) -> set[str]:
    """Categorical columns whose larger distinct count nearly reaches the larger row count. One row per column is read."""
    cardinality: dict[str, int] = {}
    total = max((row["total"] for rows in probes.values() for row in rows), default=0)
    for rows in probes.values():
        for row in rows:
            if row["class"] == "categorical":
                cardinality[row["column"]] = max(cardinality.get(row["column"], 0), row["distinct_count"])
    return {name for name, count in cardinality.items() if total > 0 and count >= UNIQUE_SHARE * total}


def _described_side(df: DataFrame, probe: list, cuts: DataFrame, unique: set[str], mode: str, k: int) -> DataFrame:
    spark = df.sparkSession
    bounds = spark.createDataFrame(
        [(r["column"], r["class"], r["total"], r["min"], r["max"]) for r in probe],
        "column string, class string, total long, min double, max double",
    )
    ranked = [r["column"] for r in probe if r["class"] == "categorical" and r["column"] not in unique]
    top = top_values(df, ranked, k, mode) if ranked else spark.createDataFrame([], f"column string, top {_TOP}")
    return bounds.join(cuts, "column", "left").join(top, "column", "left")


def assembled(described: dict[str, DataFrame], k: int) -> DataFrame:
    """The rows of a distribution diff, from ``column, class, total, min, max, cuts, top`` of each side."""
    stacked = reduce(
        DataFrame.unionByName, [df.select(F.lit(side).alias("side"), "*") for side, df in described.items()]
    )
    fields = ("total", "min", "max", "cuts", "top")
    grouped = stacked.groupBy("column").agg(
        F.max("class").alias("class"),
        *[
            F.max_by(F.struct(f), F.when(F.col("side") == s, 1)).getField(f).alias(f"{s}_{f}")
            for s in ("base", "curr")
            for f in fields
        ],
    )
    payload = {}
    for s in ("base", "curr"):
        payload[f"{s}_edges"], payload[f"{s}_density"] = density_edges(
            F.col(f"{s}_min"), F.col(f"{s}_max"), F.col(f"{s}_cuts")
        )
        top = F.coalesce(F.col(f"{s}_top"), F.array().cast(_TOP))
        payload[f"{s}_values"] = F.transform(top, lambda item: item["value"])
        payload[f"{s}_tally"] = top
    histogram = F.col("class") != "categorical"
    described_rows = grouped.select("*", *[c.alias(n) for n, c in payload.items()]).withColumn(
        "values", fair_union(F.col("base_values"), F.col("curr_values"), k)
    )

    def rank(side: str) -> Column:
        return F.transform("values", lambda v: F.nullif(F.array_position(F.col(f"{side}_values"), v), F.lit(0)).cast("int"))

    def count(side: str) -> Column:
        tally = F.col(f"{side}_tally")
        return F.transform("values", lambda v: F.get(F.filter(tally, lambda item: item["value"] == v), F.lit(0))["count"])

    def only(condition: Column, value: Column, name: str) -> Column:
        return F.when(condition, value).alias(name)

    return described_rows.select(
        "column",
        F.when(histogram, "histogram").otherwise("topk").alias("kind"),
        F.coalesce("base_total", F.lit(0)).alias("base_total"),
        F.coalesce("curr_total", F.lit(0)).alias("curr_total"),
        only(histogram, F.col("base_edges"), "base_bin_edges"),
        only(histogram, F.col("curr_edges"), "curr_bin_edges"),
        only(histogram, F.col("base_density"), "base_density"),
        only(histogram, F.col("curr_density"), "curr_density"),
        only(~histogram, F.col("values"), "values"),
        only(~histogram, rank("base"), "base_ranks"),
        only(~histogram, rank("curr"), "curr_ranks"),
        only(~histogram, count("base"), "base_counts"),
        only(~histogram, count("curr"), "curr_counts"),
        only(~histogram, (F.size("base_values") >= k) | (F.size("curr_values") >= k), "trimmed"),
    )


def _described(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    fields = [df.schema[name] for name in select_ignoring_case(df, columns)]
    return [f for f in fields if classify_column(f.dataType) != "skip"]


def _number(field: T.StructField) -> Column | None:
    """A column as the number its histogram is drawn over: its value, or epoch seconds for dates and timestamps."""
    kind = classify_column(field.dataType)
    if kind == "datetime":
        return epoch_micros(col(field.name), field.dataType) / F.lit(1e6)
    return col(field.name).cast("double") if kind == "numeric" else None
