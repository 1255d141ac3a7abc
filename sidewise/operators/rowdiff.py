"""Row and cell comparison with typed equality: floats within a tolerance, everything else exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.functions.columns import col, key_columns, resolve_columns
from sidewise.functions.compare import cell_changed
from sidewise.plans.keys import key_facts, require_unique
from sidewise.plans.ordering import POSITION, number_rows
from sidewise.plans.sides import added, base_of, current_of, in_both, match, removed

STATUS, CHANGED_COLUMNS = "status", "changed_columns"


def row_diff(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
    changed_only: bool = False,
) -> DataFrame:
    """Rows of both sides matched by key: key columns, ``base__x``, ``current__x``, ``status``, ``changed_columns``.

    ``status`` is added, removed, modified or NULL. Columns of one side only are shown but not compared.
    """
    keys = key_columns(base, pk)
    require_unique(base, current, keys, ignore_null=False)
    left, right = (_value_columns(df, keys, columns) for df in (base, current))
    return _diff_rows(base, current, keys, left, right, changed_only)


def row_diff_positional(
    base: DataFrame, current: DataFrame, order_by: str | Sequence[str], changed_only: bool = False
) -> DataFrame:
    """Row i of base against row i of current in the given order; the key column is ``row_number``."""
    left, right = number_rows(base, order_by), number_rows(current, order_by)
    return _diff_rows(left, right, [POSITION], base.columns, current.columns, changed_only)


def zip_rows(base: DataFrame, current: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """Both results side by side, row by row; the shorter one is padded with NULLs."""
    left, right = number_rows(base, order_by), number_rows(current, order_by)
    joined = match(left, right, [POSITION], base.columns, current.columns)
    return joined.select(
        POSITION, *[col(base_of(c)) for c in base.columns], *[col(current_of(c)) for c in current.columns]
    )


def duplicate_key_flags(base: DataFrame, current: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """One row telling on which side the key fails to identify single rows; NULL is a key value like any other."""
    facts = key_facts(base, current, key_columns(base, pk))
    return base.sparkSession.createDataFrame(
        [
            (
                facts.base_duplicates + facts.base_null_duplicates > 0,
                facts.current_duplicates + facts.current_null_duplicates > 0,
            )
        ],
        "invalid_key_base boolean, invalid_key_current boolean",
    )


def row_diff_stats(diff: DataFrame) -> DataFrame:
    """Number of added, removed and modified rows of a row diff."""
    return diff.agg(*[F.count_if(F.col(STATUS) == s).alias(s) for s in ("added", "removed", "modified")])


def changed_columns(diff: DataFrame) -> DataFrame:
    """Columns with at least one modified cell, and how many rows each changes."""
    return (
        diff.filter(F.col(STATUS) == "modified")
        .select(F.explode(CHANGED_COLUMNS).alias("column"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("modified_rows"))
    )


def cell_diff(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per differing cell: key columns, ``column``, ``base`` and ``current`` as text.

    Rows found on one side only contribute their non-NULL cells.
    """
    keys = key_columns(base, pk)
    require_unique(base, current, keys, ignore_null=False)
    shared = [c for c in _value_columns(base, keys, columns) if c in current.columns]
    joined = match(base, current, keys, shared, shared)
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            _as_text(col(base_of(name)), base.schema[name].dataType).alias("base"),
            _as_text(col(current_of(name)), current.schema[name].dataType).alias("current"),
            _changed(base, current, name).alias("changed"),
        )
        for name in shared
    ]
    differing = F.filter(F.array(*cells), lambda cell: cell["changed"])
    return joined.select(*[col(k) for k in keys], F.explode(differing).alias("__cell")).select(
        *[col(k) for k in keys], "__cell.column", "__cell.base", "__cell.current"
    )


def _diff_rows(base: DataFrame, current: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str], changed_only: bool) -> DataFrame:
    joined = match(base, current, keys, left, right)
    shared = [c for c in left if c in right]
    names = [F.when(in_both() & _changed(base, current, c), F.lit(c)) for c in shared]
    changed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    status = (
        F.when(added(), "added").when(removed(), "removed").when(F.size(F.col(CHANGED_COLUMNS)) > 0, "modified")
    )
    rows = joined.withColumn(CHANGED_COLUMNS, changed).withColumn(STATUS, status)
    if changed_only:
        rows = rows.filter(F.col(STATUS).isNotNull())
    return rows.select(
        *[col(k) for k in keys],
        *[col(base_of(c)) for c in left],
        *[col(current_of(c)) for c in right],
        STATUS,
        CHANGED_COLUMNS,
    )


def _value_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    chosen = df.columns if not columns else [c for c in resolve_columns(columns, df.columns) if c in df.columns]
    return [c for c in chosen if c not in keys]


def _changed(base: DataFrame, current: DataFrame, name: str) -> Column:
    return cell_changed(
        col(base_of(name)), col(current_of(name)), base.schema[name].dataType, current.schema[name].dataType
    )


def _as_text(value: Column, dtype: T.DataType) -> Column:
    nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    return F.to_json(value) if nested else value.cast("string")
