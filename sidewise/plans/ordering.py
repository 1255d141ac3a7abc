"""Row numbers over a whole table, without pulling the table into one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, resolve_columns
from sidewise.plans.storage import cut

POSITION = "row_number"
# monotonically_increasing_id puts the partition above this bit and the row within the partition below it.
_PARTITION_BIT = 33


def number_rows(df: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """``df`` with a 1-based ``row_number`` in the given order (ascending, NULLs last).

    Rows are sorted by range partitioning and stored once with their place; only the row count per partition is
    collected. Rows equal in ``order_by`` are ordered by their other columns. Copies of one row are interchangeable; they
    are spread over several partitions by their position in the input.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names:
        raise ComparisonError("A row order is needed: the rows of a table have no position of their own")
    names = resolve_columns(names, df.columns)
    rest = [f.name for f in df.schema.fields if f.name not in names and _orderable(f.dataType)]
    order = [col(n).asc_nulls_last() for n in [*names, *rest]]
    place = F.monotonically_increasing_id()
    # The place in the input only spreads copies: a retried task may give it anew without changing any other column.
    spread = df.withColumn("__tie", place).orderBy(*order, F.col("__tie")).drop("__tie")
    placed = cut(spread.withColumn("__place", place), "ordered")
    part = F.shiftright(F.col("__place"), _PARTITION_BIT)
    within = F.col("__place").bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(row["count"] for row in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(row["part"], start) for row, start in zip(counts, starts)], "__part long, __start long"
    )
    # One row per partition of the sorted table, so the broadcast stays small whatever the table holds.
    return (
        placed.join(F.broadcast(offsets), part == F.col("__part"))
        .select((F.col("__start") + within + 1).alias(POSITION), *[col(c) for c in df.columns])
    )


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))
