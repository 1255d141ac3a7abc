"""Comparison of two tables by stored digests: ranges that are equal on both sides are neither read nor joined.

The results are those of the plain comparisons. What equal ranges add to them follows from their digests; the others go through
the plain operators. The key must be unique without NULLs on one side, which is looked at when that side is digested; unequal
ranges are checked here, so that a key repeated on the other side is found as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sidewise.functions.columns import common_columns
from sidewise.operators import rowdiff, valuediff
from sidewise.plans.digests import Digested, Ranges, compare_digests
from sidewise.plans.keys import KeyFacts, add_up, key_facts, require_unique

Pair = tuple[Digested, Digested]


def value_diff(base: Digested, current: Digested, columns: Sequence[str] | None = None) -> DataFrame:
    """``valuediff.value_diff`` of two digested tables."""
    counts, values = _cell_counts(base, current, columns, statuses=False)
    return valuediff.match_rates(counts, base.keys, values, common_columns(base.frame, current.frame, base.keys, columns))


def value_diff_status(base: Digested, current: Digested, columns: Sequence[str] | None = None) -> DataFrame:
    """``valuediff.value_diff_status`` of two digested tables."""
    counts, values = _cell_counts(base, current, columns, statuses=True)
    return valuediff.status_rows(counts, base.keys, values)


def impact_value_diff(base: Digested, current: Digested, columns: Sequence[str] | None = None) -> DataFrame:
    """``valuediff.impact_value_diff`` of two digested tables; tables whose keys repeat on both sides are compared whole."""
    values = _values(base, current, columns)
    numeric = valuediff.numeric_columns(base.frame, current.frame, values)
    if not (base.unique or current.unique):
        return valuediff.impact_value_diff(base.frame, current.frame, base.keys, values)
    ranges = compare_digests(base, current, values)
    facts = key_facts(ranges.base, ranges.current, base.keys)
    read = valuediff.change_counts(ranges.base, ranges.current, base.keys, values, numeric, facts)
    # Equal ranges change nothing; their values count in the means of both sides.
    alike = []
    for i, name in enumerate(numeric):
        j = values.index(name)
        for side in ("base", "current"):
            alike.append(F.coalesce(F.col(f"sum_{j}"), F.lit(0.0)).alias(f"{side}_sum_{i}"))
            alike.append((F.col("rows") - F.col(f"nulls_{j}")).alias(f"{side}_count_{i}"))
    counts = add_up([read, ranges.equal.select(*alike)]) if alike else read
    return valuediff.change_rows(counts, values, numeric)


def changed_rows(base: Digested, current: Digested, columns: Sequence[str] | None = None) -> DataFrame:
    """``rowdiff.row_diff`` of two digested tables, reduced to rows that are added, removed or modified.

    All columns of both tables are shown, or ``columns``; those of one side only are not compared, as there.
    """
    ranges = _checked(base, current, _values(base, current, columns))[0]
    return rowdiff.row_diff(ranges.base, ranges.current, base.keys, columns, changed_only=True)


def range_report(base: Digested, current: Digested, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: how many groups, leaves and rows there are, how many are unequal, and the rows that a comparison reads."""
    return compare_digests(base, current, _values(base, current, columns)).report


def _values(base: Digested, current: Digested, columns: Sequence[str] | None) -> list[str]:
    return [c for c in common_columns(base.frame, current.frame, base.keys, columns) if c not in base.keys]


def _checked(base: Digested, current: Digested, values: list[str]) -> tuple[Ranges, KeyFacts]:
    """The ranges to compare, after raising an error where keys repeat."""
    single = len(base.keys) == 1
    if not (base.unique or current.unique):
        # Either raises with the number of repeated keys, or finds that they are unique after all.
        require_unique(base.frame, current.frame, base.keys, ignore_null=single)
    ranges = compare_digests(base, current, values)
    return ranges, require_unique(ranges.base, ranges.current, base.keys, ignore_null=single)


def _cell_counts(base: Digested, current: Digested, columns: Sequence[str] | None, statuses: bool) -> tuple[DataFrame, list[str]]:
    """One row of cell counts: those of the rows read, and of equal ranges those that their digests tell."""
    values = _values(base, current, columns)
    ranges, facts = _checked(base, current, values)
    read = valuediff.cell_counts(ranges.base, ranges.current, base.keys, values, facts, statuses)
    alike = [F.col("rows").alias("common")]
    for i in range(len(values)):
        alike.append(F.col("rows").alias(f"equal_{i}"))
        if statuses:
            alike.append(F.col(f"nulls_{i}").alias(f"both_null_{i}"))
    return add_up([read, ranges.equal.select(*alike)]), values
