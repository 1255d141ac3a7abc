"""Running a query on one side, and comparing the results of a query on both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.functions.columns import key_columns, quote
from sidewise.operators.rowdiff import row_diff, row_diff_positional
from sidewise.operators.valuediff import one_sided_rows, report_order
from sidewise.plans.limits import Limited, first
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import cut
from sidewise.sources.environments import EnvPair


@dataclass(frozen=True)
class QueryResult:
    """Rows of a query. ``more`` tells whether it has further ones, ``total`` how many in all if that was asked for."""

    rows: DataFrame
    limit: int | None
    more: bool
    total: int | None = None


def run_query(env: EnvPair, sql: str, limit: int | None, side: str = CURRENT, count: bool = False) -> QueryResult:
    """Run ``sql`` on one side and keep its first ``limit`` rows (all with None).

    One row more is fetched and stored, from which both the rows and ``more`` are taken; only ``count`` runs the query again.
    """
    result = env.sql(sql, side)
    total = query_row_count(env, sql, side) if count else None
    if limit is None:
        return QueryResult(result, None, False, total)
    names = result.columns
    placed = result.limit(limit + 1).toDF(*[f"c{i}" for i in range(len(names))])
    head = cut(placed.withColumn("place", F.monotonically_increasing_id()), "query")
    more = head.count() > limit
    return QueryResult(head.orderBy("place").limit(limit).drop("place").toDF(*names), limit, more, total)


def query_row_count(env: EnvPair, sql: str, side: str = CURRENT) -> int | None:
    """All rows of a query, whatever the display limit; None when it fails or names a table that cannot be opened."""
    try:
        return env.sql(sql, side).count()
    except (ComparisonError, PySparkException):
        return None


def query_pair(
    env: EnvPair, sql: str, base_sql: str | None = None, current_model: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The two results to compare: ``base_sql`` (default: the same query) on base, ``sql`` on current.

    With ``current_model`` both run on the current side, the base one reading that whole model: a preview of replacing
    the model by the query.
    """
    if current_model is not None:
        return env.sql(f"select * from {quote(current_model)}", CURRENT), env.sql(sql, CURRENT)
    return env.sql(base_sql or sql, BASE), env.sql(sql, CURRENT)


def query_diff(
    env: EnvPair,
    sql: str,
    base_sql: str | None = None,
    pk: str | Sequence[str] | None = None,
    current_model: str | None = None,
) -> DataFrame:
    """Distinct rows of either result that the other lacks, flagged ``in_a``/``in_b``, in no order."""
    base, current = query_pair(env, sql, base_sql, current_model)
    if not pk:
        raise ComparisonError("Name the key columns, or use query_diff_side_by_side with a row order")
    key_columns(current, pk)
    if set(base.columns) != set(current.columns):
        raise ComparisonError(f"The results differ in their columns: {base.columns} and {current.columns}")
    return one_sided_rows(base, current, [c for c in base.columns if c in current.columns])


def query_diff_report(
    env: EnvPair,
    sql: str,
    pk: str | Sequence[str],
    limit: int | None,
    base_sql: str | None = None,
    current_model: str | None = None,
) -> Limited:
    """The first ``limit`` differing rows by key, base before current, with their total."""
    rows = query_diff(env, sql, base_sql, pk, current_model)
    return first(rows, report_order(rows, key_columns(rows, pk)), limit)


def query_diff_side_by_side(
    env: EnvPair,
    sql: str,
    base_sql: str | None = None,
    pk: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    changed_only: bool = False,
    current_model: str | None = None,
) -> DataFrame:
    """Both results matched row by row, by key when one is given and by position in ``order_by`` otherwise."""
    base, current = query_pair(env, sql, base_sql, current_model)
    if pk:
        return row_diff(base, current, pk, changed_only=changed_only)
    return row_diff_positional(base, current, order_by or [], changed_only)


def query_totals(env: EnvPair, sql: str, limit: int, base_sql: str | None = None) -> DataFrame:
    """Total rows of both results and whether they exceed ``limit``: ``side, total_row_count, more``."""
    base, current = query_pair(env, sql, base_sql)
    counts = [
        df.agg(F.count(F.lit(1)).alias("total_row_count")).select(
            F.lit(side).alias("side"), "total_row_count", (F.col("total_row_count") > limit).alias("more")
        )
        for side, df in ((BASE, base), (CURRENT, current))
    ]
    return counts[0].unionByName(counts[1])
