"""Queries for comparisons that skip equal ranges. Their plain-SQL counterparts are those of the whole comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sidewise.operators import rangediff
from sidewise.plans.digests import Digested, digest
from workload.queries import (
    COLUMNS, ORDER_FLOATS, ORDER_VALUES, _flat, _impact_sql, _row_diff_sql, _rounded, _statuses_sql, _value_diff, _value_diff_sql, pair, query,
)

# Every table with a unique key, and the columns that both of its versions have.
RANGE_TABLES = {
    "region": (["r_regionkey"], "r_regionkey r_name".split()),
    "nation": (["n_nationkey"], "n_nationkey n_name n_regionkey".split()),
    "customer": (["c_custkey"], COLUMNS["customer"]),
    "supplier": (["s_suppkey"], "s_suppkey s_name s_nationkey s_acctbal".split()),
    "part": (["p_partkey"], "p_partkey p_name p_brand p_size p_retailprice".split()),
    "orders": (["o_orderkey"], COLUMNS["orders"]),
    "events": (["event_id"], "event_id ts user_id event_type value props".split()),
    "documents": (["doc_id"], COLUMNS["documents"]),
    "embeddings": (["vec_id"], "vec_id embedding label".split()),
    "pages": (["page_id"], "page_id url html".split()),
    "benchmark": (["item_id"], "item_id text".split()),
    "labels": (["doc_id"], "doc_id quality toxic".split()),
    "conversations": (["conv_id", "turn"], COLUMNS["conversations"]),
}
RANGE_CURRENT = " ".join(f"cur_{name}" for name in RANGE_TABLES)


def digested(spark, folder: str, name: str, keep_rows: bool = False) -> tuple[Digested, Digested]:
    """Both versions of a table with digests; base with a checked key, as a stored version has."""
    keys, columns = RANGE_TABLES[name]
    base, current = pair(spark, folder, name)
    key = keys[0] if len(keys) == 1 else keys
    first = digest(base, key, columns, keep_rows=keep_rows)
    return first, digest(current, key, columns, like=first, check_key=False)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query(
    " union all ".join(
        f"select '{n}' as table_name, * from ({_value_diff_sql(n, f'cur_{n}', keys, columns)}) v"
        for n, (keys, columns) in RANGE_TABLES.items()
    ),
    RANGE_CURRENT,
)
def range_value_diff_all(spark, folder):
    parts = [
        rangediff.value_diff(*digested(spark, folder, n)).select(F.lit(n).alias("table_name"), "*") for n in RANGE_TABLES
    ]
    return _value_diff(_stacked(parts))


@query(_statuses_sql("orders", "cur_orders", ["o_orderkey"], COLUMNS["orders"]), "cur_orders")
def range_value_diff_status_orders(spark, folder):
    return rangediff.value_diff_status(*digested(spark, folder, "orders", keep_rows=True))


@query(_impact_sql("orders", "cur_orders", ["o_orderkey"], ORDER_VALUES), "cur_orders")
def range_impact_value_diff_orders(spark, folder):
    return _rounded(rangediff.impact_value_diff(*digested(spark, folder, "orders")), 4, "base_mean", "current_mean")


@query(
    f"select * from ({_row_diff_sql('orders', 'cur_orders', 'o_orderkey', ORDER_FLOATS)}) d where status is not null",
    "cur_orders",
)
def range_changed_rows_orders(spark, folder):
    return _flat(rangediff.changed_rows(*digested(spark, folder, "orders")))


def _same_rows_sql(name: str, columns: list[str]) -> str:
    listed = ", ".join(columns)
    return f"""not exists ((select {listed} from {name} except all select {listed} from cur_{name})
        union all (select {listed} from cur_{name} except all select {listed} from {name}))"""


# How many rows lie in unequal ranges follows from hashes; what SQL can tell is that no row is missed and none read in vain.
@query(
    " union all ".join(
        f"""select '{n}' as table_name, (select count(*) from {n}) as base_rows, (select count(*) from cur_{n}) as current_rows,
        {_same_rows_sql(n, columns)} as nothing_read"""
        for n, (_, columns) in RANGE_TABLES.items()
    ),
    RANGE_CURRENT,
)
def range_report_all(spark, folder):
    equal = F.col("equal_rows")
    parts = [
        rangediff.range_report(*digested(spark, folder, n)).select(
            F.lit(n).alias("table_name"),
            (equal + F.col("base_rows_read")).alias("base_rows"),
            (equal + F.col("current_rows_read")).alias("current_rows"),
            (F.col("base_rows_read") + F.col("current_rows_read") == 0).alias("nothing_read"),
        )
        for n in RANGE_TABLES
    ]
    return _stacked(parts)
