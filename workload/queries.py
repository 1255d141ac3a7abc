"""One query per operator, over the given tables, and its plain-SQL counterpart for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.functions.columns import col
from sidewise.functions.compare import any_changed
from sidewise.operators import distribution, histogram, profile, querydiff, rowcount, rowdiff, topk, valuediff
from sidewise.plans.sides import base_of, current_of
from sidewise.plans.storage import shared_path
from sidewise.sources.environments import EnvPair, Environment, Model
from sidewise.sources.export import export_rows
from workload.tables import CURRENT_SQL, NAMES, environments, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    """Register a query under its function name; ``tables`` are the derived tables the oracle text reads."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = with_tables(sql, *tables.split()) if tables else sql
        return fn

    return register


def pair(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    env = environments(spark, folder)
    return env.table(name, "base"), env.table(name, "current")


# The oracle's form of the value comparison: one full outer join per compared column.

COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "documents": "doc_id text lang source n_chars".split(),
    "conversations": "conv_id turn role text".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
}


def _join(base: str, current: str, keys: list[str]) -> str:
    on = " and ".join(f"b.{k} is not distinct from c.{k}" for k in keys)
    return f"(select true as here, * from {base}) b full outer join (select true as here, * from {current}) c on {on}"


def _status_sql(base: str, current: str, keys: list[str], column: str) -> str:
    return f"""select '{column}' as "column",
        case when b.here is null then 'missing from a' when c.here is null then 'missing from b'
             when b.{column} is null and c.{column} is null then 'both are null'
             when b.{column} = c.{column} then 'perfect match'
             when b.{column} is null then 'value is null in a only'
             when c.{column} is null then 'value is null in b only'
             else 'values do not match' end as match_status
        from {_join(base, current, keys)}"""


def _statuses_sql(base: str, current: str, keys: list[str], columns: list[str]) -> str:
    parts = "\nunion all\n".join(_status_sql(base, current, keys, c) for c in columns)
    return f"""select "column", match_status, cast(count(*) as bigint) as count_records,
        cast(round(100.0 * count(*) / sum(count(*)) over (partition by "column"), 2) as double) as percent_of_total
        from ({parts}) s group by 1, 2"""


def _value_diff_sql(base: str, current: str, keys: list[str], columns: list[str]) -> str:
    return f"""select "column", cast(count(*) filter (where match_status in ('perfect match', 'both are null')) as bigint) as matched,
        round(count(*) filter (where match_status in ('perfect match', 'both are null')) /
              nullif(cast(count(*) filter (where match_status not like 'missing%') as double), 0), 9) as matched_p,
        cast(count(*) as bigint) as total,
        cast(count(*) filter (where match_status = 'missing from a') as bigint) as added,
        cast(count(*) filter (where match_status = 'missing from b') as bigint) as removed
        from ({" union all ".join(_status_sql(base, current, keys, c) for c in columns)}) s group by 1"""


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(col(n), digits) for n in names})


def _value_diff(df: DataFrame) -> DataFrame:
    return _rounded(df, 9, "matched_p")


# Scans, sources, sinks


@query(CURRENT_SQL["orders"])
def env_table_current_orders(spark, folder):
    return environments(spark, folder).table("orders", "current")


TOP_PRICES = "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey"


@query(f"select * from ({TOP_PRICES}) limit 2000")
def run_query_orders(spark, folder):
    return querydiff.run_query(environments(spark, folder), TOP_PRICES, 2000, "base").rows


@query(f"""select *, (select count(*) from orders) > 100 as more, (select count(*) from orders) as total
    from ({TOP_PRICES}) limit 100""")
def run_query_more(spark, folder):
    result = querydiff.run_query(environments(spark, folder), TOP_PRICES, 100, "base", count=True)
    return result.rows.withColumns({"more": F.lit(result.more), "total": F.lit(result.total).cast("long")})


@query(
    """select 'base' as side, count(*) as total_row_count, count(*) > 2000 as more from (select distinct o_custkey from orders)
    union all
    select 'current', count(*), count(*) > 2000 from (select distinct o_custkey from cur_orders)""",
    "cur_orders",
)
def query_totals_orders(spark, folder):
    return querydiff.query_totals(environments(spark, folder), "select distinct o_custkey from orders", 2000)


TOTALS = {
    "orders": "select distinct o_custkey from orders",
    "unknown table": "select * from no_such_table",
    "unknown column": "select no_such_column from orders",
    "no query": "selec 1",
}


@query(
    "select 'orders' as query_name, (select count(*) from (select distinct o_custkey from cur_orders) o) as total union all "
    + " union all ".join(f"select '{name}', null" for name in TOTALS if name != "orders"),
    "cur_orders",
)
def query_totals_failing(spark, folder):
    env = environments(spark, folder)
    totals = [(name, querydiff.query_row_count(env, sql)) for name, sql in TOTALS.items()]
    return spark.createDataFrame(totals, "query_name string, total long")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from cur_customer", "cur_customer")
def export_rows_customer(spark, folder):
    df = environments(spark, folder).table("customer", "current")
    path = export_rows(df, shared_path(spark, "export"), "tsv")
    return spark.read.option("sep", "\t").option("header", True).schema(df.schema).csv(path)


@query("select * from cur_lineitem", "cur_lineitem")
def export_rows_lineitem(spark, folder):
    df = environments(spark, folder).table("lineitem", "current")
    path = export_rows(df, shared_path(spark, "export"), "csv")
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query(
    f"""select coalesce(b.n, c.n) as row_number, {", ".join(f"{s}.{c} as {side}__{c}" for s, side in (("b", "base"), ("c", "current"))
        for c in COLUMNS["customer"])}
    from (select *, row_number() over (order by c_custkey) as n from customer) b
    full outer join (select *, row_number() over (order by c_custkey) as n from cur_customer) c on b.n = c.n""",
    "cur_customer",
)
def zip_rows_customer(spark, folder):
    return rowdiff.zip_rows(*pair(spark, folder, "customer"), "c_custkey")


# Value comparison by key


def _value_query(name: str, keys: list[str]) -> None:
    key = keys[0] if len(keys) == 1 else keys
    columns = COLUMNS[name]

    def totals(spark, folder):
        return _value_diff(valuediff.value_diff(*pair(spark, folder, name), key))

    def statuses(spark, folder):
        return valuediff.value_diff_status(*pair(spark, folder, name), key)

    totals.__name__, statuses.__name__ = f"value_diff_{name}", f"value_diff_status_{name}"
    query(_value_diff_sql(name, f"cur_{name}", keys, columns), f"cur_{name}")(totals)
    query(_statuses_sql(name, f"cur_{name}", keys, columns), f"cur_{name}")(statuses)


_value_query("orders", ["o_orderkey"])
_value_query("documents", ["doc_id"])
_value_query("conversations", ["conv_id", "turn"])

# A key that is NULL in a third of the rows: those rows pair up with one another without being joined.
NULL_KEYS = "select case when event_type = 'click' then null else event_id end as id, event_type, user_id from {events}"


@query(
    f", b0 as ({NULL_KEYS.format(events='events')}), c0 as ({NULL_KEYS.format(events='cur_events')})\n"
    + _statuses_sql("b0", "c0", ["id"], ["id", "event_type", "user_id"]),
    "cur_events",
)
def value_diff_status_null_keys(spark, folder):
    env = environments(spark, folder)
    sql = NULL_KEYS.format(events="events")
    return valuediff.value_diff_status(env.sql(sql, "base"), env.sql(sql, "current"), "id")


@query(
    "select coalesce(b.c_custkey, c.c_custkey) as c_custkey, "
    + ", ".join(
        f"""b.{v} as base__{v}, c.{v} as current__{v},
        case when b.here is null then 'missing from a' when c.here is null then 'missing from b'
             when b.{v} is null and c.{v} is null then 'both are null' when b.{v} = c.{v} then 'perfect match'
             when b.{v} is null then 'value is null in a only' when c.{v} is null then 'value is null in b only'
             else 'values do not match' end as status__{v}"""
        for v in COLUMNS["customer"][1:]
    )
    + " from "
    + _join("customer", "cur_customer", ["c_custkey"]),
    "cur_customer",
)
def value_diff_join_customer(spark, folder):
    return valuediff.value_diff_join(*pair(spark, folder, "customer"), "c_custkey")


def _detail_sql(base: str, current: str, kind: str = "") -> str:
    return f"""select *, true as in_a, false as in_b from (select * from {base} except {kind} select * from {current})
    union all
    select *, false, true from (select * from {current} except {kind} select * from {base})"""


@query(_detail_sql("orders", "cur_orders"), "cur_orders")
def value_diff_detail_orders(spark, folder):
    return valuediff.value_diff_detail(*pair(spark, folder, "orders"), "o_orderkey")


@query(
    f""", d as ({_detail_sql('orders', 'cur_orders')}) select *, (select count(*) from d) as total, (select count(*) from d) > 1000 as more
    from d order by o_orderkey, in_a desc, in_b desc limit 1000""",
    "cur_orders",
)
def value_diff_detail_report_orders(spark, folder):
    return valuediff.value_diff_detail_report(*pair(spark, folder, "orders"), "o_orderkey", 1000).flagged()


@query(
    _detail_sql("lineitem", "cur_lineitem", "all"),
    "cur_lineitem",
)
def value_diff_detail_multiset_lineitem(spark, folder):
    base, current = pair(spark, folder, "lineitem")
    return valuediff.value_diff_detail(base, current, "l_partkey", multiset=True, check_key=False)


@query(
    """select side, count(*) filter (where n > 1) as duplicate_keys, count(*) filter (where n > 1) = 0 as is_valid
    from (select 'base' as side, l_orderkey, l_linenumber, count(*) as n from lineitem group by all
          union all select 'current', l_orderkey, l_linenumber, count(*) from cur_lineitem group by all) g group by side""",
    "cur_lineitem",
)
def verify_primary_key_lineitem(spark, folder):
    return valuediff.verify_primary_key(*pair(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys_lineitem(spark, folder):
    return valuediff.duplicate_keys(pair(spark, folder, "lineitem")[0], ["l_orderkey", "l_linenumber"])


def _impact_sql(base: str, current: str, keys: list[str], columns: dict[str, bool]) -> str:
    """``columns`` maps each compared column to whether it is numeric."""
    any_column = " or ".join(f"b.{c} is distinct from c.{c}" for c in columns)
    both = "b.here and c.here"

    def of(column: str, numeric: bool) -> str:
        means = [f"round(avg(cast({s}.{column} as double)), 4)" if numeric else "cast(null as double)" for s in "bc"]
        return f"""select '{column}' as "column", count(case when {both} and b.{column} is distinct from c.{column} then 1 end) as changed,
            {means[0]} as base_mean, {means[1]} as current_mean,
            count(case when b.here is null then 1 end) as rows_added, count(case when c.here is null then 1 end) as rows_removed,
            count(case when {both} and ({any_column}) then 1 end) as rows_changed from {_join(base, current, keys)}"""

    parts = " union all ".join(of(c, n) for c, n in columns.items())
    return f"select *, rows_added + rows_removed + rows_changed as affected_row_count from ({parts}) m"


ORDER_VALUES = {
    "o_custkey": True,
    "o_orderstatus": False,
    "o_totalprice": True,
    "o_orderdate": False,
    "o_orderpriority": False,
}


@query(_impact_sql("orders", "cur_orders", ["o_orderkey"], ORDER_VALUES), "cur_orders")
def impact_value_diff_orders(spark, folder):
    df = valuediff.impact_value_diff(*pair(spark, folder, "orders"), "o_orderkey")
    return _rounded(df, 4, "base_mean", "current_mean")


@query(
    _impact_sql(
        "lineitem",
        "cur_lineitem",
        ["l_orderkey", "l_linenumber"],
        {
            "l_partkey": True,
            "l_suppkey": True,
            "l_quantity": True,
            "l_extendedprice": True,
            "l_discount": True,
            "l_tax": True,
            "l_returnflag": False,
            "l_linestatus": False,
            "l_shipdate": False,
        },
    ),
    "cur_lineitem",
)
def impact_value_diff_repeated_keys(spark, folder):
    df = valuediff.impact_value_diff(*pair(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])
    return _rounded(df, 4, "base_mean", "current_mean")


@query(
    "select count(*) filter (where "
    + " or ".join(f"b.{c} is distinct from c.{c}" for c in COLUMNS["orders"][1:])
    + ") as changed_rows from orders b join cur_orders c on b.o_orderkey = c.o_orderkey",
    "cur_orders",
)
def any_changed_orders(spark, folder):
    base, current = pair(spark, folder, "orders")
    joined = rowdiff.row_diff(base, current, "o_orderkey").filter(
        F.col("status").isNull() | (F.col("status") == "modified")
    )
    pairs = [
        (col(base_of(c)), col(current_of(c)), base.schema[c].dataType, current.schema[c].dataType)
        for c in base.columns
        if c != "o_orderkey"
    ]
    return joined.agg(F.count_if(any_changed(pairs)).alias("changed_rows"))


# Typed row comparison


def _changed_sql(column: str, is_float: bool) -> str:
    exact = f"b.{column} is distinct from c.{column}"
    if not is_float:
        return exact
    return f"""({exact} and not coalesce(abs(b.{column} - c.{column}) <=
        greatest(1e-9 * greatest(abs(b.{column}), abs(c.{column})), 1e-12), false))"""


def _row_diff_sql(base: str, current: str, key: str, columns: dict[str, bool]) -> str:
    """``columns`` maps each compared column to whether it is a float."""
    cells = ", ".join(f"b.{c} as base__{c}, c.{c} as current__{c}" for c in columns)
    changed = " or ".join(_changed_sql(c, f) for c, f in columns.items())
    names = ", ".join(f"case when b.here and c.here and {_changed_sql(c, f)} then '{c}' end" for c, f in columns.items())
    return f"""select coalesce(b.{key}, c.{key}) as {key}, {cells},
        case when b.here is null then 'added' when c.here is null then 'removed' when {changed} then 'modified' end as status,
        concat_ws(',', {names}) as changed_columns from {_join(base, current, [key])}"""


ORDER_FLOATS = {c: c == "o_totalprice" for c in COLUMNS["orders"][1:]}
CUSTOMER_FLOATS = {c: c == "c_acctbal" for c in COLUMNS["customer"][1:]}


def _flat(diff: DataFrame) -> DataFrame:
    return diff.withColumn("changed_columns", F.concat_ws(",", "changed_columns"))


@query(_row_diff_sql("customer", "cur_customer", "c_custkey", CUSTOMER_FLOATS), "cur_customer")
def row_diff_customer(spark, folder):
    return _flat(rowdiff.row_diff(*pair(spark, folder, "customer"), "c_custkey"))


@query(
    f"select * from ({_row_diff_sql('orders', 'cur_orders', 'o_orderkey', ORDER_FLOATS)}) d where status is not null",
    "cur_orders",
)
def row_diff_changed_only_orders(spark, folder):
    return _flat(rowdiff.row_diff(*pair(spark, folder, "orders"), "o_orderkey", changed_only=True))


DECIMALS = (
    "select o_orderkey, cast(o_totalprice as decimal(18,2)) as price from orders",
    "select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as decimal(24,4)) as price from orders",
)


@query(
    f""", b0 as ({DECIMALS[0]}), c0 as ({DECIMALS[1].replace('from orders', 'from cur_orders')})
    select coalesce(b.o_orderkey, c.o_orderkey) as o_orderkey, case when b.here is null then 'added'
        when c.here is null then 'removed' when b.price is distinct from c.price then 'modified' end as status
    from {_join('b0', 'c0', ['o_orderkey'])}""",
    "cur_orders",
)
def row_diff_exact_decimals(spark, folder):
    env = environments(spark, folder)
    base, current = env.sql(DECIMALS[0], "base"), env.sql(DECIMALS[1], "current")
    return rowdiff.row_diff(base, current, "o_orderkey").select("o_orderkey", "status")


@query(
    """select b.vec_id, case when c.vec_id is null then 'removed'
           when c.embedding is null then 'modified' when b.vec_id % 5 = 0 then 'modified' end as status
    from embeddings b left join cur_embeddings c on b.vec_id = c.vec_id""",
    "cur_embeddings",
)
def row_diff_nested_embeddings(spark, folder):
    base, current = pair(spark, folder, "embeddings")
    base = base.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    noise = F.when(F.col("vec_id") % 5 == 0, 1.001).otherwise(1 + 1e-12)
    noisy = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * noise)
    current = current.select("vec_id", noisy.alias("embedding"))
    return rowdiff.row_diff(base, current, "vec_id").select("vec_id", "status")


# A column whose type changes family differs in every row, whatever it holds.
TYPE_CHANGED = "select o_orderkey, cast(o_custkey as varchar(20)) as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from cur_orders"


@query(
    f", c0 as ({TYPE_CHANGED})"
    + _row_diff_sql("orders", "c0", "o_orderkey", ORDER_FLOATS).replace("b.o_custkey is distinct from c.o_custkey", "(b.o_custkey is not null or c.o_custkey is not null)"),
    "cur_orders",
)
def row_diff_type_change(spark, folder):
    base, current = pair(spark, folder, "orders")
    current = current.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return _flat(rowdiff.row_diff(base, current, "o_orderkey"))


@query(
    f""", b0 as (select *, row_number() over (order by c_custkey) as row_number from customer),
    c0 as (select *, row_number() over (order by c_custkey) as row_number from cur_customer)
    {_row_diff_sql('b0', 'c0', 'row_number', {'c_custkey': False} | CUSTOMER_FLOATS)}""",
    "cur_customer",
)
def row_diff_positional_customer(spark, folder):
    return _flat(rowdiff.row_diff_positional(*pair(spark, folder, "customer"), "c_custkey"))


@query(
    """select (select max(n) > 1 from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)) as invalid_key_base,
    (select max(n) > 1 from (select count(*) as n from cur_lineitem group by l_orderkey, l_linenumber)) as invalid_key_current""",
    "cur_lineitem",
)
def duplicate_key_flags_lineitem(spark, folder):
    return rowdiff.duplicate_key_flags(*pair(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


EVENT_CELLS = ("ts", "user_id", "event_type", "value", "props")


@query(
    " union all ".join(
        f"""select coalesce(b.event_id, c.event_id) as event_id, '{c}' as "column", cast(b.{c} as varchar) as base,
        cast(c.{c} as varchar) as current from {_join('events', 'cur_events', ['event_id'])} where b.{c} is distinct from c.{c}"""
        for c in EVENT_CELLS
    ),
    "cur_events",
)
def cell_diff_events(spark, folder):
    return rowdiff.cell_diff(*pair(spark, folder, "events"), "event_id", EVENT_CELLS)


@query(
    f"""select count(*) filter (where status = 'added') as added, count(*) filter (where status = 'removed') as removed,
    count(*) filter (where status = 'modified') as modified
    from ({_row_diff_sql('orders', 'cur_orders', 'o_orderkey', ORDER_FLOATS)}) d""",
    "cur_orders",
)
def row_diff_stats_orders(spark, folder):
    return rowdiff.row_diff_stats(rowdiff.row_diff(*pair(spark, folder, "orders"), "o_orderkey"))


@query(
    " union all ".join(
        f"""select '{c}' as "column", count(*) as modified_rows from customer b join cur_customer c on b.c_custkey = c.c_custkey
        where {_changed_sql(c, f)} having count(*) > 0"""
        for c, f in CUSTOMER_FLOATS.items()
    ),
    "cur_customer",
)
def changed_columns_customer(spark, folder):
    return rowdiff.changed_columns(rowdiff.row_diff(*pair(spark, folder, "customer"), "c_custkey"))


# Row counts


@query(" union all ".join(f"select '{n}' as name, count(*) as row_count, 'ok' as status from cur_{n}" for n in NAMES), " ".join(f"cur_{n}" for n in NAMES))
def row_count_current(spark, folder):
    return rowcount.row_count(environments(spark, folder), NAMES)


COUNTS_SQL = " union all ".join(
    f"select '{n}' as name, (select count(*) from {n}) as base, (select count(*) from cur_{n}) as curr" for n in NAMES
)
ALL_CURRENT = " ".join(f"cur_{n}" for n in NAMES)


@query(
    f"""select *, 'ok' as base_status, 'ok' as curr_status from ({COUNTS_SQL}) c
    union all select 'unknown', null, null, 'not_in_manifest', 'not_in_manifest'""",
    ALL_CURRENT,
)
def row_count_diff_all(spark, folder):
    return rowcount.row_count_diff(environments(spark, folder), [*NAMES, "unknown"])


@query(
    " union all ".join(f"select '{n}' as name, count(*) as row_count, 'ok' as status from cur_{n}" for n in NAMES)
    + """ union all select * from (values ('unknown', null, 'not_in_manifest'), ('exposed', null, 'unsupported_resource_type'),
        ('inlined', null, 'unsupported_materialization'), ('gone', null, 'table_not_found'), ('secret', null, 'permission_denied')) v""",
    ALL_CURRENT,
)
def row_count_statuses(spark, folder):
    """The tables, and names that cannot be counted for every reason there is."""
    env = environments(spark, folder)

    def denied():
        raise AnalysisException("A catalog refuses access", errorClass="INSUFFICIENT_PERMISSIONS", messageParameters={})

    orders = lambda: env.table("orders")
    odd = [
        Model("exposed", orders, resource_type="exposure"), Model("inlined", orders, materialized="ephemeral"),
        Model("gone", lambda: spark.read.parquet(f"{folder}/no_such_table.parquet")), Model("secret", denied),
    ]
    models = env.current.models | {model.name: model for model in odd}
    pair_of = EnvPair(env.base, Environment(spark, models))
    return rowcount.row_count(pair_of, [*NAMES, "unknown", *(model.name for model in odd)])


@query(
    f"""select name, base, curr, curr - base as delta,
        case when base = curr then '0' else concat(case when base < curr then '+' else '-' end,
             case when abs(curr - base) * 100.0 / base >= 0.1 then format('{{:.1f}}', cast(abs(curr - base) as double) / base * 100)
                  else ' <0.1 ' end, '%') end as delta_label,
        round(cast(curr - base as double) / base * 100, 1) + 0 as delta_pct_of_base,  -- + 0: no negative zero
        case when base <> curr then round(cast(curr - base as double) / curr * 100, 2) end as delta_pct_of_current,
        case when curr > base then 'increase' when curr < base then 'decrease' else 'unchanged' end as direction,
        case when base <> curr then 'modified' end as status from ({COUNTS_SQL}) c""",
    ALL_CURRENT,
)
def row_count_labels_all(spark, folder):
    return rowcount.row_count_labels(rowcount.row_count_diff(environments(spark, folder), NAMES))


# Query comparison

BY_PRIORITY = """select o_orderpriority, o_custkey % 10 as bucket, count(*) as n, count(o_orderstatus) as filled
    from orders group by 1, 2"""


@query(
    f", b0 as ({BY_PRIORITY}), c0 as ({BY_PRIORITY.replace('from orders', 'from cur_orders')})\n{_detail_sql('b0', 'c0')}",
    "cur_orders",
)
def query_diff_priority(spark, folder):
    return querydiff.query_diff(environments(spark, folder), BY_PRIORITY, pk=["o_orderpriority", "bucket"])


@query(
    f""", b0 as (select o_orderpriority, count(*) as n from orders group by 1), c0 as (select o_orderpriority, count(*) as n from cur_orders group by 1)
    {_row_diff_sql('b0', 'c0', 'o_orderpriority', {'n': False})}""",
    "cur_orders",
)
def query_diff_side_by_side_priority(spark, folder):
    sql = "select o_orderpriority, count(*) as n from orders group by 1"
    return _flat(querydiff.query_diff_side_by_side(environments(spark, folder), sql, pk="o_orderpriority"))


BY_SEGMENT = "select c_mktsegment, c_nationkey, count(*) as n, sum(c_custkey) as keys from customer group by 1, 2"
_PLACED = "select *, row_number() over (order by c_nationkey nulls last, c_mktsegment nulls last) as row_number from"


@query(
    f""", b0 as ({_PLACED} ({BY_SEGMENT}) s), c0 as ({_PLACED} ({BY_SEGMENT.replace('from customer', 'from cur_customer')}) s)
    {_row_diff_sql('b0', 'c0', 'row_number', dict.fromkeys(('c_mktsegment', 'c_nationkey', 'n', 'keys'), False))}""",
    "cur_customer",
)
def query_diff_side_by_side_positional(spark, folder):
    env = environments(spark, folder)
    return _flat(querydiff.query_diff_side_by_side(env, BY_SEGMENT, order_by=["c_nationkey", "c_mktsegment"]))


PREVIEW = "select c_custkey, c_name, c_nationkey, round(c_acctbal, 0) as c_acctbal, c_mktsegment from customer"


@query(f", p0 as ({PREVIEW.replace('from customer', 'from cur_customer')})\n{_detail_sql('cur_customer', 'p0')}", "cur_customer")
def query_diff_preview_customer(spark, folder):
    env = environments(spark, folder)
    return querydiff.query_diff(env, PREVIEW, pk="c_custkey", current_model="customer")


# Profiles


def _profile_sql(table: str, columns: dict[str, tuple[str, str]]) -> str:
    """``columns`` maps each column to its type name and kind."""

    def of(name: str, dtype: str, kind: str) -> str:
        value = {"array": f"len({name})"}.get(kind, name)
        number = kind in ("number", "array")
        low, high = (f"cast({f}({value}) as double)" if number else "cast(null as double)" for f in ("min", "max"))
        time_low, time_high = (f"{f}({name})" if kind == "time" else "cast(null as timestamp)" for f in ("min", "max"))
        mean = f"round(avg(cast({value} as double)), 4)" if number else "cast(null as double)"
        if kind == "boolean":
            mean = f"round(avg(case when {name} then 1 else 0 end), 4)"
        median = f"round(median(cast({value} as double)), 6)" if number else "cast(null as double)"
        distinct = "cast(null as bigint)" if kind == "array" else f"count(distinct {name})"
        return f"""select '{name}' as column_name, '{dtype}' as data_type, count(*) as row_count,
            round(count({name}) / nullif(cast(count(*) as double), 0), 9) as not_null_proportion,
            round({distinct} / nullif(cast(count(*) as double), 0), 9) as distinct_proportion, {distinct} as distinct_count,
            {distinct} = count(*) as is_unique, {low} as min_number, {high} as max_number,
            {time_low} as min_time, {time_high} as max_time, {mean} as avg, {median} as median from {table}"""

    return " union all ".join(of(n, *t) for n, t in columns.items())


def _profile(df: DataFrame) -> DataFrame:
    """A profile with its text extremes turned back into values, which do not depend on an engine's number format."""
    is_time = F.col("data_type").startswith("timestamp")

    def extreme(name: str) -> dict:
        return {
            f"{name}_number": F.when(~is_time, F.expr(f"try_cast(`{name}` as double)")),
            f"{name}_time": F.when(is_time, F.expr(f"try_cast(`{name}` as timestamp_ntz)")),
        }

    flat = df.withColumns(extreme("min") | extreme("max")).drop("min", "max")
    flat = _rounded(flat, 9, "not_null_proportion", "distinct_proportion")
    return _rounded(_rounded(flat, 4, "avg"), 6, "median")


ORDER_PROFILE = {
    "o_orderkey": ("bigint", "number"),
    "o_custkey": ("bigint", "number"),
    "o_orderstatus": ("string", "text"),
    "o_totalprice": ("double", "number"),
    "o_orderdate": ("timestamp_ntz", "time"),
    "o_orderpriority": ("string", "text"),
}


@query(_profile_sql("cur_orders", ORDER_PROFILE), "cur_orders")
def profile_orders(spark, folder):
    return _profile(profile.profile(pair(spark, folder, "orders")[1]))


@query(
    _profile_sql(
        "cur_lineitem",
        {
            "l_orderkey": ("bigint", "number"),
            "l_partkey": ("bigint", "number"),
            "l_suppkey": ("bigint", "number"),
            "l_linenumber": ("int", "number"),
            "l_quantity": ("double", "number"),
            "l_extendedprice": ("double", "number"),
            "l_discount": ("double", "number"),
            "l_tax": ("double", "number"),
            "l_returnflag": ("string", "text"),
            "l_linestatus": ("string", "text"),
            "l_shipdate": ("timestamp_ntz", "time"),
        },
    ),
    "cur_lineitem",
)
def profile_lineitem(spark, folder):
    return _profile(profile.profile(pair(spark, folder, "lineitem")[1]))


@query(
    _profile_sql("cur_embeddings", {"vec_id": ("bigint", "number"), "embedding": ("array<float>", "array")}),
    "cur_embeddings",
)
def profile_columns_embeddings(spark, folder):
    return _profile(profile.profile(pair(spark, folder, "embeddings")[1], columns=["VEC_ID", "Embedding"]))


@query(
    ", e0 as (select event_id, value > 50 as high from cur_events)\n"
    + _profile_sql("e0", {"event_id": ("bigint", "number"), "high": ("boolean", "boolean")}),
    "cur_events",
)
def profile_boolean_events(spark, folder):
    events = pair(spark, folder, "events")[1]
    return _profile(profile.profile(events.select("event_id", (F.col("value") > 50).alias("high"))))


@query()
def profile_approx_lineitem(spark, folder):
    return profile.profile(pair(spark, folder, "lineitem")[1], distinct="approx", median="approx")


@query(
    " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as distinct_count, true as within_error from cur_orders"
        for c in COLUMNS["orders"]
    ),
    "cur_orders",
)
def profile_approx_error(spark, folder):
    current = pair(spark, folder, "orders")[1]
    exact = profile.profile(current).select("column_name", "distinct_count")
    sketched = profile.profile(current, distinct="approx", median="approx")
    both = exact.join(sketched.select("column_name", F.col("distinct_count").alias("sketched")), "column_name")
    error = F.abs(F.col("sketched") - F.col("distinct_count")) <= 0.15 * F.col("distinct_count")
    return both.select("column_name", "distinct_count", error.alias("within_error"))


PROFILE_FIELDS = (
    "data_type", "row_count", "not_null_proportion", "distinct_proportion", "distinct_count", "is_unique", "min", "max", "avg", "median",
)


def _with_bounds(profiles: str) -> str:
    """A profile with its bounds as text, as the comparison shows them."""
    bounds = ", ".join(
        f"""case when data_type in ('int', 'bigint') then cast(cast({f}_number as bigint) as varchar)
            when {f}_number is not null then cast({f}_number as varchar) else cast({f}_time as varchar) end as "{f}\""""
        for f in ("min", "max")
    )
    return f"select *, {bounds} from ({profiles}) p"


PROFILE_FLOATS = {"not_null_proportion": 9, "distinct_proportion": 9, "avg": 4, "median": 6}


@query(
    f""", b0 as ({_with_bounds(_profile_sql('orders', ORDER_PROFILE))}), c0 as ({_with_bounds(_profile_sql('cur_orders', ORDER_PROFILE))})
    select b.column_name, {", ".join(f'b."{f}" as base__{f}, c."{f}" as current__{f}' for f in PROFILE_FIELDS)},
    case when {" or ".join(_changed_sql(f'"{f}"', f in PROFILE_FLOATS) for f in PROFILE_FIELDS)} then 'modified' end as status
    from b0 b join c0 c on b.column_name = c.column_name""",
    "cur_orders",
)
def profile_diff_orders(spark, folder):
    diff = profile.profile_diff(*pair(spark, folder, "orders"))
    for field, digits in PROFILE_FLOATS.items():
        diff = _rounded(diff, digits, base_of(field), current_of(field))
    return diff.select("column_name", *[f(n) for n in PROFILE_FIELDS for f in (base_of, current_of)], "status")


# Top categories


def _top_sql(base: str, current: str, column: str, k: int) -> str:
    def side(table: str) -> str:
        return f"select cast({column} as varchar) as category, count(*) as c from {table} where {column} is not null group by 1"

    totals = ", ".join(
        f"(select {f} from {t}) as {s}_{n}"
        for s, t in (("base", base), ("curr", current))
        for n, f in (("total", "count(*)"), ("valids", f"count({column})"))
    )
    return f"""select coalesce(c.category, b.category) as category, coalesce(b.c, 0) as base_count, coalesce(c.c, 0) as curr_count,
        {totals} from ({side(current)}) c full outer join ({side(base)}) b on c.category = b.category
        order by curr_count desc, base_count desc, category limit {k}"""


@query(_top_sql("orders", "cur_orders", "o_custkey", 10), "cur_orders")
def top_k_diff_custkey(spark, folder):
    return topk.top_k_diff(*pair(spark, folder, "orders"), "o_custkey")


@query(_top_sql("events", "cur_events", "event_type", 3), "cur_events")
def top_k_diff_event_type(spark, folder):
    return topk.top_k_diff(*pair(spark, folder, "events"), "event_type", k=3)


@query(
    f""", t as ({_top_sql('events', 'cur_events', 'event_type', 2)}),
    r as (select category as label, base_count, curr_count, base_valids, curr_valids from t
          union all select '(others)', max(base_valids) - sum(base_count), max(curr_valids) - sum(curr_count),
                 max(base_valids), max(curr_valids) from t)
    select label, cast(base_count as bigint) as base_count, cast(curr_count as bigint) as curr_count,
        round(base_count / cast(greatest(base_valids, 1) as double), 9) as base_share,
        round(curr_count / cast(greatest(curr_valids, 1) as double), 9) as curr_share
    from r where label <> '(others)' or base_count > 0 or curr_count > 0""",
    "cur_events",
)
def top_k_shares_event_type(spark, folder):
    top = topk.top_k_diff(*pair(spark, folder, "events"), "event_type", k=2)
    return _rounded(topk.top_k_shares(top), 9, "base_share", "curr_share")


@query(
    """select 'base' as side, count(*) as total, count(event_type) as valids from events
    union all select 'current', count(*), count(event_type) from cur_events""",
    "cur_events",
)
def column_totals_event_type(spark, folder):
    return topk.column_totals(*pair(spark, folder, "events"), "event_type")


# Histograms


def _bounds_sql(base: str, current: str, value: str) -> str:
    return f"""select min(v) as lo, max(v) as hi, count(v) filter (where side = 'base') as base_total,
        count(v) filter (where side = 'curr') as curr_total
        from (select 'base' as side, {value} as v from {base} union all select 'curr', {value} from {current}) a"""


def _binned_sql(
    base: str, current: str, value: str, bins: str, index: str, start: str, end: str, labelled: bool = True
) -> str:
    """Histogram text over the one-row table ``m`` of bounds; ``index`` is the bin of ``v``."""

    def counted(table: str) -> str:
        return f"""select least(cast({index} as bigint), {bins} - 1) as bin, count(*) as n
            from (select {value} as v from {table}) x, m where v is not null group by 1"""

    label = f", concat(cast({start} as varchar), '-', cast({end} as varchar)) as label" if labelled else ""
    return f""", m as ({_bounds_sql(base, current, value)}), bb as ({counted(base)}), cc as ({counted(current)}),
    every as (select unnest(generate_series(0, (select cast({bins} as bigint) - 1 from m))) as bin)
    select cast(e.bin as bigint) as bin, {start} as bin_start, {end} as bin_end, coalesce(bb.n, 0) as base_count,
        coalesce(cc.n, 0) as curr_count, m.base_total, m.curr_total{label}
    from every e cross join m left join bb on bb.bin = e.bin left join cc on cc.bin = e.bin"""


INTEGER_BINS = "least(50, hi - lo + 1)"
INTEGER_SIZE = f"greatest(cast(ceil((hi - lo) / cast({INTEGER_BINS} as double)) as bigint), 1)"


def _integer_sql(base: str, current: str, column: str) -> str:
    start = f"cast(lo + e.bin * {INTEGER_SIZE} as bigint)"
    return _binned_sql(
        base, current, column, INTEGER_BINS, f"floor((v - lo) / cast({INTEGER_SIZE} as double))", start, f"{start} + {INTEGER_SIZE}"
    )


def _histogram(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Without the counts of non-finite values, which have an entry of their own; rounded edges have no label."""
    df = df.drop(*histogram.NON_FINITE)
    return df if digits is None else _rounded(df.drop("label"), digits, "bin_start", "bin_end")


@query(
    """select min(v) as min, max(v) as max, count(v) filter (where side = 'base') as base_total,
    count(v) filter (where side = 'curr') as curr_total
    from (select 'base' as side, o_totalprice as v from orders union all select 'curr', o_totalprice from cur_orders) a""",
    "cur_orders",
)
def column_bounds_totalprice(spark, folder):
    return histogram.column_bounds(*pair(spark, folder, "orders"), "o_totalprice")


@query(_integer_sql("part", "cur_part", "p_size"), "cur_part")
def histogram_diff_integer(spark, folder):
    return _histogram(histogram.histogram_diff(*pair(spark, folder, "part"), "p_size"))


@query(_integer_sql("orders", "cur_orders", "o_custkey"), "cur_orders")
def histogram_diff_wide_integer(spark, folder):
    return _histogram(histogram.histogram_diff(*pair(spark, folder, "orders"), "o_custkey"))


@query(
    _binned_sql(
        "orders",
        "cur_orders",
        "o_totalprice",
        "50",
        "floor((v - lo) / ((hi - lo) / 50))",
        "round(lo + e.bin * ((hi - lo) / 50), 6)",
        "round(lo + e.bin * ((hi - lo) / 50) + (hi - lo) / 50, 6)",
        labelled=False,
    ),
    "cur_orders",
)
def histogram_diff_numeric(spark, folder):
    return _histogram(histogram.histogram_diff(*pair(spark, folder, "orders"), "o_totalprice"), 6)


def _calendar_sql(base: str, current: str, value: str, unit: str, bins: str) -> str:
    first = f"cast(date_trunc('{unit}', lo) as date)"
    return _binned_sql(
        base,
        current,
        value,
        bins,
        f"date_diff('{unit}', lo, v)",
        f"cast({first} + to_{unit}s(cast(e.bin as integer)) as date)",
        f"cast({first} + to_{unit}s(cast(e.bin + 1 as integer)) as date)",
    )


@query(_calendar_sql("orders", "cur_orders", "o_orderdate", "year", "(year(hi) - year(lo) + 1)"), "cur_orders")
def histogram_diff_yearly(spark, folder):
    return _histogram(histogram.histogram_diff(*pair(spark, folder, "orders"), "o_orderdate"))


@query(_calendar_sql("events", "cur_events", "ts", "day", "(date_diff('day', lo, hi) + 1)"), "cur_events")
def histogram_diff_daily(spark, folder):
    return _histogram(histogram.histogram_diff(*pair(spark, folder, "events"), "ts"))


def _numeric_sql(base: str, current: str, column: str) -> str:
    size = "((hi - lo) / 50)"
    return _binned_sql(base, current, column, "50", f"floor((v - lo) / {size})", f"lo + e.bin * {size}", f"lo + e.bin * {size} + {size}")


_ALL_HISTOGRAMS = {
    "orders": {
        "o_orderkey": _integer_sql("orders", "cur_orders", "o_orderkey"), "o_custkey": _integer_sql("orders", "cur_orders", "o_custkey"),
        "o_totalprice": _numeric_sql("orders", "cur_orders", "o_totalprice"),
        "o_orderdate": _calendar_sql("orders", "cur_orders", "o_orderdate", "year", "(year(hi) - year(lo) + 1)"),
    },
    "part": {
        "p_partkey": _integer_sql("part", "cur_part", "p_partkey"), "p_size": _integer_sql("part", "cur_part", "p_size"),
        "p_retailprice": _numeric_sql("part", "cur_part", "p_retailprice"),
    },
}


# Labels of double edges are left out: the engines print them differently.
@query(
    " union all ".join(
        f"""select '{t}' as table_name, '{c}' as "column", bin, case when '{c}' not like '%price' then label end as label, base_count, curr_count,
        base_total, curr_total from (with x0 as (select 1) {text}) h"""
        for t, columns in _ALL_HISTOGRAMS.items()
        for c, text in columns.items()
    ),
    "cur_orders cur_part",
)
def histogram_diff_all_columns(spark, folder):
    parts = [
        histogram.histogram_diff_all(*pair(spark, folder, name)).select(F.lit(name).alias("table_name"), "*") for name in _ALL_HISTOGRAMS
    ]
    label = F.when(~F.col("column").like("%price"), F.col("label"))
    return parts[0].unionByName(parts[1]).withColumn("label", label).select(
        "table_name", "column", "bin", "label", "base_count", "curr_count", "base_total", "curr_total"
    )


DUE = "select o_orderkey, cast(date '2020-01-15' + cast(o_custkey % 400 as integer) as date) as due from {orders}"


@query(
    f", b0 as ({DUE.format(orders='orders')}), c0 as ({DUE.format(orders='cur_orders')})"
    + _calendar_sql("b0", "c0", "due", "month", "(date_diff('month', lo, hi) + 1)"),
    "cur_orders",
)
def histogram_diff_monthly(spark, folder):
    env = environments(spark, folder)
    sql = DUE.format(orders="orders")
    return _histogram(histogram.histogram_diff(env.sql(sql, "base"), env.sql(sql, "current"), "due"))


FAR = "select o_orderkey, cast(make_date(cast(1990 + o_custkey % 1200 as integer), 6, 1) as date) as far from {orders}"


@query(
    f", b0 as ({FAR.format(orders='orders')}), c0 as ({FAR.format(orders='cur_orders')})"
    + _binned_sql(
        "b0",
        "c0",
        "far",
        "cast(ceil((year(hi) - year(lo) + 1) / ceil((year(hi) - year(lo) + 1) / 50.0)) as bigint)",
        "floor((year(v) - year(lo)) / ceil((year(hi) - year(lo) + 1) / 50.0))",
        "cast(make_date(cast(year(lo) + e.bin * ceil((year(hi) - year(lo) + 1) / 50.0) as bigint), 1, 1) as date)",
        "cast(make_date(cast(year(lo) + (e.bin + 1) * ceil((year(hi) - year(lo) + 1) / 50.0) as bigint), 1, 1) as date)",
    ),
    "cur_orders",
)
def histogram_diff_far_years(spark, folder):
    env = environments(spark, folder)
    sql = FAR.format(orders="orders")
    return _histogram(histogram.histogram_diff(env.sql(sql, "base"), env.sql(sql, "current"), "far"))


NON_FINITE = """select l_orderkey, case when l_linenumber = 7 then cast('NaN' as double)
    when l_linenumber = 6 then cast('-Infinity' as double) else cast(l_linenumber as double) end as v from {lineitem}"""


@query(
    f""", b0 as ({NON_FINITE.format(lineitem='lineitem')}), c0 as ({NON_FINITE.format(lineitem='cur_lineitem')}),
    bf as (select * from b0 where isfinite(v)), cf as (select * from c0 where isfinite(v)){
        _binned_sql("bf", "cf", "v", "4", "floor((v - lo) / ((hi - lo) / 4))", "lo + e.bin * ((hi - lo) / 4)",
                    "lo + e.bin * ((hi - lo) / 4) + (hi - lo) / 4", labelled=False)
        .replace("m.base_total, m.curr_total", "(select count(v) from b0) as base_total, (select count(v) from c0) as curr_total, "
                 "(select count(v) from b0 where not isfinite(v)) as base_non_finite, (select count(v) from c0 where not isfinite(v)) as curr_non_finite")
    }""",
    "cur_lineitem",
)
def histogram_diff_non_finite(spark, folder):
    env = environments(spark, folder)
    sql = NON_FINITE.format(lineitem="lineitem")
    return histogram.histogram_diff(env.sql(sql, "base"), env.sql(sql, "current"), "v", num_bins=4).drop("label")


# Distributions

NUMBERS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_totalprice": "o_totalprice", "o_orderdate": "epoch(o_orderdate)"}
LABELS = ("o_orderstatus", "o_orderpriority")
FRACTIONS = [round(i / 11, 6) for i in range(1, 11)]


_PROBE_SQL = " union all ".join(
    f"""select '{c}' as "column", '{'datetime' if 'epoch' in v else 'numeric'}' as class, count(*) as total,
    count(distinct {c}) as distinct_count, cast(min({v}) as double) as min, cast(max({v}) as double) as max from cur_orders"""
    for c, v in NUMBERS.items()
) + " union all " + " union all ".join(
    f"""select '{c}', 'categorical', count(*), count(distinct {c}), cast(null as double), cast(null as double) from cur_orders"""
    for c in LABELS
)

# What the sketches promise: distinct counts within three standard errors of five percent.
DISTINCT_ERROR = 0.15


@query(f"select *, true as within_error from ({_PROBE_SQL}) p", "cur_orders")
def distribution_probe_approx(spark, folder):
    current = pair(spark, folder, "orders")[1]
    exact = distribution.distribution_probe(current, mode="exact")
    sketched = distribution.distribution_probe(current).select("column", F.col("distinct_count").alias("sketched"))
    error = F.abs(F.col("sketched") - F.col("distinct_count")) <= DISTINCT_ERROR * F.col("distinct_count")
    return exact.join(sketched, "column").withColumn("within_error", error).drop("sketched")


@query(_PROBE_SQL, "cur_orders")
def distribution_probe_exact(spark, folder):
    return distribution.distribution_probe(pair(spark, folder, "orders")[1], mode="exact")


def _cuts_sql(table: str) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {i} as cut, round(quantile_cont(cast({v} as double), {f}), 4) as value from {table}"""
        for c, v in NUMBERS.items()
        for i, f in enumerate(FRACTIONS)
    )


@query(_cuts_sql("cur_orders"), "cur_orders")
def quantile_edges_exact(spark, folder):
    cuts = distribution.quantile_edges(pair(spark, folder, "orders")[1], mode="exact")
    return cuts.select("column", F.posexplode("cuts").alias("cut", "value")).withColumn("value", F.round("value", 4))


@query(f"select *, true as within_error from ({_cuts_sql('cur_orders')}) c", "cur_orders")
def quantile_edges_approx(spark, folder):
    """The sketch's cuts lie within one percent of the column's range of the exact ones."""
    current = pair(spark, folder, "orders")[1]
    probe = distribution.distribution_probe(current, list(NUMBERS), mode="exact")
    ranges = probe.select("column", (F.col("max") - F.col("min")).alias("width"))
    exact, sketched = (
        distribution.quantile_edges(current, mode=mode).select("column", F.posexplode("cuts").alias("cut", mode))
        for mode in ("exact", "approx")
    )
    error = F.abs(F.col("exact") - F.col("approx")) <= F.col("width") / 100
    return exact.join(sketched, ["column", "cut"]).join(ranges, "column").select(
        "column", "cut", F.round("exact", 4).alias("value"), error.alias("within_error")
    )


def _density_sql(table: str) -> str:
    def of(c: str, v: str) -> str:
        points = " union all ".join(
            [f"select min(cast({v} as double)) as x, cast(0 as double) as f from {table}"]
            + [f"select quantile_cont(cast({v} as double), {f}), {f} from {table}" for f in FRACTIONS]
            + [f"select max(cast({v} as double)), 1 from {table}"]
        )
        return f"""select '{c}' as "column", row_number() over (order by x, f) - 1 as edge, x,
            lead(x) over (order by x, f) - x as width, lead(f) over (order by x, f) - f as rise from ({points}) p"""

    return f"""select "column", cast(edge as bigint) as edge, round(x, 4) as value,
        case when width is null then null when width > 0 and rise > 0 then round(rise / width * 1000, 6) else 0 end as density
        from ({" union all ".join(of(c, v) for c, v in NUMBERS.items())}) d"""


def _edges(df: DataFrame, edges: str, density: str) -> DataFrame:
    value = F.posexplode(edges).alias("edge", "value")
    return df.select("column", density, value).select(
        "column",
        F.col("edge").cast("long").alias("edge"),
        F.round("value", 4).alias("value"),
        F.round(F.get(density, F.col("edge")) * 1000, 6).alias("density"),
    )


@query(_density_sql("cur_orders"), "cur_orders")
def quantile_density_exact(spark, folder):
    current = pair(spark, folder, "orders")[1]
    probe = distribution.distribution_probe(current, list(NUMBERS), mode="exact")
    cuts = distribution.quantile_edges(current, mode="exact")
    return _edges(distribution.quantile_density(probe.join(cuts, "column")), "edges", "density")


@query(
    """select 'l_returnflag' as "column", l_returnflag as value, count(*) as count from cur_lineitem where l_returnflag is not null group by 2
    union all select 'l_linestatus', l_linestatus, count(*) from cur_lineitem where l_linestatus is not null group by 2""",
    "cur_lineitem",
)
def approx_top_k_lineitem(spark, folder):
    """With fewer categories than the sketch holds it is exact."""
    top = distribution.top_values(pair(spark, folder, "lineitem")[1])
    return top.select("column", F.explode("top").alias("t")).select("column", "t.value", "t.count")


def _top_values_sql(table: str, columns: tuple[str, ...], k: int) -> str:
    parts = " union all ".join(
        f"""select '{c}' as "column", cast({c} as varchar) as value, count(*) as count from {table} where {c} is not null group by 2"""
        for c in columns
    )
    return f"""select * from (select "column", value, count,
        cast(row_number() over (partition by "column" order by count desc, value) as bigint) as rank from ({parts}) v) r where rank <= {k}"""


PART_LABELS = ("p_name", "p_brand", "p_type")


@query(_top_values_sql("part", PART_LABELS, 12))
def top_values_exact(spark, folder):
    top = distribution.top_values(pair(spark, folder, "part")[0], mode="exact")
    return top.select("column", F.posexplode("top").alias("i", "t")).select(
        "column", "t.value", "t.count", (F.col("i") + 1).cast("long").alias("rank")
    )


@query(
    f"""select 'base' as side, d.*, (select count(*) from orders) as total from ({_density_sql("orders")}) d
    union all select 'curr', d.*, (select count(*) from cur_orders) from ({_density_sql("cur_orders")}) d""",
    "cur_orders",
)
def distribution_diff_histograms(spark, folder):
    diff = distribution.distribution_diff(*pair(spark, folder, "orders"), mode="exact").filter("kind = 'histogram'")
    sides = F.explode(
        F.array(*[
            F.struct(F.lit(s).alias("side"), F.col(f"{s}_bin_edges").alias("edges"), F.col(f"{s}_density").alias("density"), F.col(f"{s}_total").alias("total"))
            for s in ("base", "curr")
        ])
    )
    described = diff.select("column", sides.alias("s")).select("column", "s.*")
    value = F.posexplode("edges").alias("edge", "value")
    return described.select("column", "side", "density", "total", value).select(
        "side",
        "column",
        F.col("edge").cast("long").alias("edge"),
        F.round("value", 4).alias("value"),
        F.round(F.get("density", F.col("edge")) * 1000, 6).alias("density"),
        "total",
    )


COMMON_LABELS = ("p_brand", "p_size_text", "p_key_text")
# Three labels of very different spread, the last one almost unique.
LABELS = """select p_partkey, p_brand, concat('size ', p_size) as p_size_text, concat('group ', p_partkey % 40) as p_key_text from {part}"""


@query(
    f""", bl as ({LABELS.format(part='part')}), cl as ({LABELS.format(part='cur_part')}),
    b0 as ({_top_values_sql('bl', COMMON_LABELS, 12)}), c0 as ({_top_values_sql('cl', COMMON_LABELS, 12)}),
    slots as (select "column", value, min(slot) as slot
        from (select "column", value, 2 * rank as slot from b0 union all select "column", value, 2 * rank + 1 from c0) s group by 1, 2),
    kept as (select "column", value from (select *, row_number() over (partition by "column" order by slot) as n from slots) t where n <= 12)
    select k."column", row_number() over (partition by k."column" order by b.rank nulls last, c.rank) as place, k.value,
        cast(b.rank as int) as base_rank, cast(c.rank as int) as curr_rank, b.count as base_count, c.count as curr_count
    from kept k left join b0 b on b."column" = k."column" and b.value = k.value
    left join c0 c on c."column" = k."column" and c.value = k.value""",
    "cur_part",
)
def distribution_diff_top_values(spark, folder):
    env = environments(spark, folder)
    base, current = (env.sql(LABELS.format(part="part"), side) for side in ("base", "current"))
    diff = distribution.distribution_diff(base, current, list(COMMON_LABELS), mode="exact")
    zipped = F.arrays_zip("values", "base_ranks", "curr_ranks", "base_counts", "curr_counts")
    return diff.select("column", F.posexplode(zipped).alias("i", "z")).select(
        "column",
        (F.col("i") + 1).cast("long").alias("place"),
        F.col("z.values").alias("value"),
        F.col("z.base_ranks").alias("base_rank"),
        F.col("z.curr_ranks").alias("curr_rank"),
        F.col("z.base_counts").alias("base_count"),
        F.col("z.curr_counts").alias("curr_count"),
    )


@query()
def distribution_diff_approx(spark, folder):
    return distribution.distribution_diff(*pair(spark, folder, "lineitem"))
