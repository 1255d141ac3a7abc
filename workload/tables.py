"""The given tables as an environment pair, and the lineage and log tables derived from them.

Base is every table as it is; current is a SQL text over base that both Spark and the oracle run unchanged. All rows of
every table take part: the remainders below only mark which rows were dropped, altered or added between the two sides.
"""

from __future__ import annotations

import re

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.plans.storage import by_rows, cut, partitions_of
from sidewise.sources.environments import EnvPair, Environment, Model

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

CURRENT_SQL = {
    "region": "select * from region",
    "nation": "select n_nationkey, n_name, case when n_nationkey % 11 = 0 then 0 else n_regionkey end as n_regionkey from nation",
    "customer": """
        select c_custkey, c_name, c_nationkey,
               case when c_custkey % 11 = 0 then c_acctbal + 1
                    when c_custkey % 7 = 0 then c_acctbal * (1 + 1e-12) else c_acctbal end as c_acctbal,
               case when c_custkey % 13 = 0 then null else c_mktsegment end as c_mktsegment
        from customer where c_custkey % 97 <> 0
        union all
        select c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 101 = 0""",
    "supplier": """
        select s_suppkey, s_name, s_nationkey, case when s_suppkey % 11 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal
        from supplier where s_suppkey % 97 <> 0""",
    "part": """
        select p_partkey, p_name, case when p_partkey % 13 = 0 then null else p_brand end as p_brand,
               cast(p_size as bigint) as p_size,
               case when p_partkey % 11 = 0 then p_retailprice + 1 else p_retailprice end as p_retailprice,
               'A' as p_grade
        from part where p_partkey % 97 <> 0""",
    "orders": """
        select o_orderkey, o_custkey,
               case when o_orderkey % 13 = 0 then null else o_orderstatus end as o_orderstatus,
               case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
               o_orderdate, o_orderpriority
        from orders where o_orderkey % 97 <> 0
        union all
        select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        from orders where o_orderkey % 101 = 0""",
    "lineitem": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               case when l_orderkey % 11 = 0 then l_quantity + 1 else l_quantity end as l_quantity,
               l_extendedprice, l_discount, l_tax,
               case when l_orderkey % 13 = 0 then null else l_returnflag end as l_returnflag, l_linestatus, l_shipdate
        from lineitem where l_orderkey % 97 <> 0""",
    "events": """
        select event_id, ts, user_id, case when event_id % 13 = 0 then null else event_type end as event_type,
               case when event_id % 11 = 0 then value + 1 else value end as value, props
        from events where event_id % 97 <> 0
        union all
        select event_id + 10000000, ts, user_id, event_type, value, props from events where event_id % 101 = 0""",
    "documents": """
        select doc_id, case when doc_id % 13 = 0 then null else text end as text, lang, source,
               case when doc_id % 11 = 0 then n_chars + 1 else n_chars end as n_chars
        from documents where doc_id % 97 <> 0
        union all
        select doc_id + 10000000, text, lang, source, n_chars from documents where doc_id % 101 = 0""",
    "embeddings": """
        select vec_id, case when vec_id % 11 = 0 then null else embedding end as embedding, label
        from embeddings where vec_id % 97 <> 0""",
    "pages": """
        select page_id, case when page_id % 13 = 0 then null else url end as url,
               case when page_id % 11 = 0 then concat(html, '.') else html end as html
        from pages where page_id % 97 <> 0""",
    "benchmark": "select item_id, case when item_id % 11 = 0 then concat(text, '.') else text end as text from benchmark",
    "labels": """
        select doc_id, case when doc_id % 11 = 0 then 1 - quality else quality end as quality,
               case when doc_id % 13 = 0 then null else toxic end as toxic
        from labels where doc_id % 97 <> 0""",
    "conversations": """
        select conv_id, turn, role, case when conv_id % 13 = 0 then null else text end as text
        from conversations where conv_id % 97 <> 0
        union all
        select conv_id + 10000000, turn, role, text from conversations where conv_id % 101 = 0""",
}


def environments(spark: SparkSession, folder: str) -> EnvPair:
    base = Environment.of_files(spark, folder, NAMES)
    current = {name: Model(name, lambda sql=sql: base.sql(sql)) for name, sql in CURRENT_SQL.items()}
    return EnvPair(base, Environment(spark, current))


def cents(column: str) -> str:
    return f"cast(round({column} * 100) as bigint)"


# Lineage over the rows of the tables. Nodes are regions, nations, customers, suppliers, parts and orders; edges follow
# their foreign keys; the columns of an order are its lines. {side} is the environment, {name} its tables.
_NODES = """
    select '{side}' as env, concat('region.', r_regionkey) as node_id, r_name as name, 'source' as resource_type,
           'raw' as package_name, '{side}' as schema_name, 'table' as materialized, 'geo,raw' as tag_text, md5(r_name) as checksum
    from {region}
    union all
    select '{side}', concat('nation.', n_nationkey), n_name, 'source', 'raw', 'shared', 'table', 'geo',
           md5(concat(n_name, '|', n_regionkey)) from {nation}
    union all
    select '{side}', concat('customer.', c_custkey), c_name, 'model', 'sales', '{side}', 'table',
           case when c_nationkey % 2 = 0 then 'core,even' else 'core' end,
           md5(concat(c_name, '|', """ + cents("c_acctbal") + """)) from {customer}
    union all
    select '{side}', concat('supplier.', s_suppkey), s_name, 'seed', 'supply', '{side}', 'view', 'core',
           md5(concat(s_name, '|', """ + cents("s_acctbal") + """)) from {supplier}
    union all
    select '{side}', concat('part.', p_partkey), p_name, 'seed', 'supply', '{side}', 'ephemeral', 'raw',
           case when p_partkey % 17 = 0 then null else md5(concat(p_name, '|', """ + cents("p_retailprice") + """)) end from {part}
    union all
    select '{side}', concat('order.', o_orderkey), o_orderpriority, 'model', 'sales', '{side}', 'incremental', 'fact',
           md5(concat(coalesce(o_orderstatus, '-'), '|', """ + cents("o_totalprice") + """)) from {orders}"""

_EDGES = """
    select '{side}' as env, concat('region.', n_regionkey) as parent_id, concat('nation.', n_nationkey) as child_id from {nation}
    union all
    select '{side}', concat('nation.', c_nationkey), concat('customer.', c_custkey) from {customer}
    union all
    select '{side}', concat('nation.', s_nationkey), concat('supplier.', s_suppkey) from {supplier}
    union all
    select '{side}', concat('customer.', o_custkey), concat('order.', o_orderkey) from {orders}
    union all
    select distinct '{side}', concat('part.', l_partkey), concat('order.', l_orderkey) from {lineitem}
    union all
    select distinct '{side}', concat('supplier.', l_suppkey), concat('order.', l_orderkey) from {lineitem}"""

_COLUMNS = {
    "base": """
    select 'base' as env, concat('order.', l_orderkey) as node_id, concat('line_', l_linenumber) as column_name,
           cast(row_number() over (partition by l_orderkey order by l_linenumber) as int) as ordinal,
           min(l_returnflag) as data_type
    from lineitem group by l_orderkey, l_linenumber""",
    "current": """
    select 'current' as env, concat('order.', l_orderkey) as node_id, concat('line_', l_linenumber) as column_name,
           cast(row_number() over (partition by l_orderkey
                                   order by case when l_orderkey % 5 = 0 then (l_linenumber * 3) % 7 else l_linenumber end) as int) as ordinal,
           case when l_orderkey % 10 = 0 then 'X' else min(l_returnflag) end as data_type
    from lineitem where l_orderkey % 97 <> 0 and not (l_linenumber = 7 and l_orderkey % 3 = 0)
    group by l_orderkey, l_linenumber""",
}
_ATTRIBUTES = """
    union all
    select '{side}', concat('part.', p_partkey), 'p_retailprice', 1, 'double' from {part}
    union all
    select '{side}', concat('supplier.', s_suppkey), 's_acctbal', 1, 'double' from {supplier}
    union all
    select '{side}', concat('customer.', c_custkey), 'c_acctbal', 1, '{customer_type}' from {customer}
    union all
    select '{side}', concat('customer.', c_custkey), 'c_mktsegment', 2, 'string' from {customer}"""

# Lines come from parts and suppliers; a customer's balance decides over its orders as a whole.
_COL_EDGES = """
    select distinct concat('part.', l_partkey) as parent_node, 'p_retailprice' as parent_column,
           concat('order.', l_orderkey) as child_node, concat('line_', l_linenumber) as child_column from {lineitem}
    union all
    select distinct concat('supplier.', l_suppkey), 's_acctbal', concat('order.', l_orderkey), concat('line_', l_linenumber)
    from {lineitem}
    union all
    select concat('customer.', o_custkey), 'c_acctbal', concat('order.', o_orderkey), cast(null as varchar(40)) from {orders}
    union all
    select concat('customer.', o_custkey), cast(null as varchar(40)), concat('order.', o_orderkey), cast(null as varchar(40)) from {orders}
    union all
    select concat('nation.', c_nationkey), cast(null as varchar(40)), concat('customer.', c_custkey), cast(null as varchar(40)) from {customer}
    union all
    select concat('nation.', s_nationkey), cast(null as varchar(40)), concat('supplier.', s_suppkey), cast(null as varchar(40)) from {supplier}
    union all
    select concat('region.', n_regionkey), cast(null as varchar(40)), concat('nation.', n_nationkey), cast(null as varchar(40)) from {nation}"""

NODE_TESTS_SQL = """
    select env, node_id, column_name, concat('test.', env, '.', column_name) as test_name,
           case when ordinal % 2 = 0 then 'unique' else 'not_null' end as test_type
    from columns_t where node_id like 'order.%'"""

# A change's category, and the changed columns of modified nodes; as an outside classifier would deliver them.
NODE_CHANGES_SQL = """
    select node_id, change_status,
           case when change_status <> 'modified' then null
                when node_id like 'customer.%' then 'breaking'
                when node_id like 'supplier.%' then 'unknown'
                when node_id like 'part.%' then 'partial_breaking'
                when node_id like '%5' then null else 'non_breaking' end as category
    from lineage_diff_t"""
COLUMN_CHANGES_SQL = """
    select distinct c.node_id, c.column_name, case when c.node_id like '%0' then 'unknown' else 'modified' end as change_status
    from columns_t c join node_changes_t n on c.node_id = n.node_id
    where c.env = 'current' and n.change_status = 'modified' and (c.node_id like 'part.%' or c.column_name = 'line_2')"""
LINEAGE_DIFF_SQL = """
    select node_id, case when base_rows = 0 then 'added' when current_rows = 0 then 'removed' else 'modified' end as change_status
    from (select node_id, count(case when env = 'base' then 1 end) as base_rows, count(case when env = 'current' then 1 end) as current_rows,
            max(case when env = 'base' then checksum end) as base_sum, max(case when env = 'current' then checksum end) as current_sum
        from nodes_t group by node_id) s
    where base_rows = 0 or current_rows = 0 or base_sum is null or current_sum is null or base_sum <> current_sum"""

# Runs and checks, one run per event and one check per customer.
RUNS_SQL = """
    select event_id as run_id, concat('check_', user_id) as check_id, event_type as type, ts as run_at,
           case when event_id % 10 = 0 then 'cancelled' else 'finished' end as status,
           case when event_id % 23 = 0 then 'failed' else null end as error,
           regexp_extract(props, '([0-9]+)', 1) as k, value > 30 as changed, value
    from {events}"""
CHECKS_SQL = """
    select concat('check_', c_custkey) as check_id, {name} as name, 'query' as type, {params} as params, 'table' as view_options,
           c_nationkey % 2 = 0 as is_checked, c_custkey % 3 = 0 as is_preset,
           cast({updated} as timestamp) as updated_at, c_name as created_by
    from {customer}"""


def _sides(template: str, spaces: bool = True) -> dict[str, str]:
    base = {n: n for n in NAMES}
    current = {n: f"cur_{n}" for n in NAMES}
    return {"base": template.format(side="base", **base), "current": template.format(side="current", **current)}


def lineage_sql() -> dict[str, str]:
    """Query text of each derived table, over the given tables and ``cur_*``."""
    columns = {
        side: _COLUMNS[side]
        + _ATTRIBUTES.format(
            side=side,
            customer_type="double" if side == "base" else "float",
            **{n: n if side == "base" else f"cur_{n}" for n in NAMES},
        )
        for side in ("base", "current")
    }
    return {
        "nodes_t": " union all ".join(_sides(_NODES).values()),
        "edges_t": " union all ".join(_sides(_EDGES).values()),
        "columns_t": " union all ".join(columns.values()),
        "col_edges_t": _sides(_COL_EDGES)["current"],
        "node_tests_t": NODE_TESTS_SQL,
        "lineage_diff_t": LINEAGE_DIFF_SQL,
        "node_changes_t": NODE_CHANGES_SQL,
        "column_changes_t": COLUMN_CHANGES_SQL,
        "runs_t": RUNS_SQL.format(events="events"),
        "new_runs_t": RUNS_SQL.format(events="cur_events"),
        "checks_t": CHECKS_SQL.format(
            customer="customer", name="c_name", params="c_mktsegment", updated="'2024-01-02 00:00:00'"
        ),
        "new_checks_t": CHECKS_SQL.format(
            customer="cur_customer",
            name="concat(c_name, ' (new)')",
            params="coalesce(c_mktsegment, 'none')",
            updated="case when c_custkey % 4 = 0 then '2024-01-03 00:00:00' when c_custkey % 4 = 1 then '2024-01-02 00:00:00' "
            "else '2024-01-01 00:00:00' end",
        ),
    }


# Lines to a task that makes edges: a line makes four, and small hash tables of their texts are faster than large ones.
LINES_A_TASK = 62_500
# The child of the edges that a table's rows make.
_CHILD = {
    "nation": "concat('nation.', n_nationkey)",
    "customer": "concat('customer.', c_custkey)",
    "supplier": "concat('supplier.', s_suppkey)",
    "orders": "concat('order.', o_orderkey)",
    "lineitem": "concat('order.', l_orderkey)",
}


def _by_child(env: EnvPair) -> dict[str, Model]:
    """The tables that edges are made of, shuffled as narrow rows by the child: the edges of a child, of both sides, are made together."""
    partitions = partitions_of(env.base.table("lineitem"), LINES_A_TASK)
    return {
        prefix + n: Model(prefix + n, lambda side=side, n=n: side.table(n).repartition(partitions, F.expr(_CHILD[n])))
        for prefix, side in (("", env.base), ("cur_", env.current))
        for n in _CHILD
    }


def derived(
    spark: SparkSession, folder: str, *names: str, stored: tuple[str, ...] = (), by_child: bool = False
) -> tuple[DataFrame, ...]:
    """The named derived tables as frames, planned from their query texts; those in ``stored`` are made and stored once.

    With ``by_child``, the edges of a child are together.
    """
    env = environments(spark, folder)
    models = {n: Model(n, lambda n=n: env.base.table(n)) for n in NAMES}
    models |= {f"cur_{n}": Model(f"cur_{n}", lambda n=n: env.current.table(n)) for n in NAMES}
    texts = lineage_sql()

    def frame(name: str) -> DataFrame:
        if name in stored and name in models:
            return models[name].open()
        for other in texts:
            if other != name and other not in models and _mentions(texts[name], other):
                models[other] = Model(other, lambda found=frame(other): found)
        given = models
        if name == "columns_t":
            # Lines are grouped and numbered by order: the orders' lines meet once, in as many partitions as there are lines for.
            given = models | {"lineitem": Model("lineitem", lambda: by_rows(env.base.table("lineitem"), "l_orderkey"))}
        if name in ("edges_t", "col_edges_t") and by_child:
            given = models | _by_child(env)
        made = Environment(spark, given).sql(texts[name])
        if name in stored:
            made = cut(made, name)
            models[name] = Model(name, lambda: made)
        return made

    tags = F.split("tag_text", ",").alias("tags")
    return tuple(
        df.select(*[c for c in df.columns if c != "tag_text"], tags) if name == "nodes_t" else df
        for name, df in ((name, frame(name)) for name in names)
    )


@cache
def with_tables(sql: str, *names: str) -> str:
    """``sql`` after a WITH clause that defines the named derived tables and ``cur_*`` tables for the oracle."""
    texts = {f"cur_{n}": sql for n, sql in CURRENT_SQL.items()} | lineage_sql()
    wanted: dict[str, None] = {}

    def need(name: str) -> None:
        for other in texts:
            if other != name and _mentions(texts[name], other):
                need(other)
        wanted.setdefault(name)

    for name in names:
        need(name)
    # A table that several others read is computed once.
    shared = {name for name in wanted if sum(_mentions(texts[other], name) for other in wanted if other != name) > 1}
    kind = lambda name: "as materialized" if name in shared else "as"
    whole = ",\n".join(f"{n} {kind(n)} ({texts[n]})" for n in wanted) + f"\n{sql}"
    return f"with {'recursive ' if _recurses(whole) else ''}{whole}"


def _recurses(text: str) -> bool:
    """Whether a table of a WITH clause reads itself."""
    for match in re.finditer(r"(\w+)\s*(?:\([\w, ]*\))? as (?:materialized )?\(", text):
        depth, end = 1, match.end()
        while depth and end < len(text):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if re.search(rf"\b{match[1]}\b", text[match.end() : end]):
            return True
    return False


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words
