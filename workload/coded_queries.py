"""Queries over stored value codes, and the most frequent values of all columns at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidewise.operators import profile, topk
from sidewise.plans.codes import encode
from workload.queries import COLUMNS, ORACLE, _profile, _profile_sql, _top_sql, pair, query

LINES = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


def _counts_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, count(*) as row_count, count({c}) as filled, count(distinct {c}) as distinct_count from {table}"
        for c in columns
    )


# Two of the three parts, merged from what was described apart.
@query(_counts_sql("(select * from lineitem where l_returnflag in ('R', 'A')) l", LINES))
def coded_distinct_of_parts_lineitem(spark, folder):
    return encode(pair(spark, folder, "lineitem")[0], F.col("l_returnflag")).counts("part in ('R', 'A')")


@query(_counts_sql("documents", COLUMNS["documents"]))
def coded_distinct_documents(spark, folder):
    return encode(pair(spark, folder, "documents")[0], F.col("source")).counts()


@query(
    " union all ".join(
        f"""select '{c}' as column_name, b.n as base_count, c.n as current_count, b.n + c.n - e.n as both_count, e.n - c.n as base_only,
        e.n - b.n as current_only from (select count(distinct {c}) as n from orders) b, (select count(distinct {c}) as n from cur_orders) c,
        (select count(distinct {c}) as n from (select {c} from orders union all select {c} from cur_orders) u) e"""
        for c in COLUMNS["orders"]
    ),
    "cur_orders",
)
def coded_distinct_overlap_orders(spark, folder):
    """The current side is added to the stored codes of the base side."""
    base, current = pair(spark, folder, "orders")
    return encode(base, F.lit("base")).add(current, F.lit("current")).overlap("part = 'base'", "part = 'current'")


@query(ORACLE["profile_lineitem"])
def profile_codes_lineitem(spark, folder):
    return _profile(profile.profile(pair(spark, folder, "lineitem")[1], distinct=profile.CODES))


@query(
    _profile_sql(
        "cur_documents",
        {"doc_id": ("bigint", "number"), "text": ("string", "text"), "lang": ("string", "text"), "source": ("string", "text"), "n_chars": ("bigint", "number")},
    ),
    "cur_documents",
)
def profile_codes_documents(spark, folder):
    return _profile(profile.profile(pair(spark, folder, "documents")[1], distinct=profile.CODES))


def _tops_sql(base: str, current: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as column_name, t.* from ({_top_sql(base, current, c, 10)}) t" for c in columns)


# Amounts as decimals: the text of a double depends on the engine.
LINE_SQL = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(18,2)) as l_quantity,
    cast(l_extendedprice as decimal(18,2)) as l_extendedprice, cast(l_discount as decimal(18,2)) as l_discount,
    cast(l_tax as decimal(18,2)) as l_tax, l_returnflag, l_linestatus, l_shipdate from {}"""
AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f""", b0 as ({LINE_SQL.format("lineitem")}), c0 as ({LINE_SQL.format("cur_lineitem")}) {_tops_sql("b0", "c0", LINES)}""", "cur_lineitem")
def top_k_diffs_lineitem(spark, folder):
    decimals = {c: F.col(c).cast("decimal(18,2)") for c in AMOUNTS}
    return topk.top_k_diffs(*(df.withColumns(decimals) for df in pair(spark, folder, "lineitem")))


@query(_tops_sql("documents", "cur_documents", COLUMNS["documents"]), "cur_documents")
def top_k_diffs_documents(spark, folder):
    """Whole texts among the columns: no candidates, found by their buckets."""
    return topk.top_k_diffs(*pair(spark, folder, "documents"))
