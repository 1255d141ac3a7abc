"""Queries over stored sketches. What is exact is compared with plain SQL; what is approximate is checked against the exact value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sidewise.operators import sketched
from sidewise.plans.sketches import DISTINCT_ERROR, RANK_ERROR, merged, number, sketch
from workload.queries import COLUMNS, pair, query

LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_LABELS = ("l_returnflag", "l_linestatus")
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
# Two of the three parts: what was sketched apart is merged, and the third part is left out.
SOME = "l_returnflag in ('R', 'A')"


def _lines(spark, folder):
    """Sketches of the order lines by return flag, the current version, and the lines themselves."""
    lines = pair(spark, folder, "lineitem")[0]
    return sketch(lines, F.col("l_returnflag")), lines


@query(
    " union all ".join(
        f"""select '{c}' as "column", count(*) as "rows", count({c}) as filled, cast(min({c}) as double) as low, cast(max({c}) as double) as high,
        round(cast(sum({c}) as double), 2) as total from lineitem where {SOME}"""
        for c in LINE_NUMBERS
    )
)
def sketch_facts_of_parts(spark, folder):
    sketches, _ = _lines(spark, folder)
    facts = merged(sketches.filter("part in ('R', 'A')")).filter(F.col("column").isin(*LINE_NUMBERS))
    return facts.select("column", "rows", "filled", "low", "high", F.round("total", 2).alias("total"))


@query(
    " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as distinct_count, true as within_error from lineitem where {SOME}"""
        for c in (*LINE_NUMBERS, *LINE_LABELS, "l_shipdate")
    )
)
def sketch_distinct_error(spark, folder):
    sketches, lines = _lines(spark, folder)
    estimated = merged(sketches.filter("part in ('R', 'A')")).select("column", F.col("distinct_count").alias("estimated"))
    exact = [
        lines.filter(SOME).agg(F.count_distinct(c).alias("distinct_count")).select(F.lit(c).alias("column"), "distinct_count")
        for c in lines.columns
    ]
    both = reduce(lambda a, b: a.unionByName(b), exact).join(estimated, "column")
    error = F.abs(F.col("estimated") - F.col("distinct_count"))
    # Four standard errors, and one value for the smallest counts.
    return both.select("column", "distinct_count", (error <= 1 + 4 * DISTINCT_ERROR * F.col("distinct_count")).alias("within_error"))


@query(
    " union all ".join(
        f"""select '{c}' as "column", cast({f} as double) as fraction, count({c}) as filled, true as within_error from lineitem where {SOME}"""
        for c in (*LINE_NUMBERS, "l_shipdate")
        for f in QUANTILES
    )
)
def sketch_quantile_error(spark, folder):
    """The rows below a quantile and those not above it enclose its fraction, up to the documented error."""
    sketches, lines = _lines(spark, folder)
    found = merged(sketches.filter("part in ('R', 'A')"), QUANTILES).filter("quantiles is not null")
    cuts = {row["column"]: row["quantiles"] for row in found.select("column", "quantiles").collect()}
    counts = []
    for name, values in cuts.items():
        value = number(F.col(name), lines.schema[name].dataType)
        ranks = [
            F.struct(F.lit(f).alias("fraction"), F.count_if(value < q).alias("below"), F.count_if(value <= q).alias("upto"))
            for f, q in zip(QUANTILES, values)
        ]
        counts.append(F.struct(F.lit(name).alias("column"), F.count(value).alias("filled"), F.array(*ranks).alias("ranks")))
    ranked = lines.filter(SOME).agg(F.array(*counts).alias("counts")).select(F.inline("counts"))
    ranked = ranked.select("column", "filled", F.inline("ranks"))
    low = F.col("below") <= (F.col("fraction") + RANK_ERROR) * F.col("filled")
    high = F.col("upto") >= (F.col("fraction") - RANK_ERROR) * F.col("filled")
    return ranked.select("column", "fraction", "filled", (low & high).alias("within_error"))


def _labels_sql(table: str) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {c} as value, count(*) as n from {table} where {c} is not null group by 2"""
        for c in ("o_orderstatus", "o_orderpriority")
    )


@query(
    f""", b0 as ({_labels_sql('orders')}), c0 as ({_labels_sql('cur_orders')})
    select coalesce(b."column", c."column") as "column", coalesce(b.value, c.value) as value, b.n as base_count, c.n as curr_count,
        (select count(*) from orders) as base_total, (select count(*) from cur_orders) as curr_total
    from b0 b full outer join c0 c on b."column" = c."column" and b.value = c.value""",
    "cur_orders",
)
def sketch_distribution_diff_top_values(spark, folder):
    """With fewer values than a sketch tracks, merged counts are exact."""
    by_month = F.date_format("o_orderdate", "yyyy-MM")
    diff = sketched.distribution_diff(*(sketch(df, by_month) for df in pair(spark, folder, "orders"))).filter("kind = 'topk'")
    zipped = F.arrays_zip("values", "base_counts", "curr_counts")
    return diff.select("column", "base_total", "curr_total", F.explode(zipped).alias("z")).select(
        "column", F.col("z.values").alias("value"), F.col("z.base_counts").alias("base_count"), F.col("z.curr_counts").alias("curr_count"),
        "base_total", "curr_total",
    )


@query(
    " union all ".join(
        f"""select '{c}' as column_name, (select count(*) from orders) as base_rows, (select count(*) from cur_orders) as current_rows,
        (select count({c}) from orders) as base_filled, (select count({c}) from cur_orders) as current_filled, 'modified' as status"""
        for c in COLUMNS["orders"]
    ),
    "cur_orders",
)
def sketch_profile_diff_orders(spark, folder):
    diff = sketched.profile_diff(*(sketch(df, F.col("o_orderpriority")) for df in pair(spark, folder, "orders")))
    filled = lambda side: F.round(F.col(f"{side}__not_null_proportion") * F.col(f"{side}__row_count")).cast("long")
    return diff.select(
        "column_name", F.col("base__row_count").alias("base_rows"), F.col("current__row_count").alias("current_rows"),
        filled("base").alias("base_filled"), filled("current").alias("current_filled"), "status",
    )
