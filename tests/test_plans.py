"""The shape of physical plans: what must stay true for the operators to scale."""

import pytest

from sidewise.operators import distribution, rowcount, rowdiff, topk, valuediff
from sidewise.plans.sides import match
from workload.tables import environments

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    env = environments(spark, FOLDER)
    return env.table("orders", "base"), env.table("orders", "current")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_joins(orders):
    for df in (
        valuediff.value_diff(*orders, "o_orderkey"),
        valuediff.value_diff_status(*orders, "o_orderkey"),
        valuediff.impact_value_diff(*orders, "o_custkey"),
        rowdiff.row_diff(*orders, "o_orderkey"),
        topk.top_k_diff(*orders, "o_custkey"),
        distribution.distribution_diff(*orders),
    ):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_keyed_match_is_one_shuffle_per_side(orders):
    text = plan(match(*orders, ["o_orderkey"], ["o_totalprice"], ["o_totalprice"]))
    assert text.count("SortMergeJoin") == 1 and text.count("Exchange hashpartitioning") == 2


def test_set_comparison_is_one_shuffle_with_partial_counts(orders):
    text = plan(valuediff.value_diff_detail(*orders, "o_orderkey"))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2 and "Join" not in text


def test_only_compared_columns_are_read(orders):
    text = plan(valuediff.value_diff(*orders, "o_orderkey", columns=["o_totalprice"]))
    assert "o_orderpriority" not in text and "o_orderdate" not in text


def test_ranking_is_cut_before_the_shuffle(orders):
    text = plan(distribution.top_values(orders[0], mode="exact"))
    assert "WindowGroupLimit" in text


def test_row_counts_read_no_columns_in_one_shuffle(spark):
    text = plan(rowcount.row_count_diff(environments(spark, FOLDER), ["orders", "customer"]))
    assert "ReadSchema: struct<>" in text
    assert text.count("HashAggregate(keys=[side") == 2


def test_repeated_keys_read_each_side_once(orders):
    from sidewise.plans.keys import pair_counts

    columns = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    text = plan(pair_counts(*orders, ["o_custkey"], columns))
    # Every count reads the stored groups; neither side is scanned again.
    assert "orders.parquet" not in text
    assert text.count("FileScan") == len(columns) + 2


def test_schema_comparison_is_one_shuffle(spark):
    from sidewise.operators import schema

    columns = spark.range(10).selectExpr(
        "if(id % 2 = 0, 'base', 'current') as env", "cast(id % 3 as string) as node_id", "cast(id as string) as column_name", "id as ordinal", "'t' as data_type"
    )
    text = plan(schema.schema_diff(columns))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange RoundRobin") == 1 and "Join" not in text


def test_histograms_of_all_columns_read_each_side_once(orders):
    from sidewise.operators import histogram

    text = plan(histogram.histogram_diff_all(*orders))
    # Base, and the two halves of current; as many for one column as for all.
    assert text.count("FileScan") == plan(histogram.histogram_diff_all(*orders, ["o_custkey"])).count("FileScan") == 3


def _shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_repeated_keys_are_shuffled_once(spark):
    """Rows of keys that are no hot ones meet once; the counts are those of rows that spread over many tasks."""
    from sidewise.plans.keys import key_facts, pair_counts

    base = spark.range(6000).selectExpr("id % 2500 as k", "id % 7 as a", "if(id % 5 = 0, null, id * 0.5) as b", "concat('x', id % 3) as c")
    current = spark.range(5000).selectExpr("id % 2600 as k", "id % 6 as a", "if(id % 4 = 0, null, id * 0.5) as b", "concat('x', id % 3) as c")
    assert key_facts(base, current, ["k"]).together
    before = _shuffled_rows(spark)
    once = pair_counts(base, current, ["k"], ["a", "b", "c"], ["a", "b"], nulls=True, together=True)
    assert _shuffled_rows(spark) - before < 1.5 * 11000
    spread = pair_counts(base, current, ["k"], ["a", "b", "c"], ["a", "b"], nulls=True)
    assert once.select(*spread.columns).first() == spread.first()
    hot = spark.range(100_001).selectExpr("1 as k", "id as a")
    assert not key_facts(hot, hot, ["k"]).together
