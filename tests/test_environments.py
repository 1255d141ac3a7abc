"""SQL over an environment: only its own tables, whatever the session or another thread holds."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from sidewise.errors import ComparisonError
from sidewise.operators import querydiff
from sidewise.sources.environments import EnvPair, Environment, Model


@pytest.fixture()
def sides(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    current = spark.createDataFrame([(1, "a"), (2, "x")], "id int, name string")
    other = spark.createDataFrame([(1,), (9,)], "id int")
    # By finder: nothing is listed in advance.
    found = [{"orders": frame, "order": other} for frame in (base, current)]
    return EnvPair(*[Environment(spark, find=lambda n, f=f: Model(n, lambda: f[n]) if n in f else None) for f in found])


def ids(df):
    return sorted(row[0] for row in df.collect())


def test_finder_reads_its_own_tables(spark, sides):
    spark.createDataFrame([(7, "session")], "id int, name string").createOrReplaceTempView("orders")
    try:
        assert ids(sides.sql("select id from orders", "base")) == [1, 2, 3]
        assert ids(sides.sql("select id from orders", "current")) == [1, 2]
        diff = querydiff.query_diff(sides, "select * from orders", pk="id")
        assert sorted((r["id"], r["name"], r["in_a"]) for r in diff.collect()) == [(2, "b", True), (2, "x", False), (3, "c", True)]
        assert spark.table("orders").count() == 1
    finally:
        spark.catalog.dropTempView("orders")


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select orders.id from orders where orders.name <> 'orders'", [1, 2, 3]),
        ("select o.id from orders o join `order` on o.id = `order`.id", [1]),
        ("with orders as (select id from orders where id > 1), b as (select * from orders) select id from b", [2, 3]),
        ("select id from (select * from orders) x where exists (select 1 from `order` where `order`.id = x.id)", [1]),
        ("select id from orders where id in (select id from `order`) -- order of orders", [1]),
        ("select id from orders union all select id from `order`", [1, 1, 2, 3, 9]),
        ("select max(id) over (partition by name order by id) from orders", [1, 2, 3]),
        ("select (select max(id) from `order`) as m from orders where 'é😀' <> name", [9, 9, 9]),
    ],
)
def test_names_in_a_query(sides, sql, expected):
    assert ids(sides.sql(sql, "base")) == expected


def test_missing_table_is_an_error(spark, sides):
    spark.createDataFrame([(7,)], "id int").createOrReplaceTempView("elsewhere")
    try:
        for sql in ("select * from elsewhere", "select * from orders join elsewhere using (id)", "select * from default.orders"):
            with pytest.raises(ComparisonError):
                sides.sql(sql, "base")
    finally:
        spark.catalog.dropTempView("elsewhere")


def test_threads_do_not_see_each_other(spark, sides):
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(lambda side: ids(sides.sql("select id from orders", side)), ["base", "current"] * 6))
    assert results == [[1, 2, 3], [1, 2]] * 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sidewise_")]
