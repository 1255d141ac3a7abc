"""Comparison by digests: the results of the whole comparison, from unequal ranges only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError, DuplicateKeyError
from sidewise.operators import rangediff, rowdiff, valuediff
from sidewise.plans import digests
from sidewise.plans.digests import digest, open_digested
from sidewise.plans.storage import shared_path

SCHEMA = "id long, name string, price double, size int, tags array<string>, attributes map<string,int>, place struct<x:int,y:string>"


def made(n, changed=()):
    """Rows with NULLs and nested values; the ``changed`` ones differ in one column."""
    generator = random.Random(4)
    rows = []
    for i in range(n):
        row = [
            i, generator.choice([None, "a", "b"]), generator.choice([None, 1.5, float("nan"), float(i)]), generator.choice([None, i]),
            generator.choice([None, [], ["a", None], [None, "a"], ["a"]]), generator.choice([None, {}, {"a": 1, "b": None}, {"b": 2}]),
            generator.choice([None, (1, None), (None, "1")]),
        ]
        if i in changed:
            row[1 + i % 6] = [None, "new", -7.25, -7, ["a", "new"], {"new": 1}, (7, "new")][1 + i % 6]
        rows.append(tuple(row))
    return rows


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def check(base, current, pk="id", columns=None):
    first = digest(base, pk, columns)
    pair = first, digest(current, pk, columns, like=first, check_key=False)
    same(rangediff.value_diff_status(*pair, columns), valuediff.value_diff_status(base, current, pk, columns))
    rounded = [F.round(c, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in "column changed base_mean current_mean rows_added rows_removed rows_changed".split()]
    same(rangediff.impact_value_diff(*pair, columns).select(*rounded), valuediff.impact_value_diff(base, current, pk, columns).select(*rounded))
    return pair


@pytest.fixture
def leaves(monkeypatch):
    monkeypatch.setattr(digests, "LEAF_ROWS", 2)
    monkeypatch.setattr(digests, "GROUPS", 16)


def test_equals_the_whole_comparison(spark, leaves):
    base = spark.createDataFrame(made(400), SCHEMA)
    current = spark.createDataFrame([r for r in made(420, {3, 4, 50, 77, 78, 79}) if r[0] != 111], SCHEMA)
    current = current.withColumn("size", F.col("size").cast("bigint"))
    pair = check(base, current)
    same(rangediff.value_diff(*pair), valuediff.value_diff(base, current, "id"))
    same(rangediff.value_diff(*pair, ["name", "price"]), valuediff.value_diff(base, current, "id", ["name", "price"]))
    same(rangediff.changed_rows(*pair), rowdiff.row_diff(base, current, "id", changed_only=True))
    report = rangediff.range_report(*pair).first()
    assert report["equal_rows"] + report["base_rows_read"] == 400
    assert report["equal_rows"] + report["current_rows_read"] == 419
    # 27 rows differ, so at most as many leaves of about two rows each.
    assert 0 < report["unequal_leaves"] <= 27 and report["base_rows_read"] < 150


def test_equal_tables_read_nothing(spark, leaves):
    base = spark.createDataFrame(made(200), SCHEMA)
    pair = check(base, base.repartition(7).withColumn("price", F.col("price")))
    report = rangediff.range_report(*pair).first()
    assert (report["unequal_groups"], report["unequal_leaves"], report["base_rows_read"], report["equal_rows"]) == (0, 0, 0, 200)


def test_nulls_change_places(spark, leaves):
    """Hashes pass over NULLs: values that only move between columns, elements or fields must be told apart."""
    schema = "id long, a string, b string, c array<string>, d struct<x:string,y:string>, e array<array<int>>"
    base = spark.createDataFrame(
        [(1, "v", None, ["v", None], ("v", None), [[1], [2]]), (2, None, "v", [], (None, None), [[]]), (3, None, None, None, None, [])], schema
    )
    current = spark.createDataFrame(
        [(1, None, "v", [None, "v"], (None, "v"), [[1, 2]]), (2, None, "v", None, None, []), (3, None, None, [], (None, None), [[]])], schema
    )
    pair = check(base, current)
    assert rangediff.value_diff(*pair).filter("matched = 3").select("column").collect() == [("id",)]


def test_null_and_repeated_keys(spark, leaves):
    rows = [(1, "a"), (2, "b"), (None, "n"), (None, "m"), (4, "d")]
    base = spark.createDataFrame(rows, "id long, v string")
    current = spark.createDataFrame([*rows[:3], (None, "x"), (5, "e")], "id long, v string")
    check(base, current)
    twice = spark.createDataFrame([*rows, (4, "again")], "id long, v string")
    first = digest(base, "id")
    # A key repeated on the other side only is found in the rows read.
    with pytest.raises(DuplicateKeyError):
        rangediff.value_diff(first, digest(twice, "id", like=first, check_key=False))
    with pytest.raises(DuplicateKeyError):
        rangediff.value_diff(digest(twice, "id"), digest(twice, "id"))
    same(
        rangediff.impact_value_diff(digest(twice, "id"), digest(twice, "id", check_key=False)),
        valuediff.impact_value_diff(twice, twice, "id"),
    )


def test_composite_keys_and_one_sided_columns(spark, leaves):
    base = spark.createDataFrame([(i, j, "x", float(i)) for i in range(20) for j in range(5)], "a long, b int, v string, w double")
    current = base.withColumn("b", F.col("b").cast("long")).withColumn("v", F.when(F.col("a") == 7, "y").otherwise(F.col("v")))
    current = current.withColumn("extra", F.lit(1)).filter("a != 3")
    check(base, current, ["a", "b"], ["v", "w"])
    pair = check(base, current, ["a", "b"])
    assert "extra" in {c.split("__")[-1] for c in rangediff.changed_rows(*pair).columns}


def test_nothing(spark):
    base = spark.createDataFrame([], "id long, v double")
    check(base, base)
    check(base, spark.createDataFrame([(1, 2.0)], "id long, v double"))


def test_stored_digests_open_again_and_prune(spark, leaves):
    base = spark.createDataFrame(made(300), SCHEMA)
    path = shared_path(spark, "test-digests")
    digest(base, "id", path=path, keep_rows=True)
    opened = open_digested(spark, path)
    current = spark.createDataFrame(made(300, {5}), SCHEMA)
    other = digest(current, "id", like=opened, check_key=False)
    same(rangediff.value_diff(opened, other), valuediff.value_diff(base, current, "id"))
    # Base is read from the folder of the one unequal group.
    plan = digests.compare_digests(opened, other, ["place"]).base._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[__group#\d+ IN \(-1,\d+\)\]", plan)
    unkept = shared_path(spark, "test-digests")
    digest(base, "id", path=unkept)
    with pytest.raises(ComparisonError):
        open_digested(spark, unkept)
    same(rangediff.value_diff(open_digested(spark, unkept, base), other), valuediff.value_diff(base, current, "id"))


def test_trees_must_fit(spark, leaves):
    base = spark.createDataFrame(made(100), SCHEMA)
    few = digest(spark.createDataFrame(made(3), SCHEMA), "id")
    with pytest.raises(ComparisonError):
        rangediff.value_diff(digest(base, "id"), few)
    with pytest.raises(ComparisonError):
        rangediff.value_diff(digest(base, "id", ["name"]), digest(base, "id"))
