from decimal import Decimal

import pytest
from pyspark.sql import types as T

from sidewise.functions import columns as C
from sidewise.operators.rowdiff import cell_diff, changed_columns, duplicate_key_flags, row_diff, row_diff_positional, row_diff_stats, zip_rows

NAN, INF = float("nan"), float("inf")


def status(spark, base_type, base, current_type, current):
    left = spark.createDataFrame([(1, base)], f"id int, v {base_type}")
    right = spark.createDataFrame([(1, current)], f"id int, v {current_type}")
    return row_diff(left, right, "id").first()["status"]


@pytest.mark.parametrize(
    "dtype, base, current, changed",
    [
        ("double", 0.30000000000000004, 0.3, False),
        ("double", 100.0, 100.9, True),
        ("double", 0.0, 0.001, True),
        ("double", 0.0, 1e-13, False),
        ("double", None, 0.3, True),
        ("double", None, None, False),
        ("double", NAN, NAN, False),
        ("double", NAN, 1.0, True),
        ("double", INF, 5.0, True),
        ("double", INF, INF, False),
        ("double", INF, -INF, True),
        ("decimal(18,2)", Decimal("19.99"), Decimal("20.00"), True),
        ("bigint", 9007199254740993, 9007199254740992, True),
        ("string", "a", "A", True),
        ("string", "0.3", "0.30", True),
        ("boolean", True, None, True),
        ("array<double>", [0.1 + 0.2, 1.0], [0.3, 1.0], False),
        ("array<double>", [0.3], [0.5], True),
        ("array<double>", [0.3], [0.3, 1.0], True),
        ("array<double>", [None], [None], False),
        ("array<double>", [None], [0.0], True),
        ("struct<x:double,y:string>", (0.1 + 0.2, "k"), (0.3, "k"), False),
        ("struct<x:double,y:string>", (0.3, "k"), (0.3, "l"), True),
        ("struct<x:double,y:string>", None, (0.3, "l"), True),
        ("map<string,double>", {"a": 0.1 + 0.2, "b": 1.0}, {"b": 1.0, "a": 0.3}, False),
        ("map<string,double>", {"a": 0.3}, {"b": 0.3}, True),
        ("map<string,int>", {"a": 1, "b": 2}, {"b": 2, "a": 1}, False),
        ("array<struct<p:double>>", [(0.1 + 0.2,)], [(0.3,)], False),
    ],
)
def test_cells(spark, dtype, base, current, changed):
    assert (status(spark, dtype, base, dtype, current) == "modified") is changed


def test_types_across_sides(spark):
    assert status(spark, "decimal(18,2)", Decimal("19.99"), "decimal(20,3)", Decimal("19.990")) is None
    assert status(spark, "int", 7, "bigint", 7) is None
    assert status(spark, "int", 7, "string", "7") == "modified"
    assert status(spark, "int", None, "string", None) is None
    # The current side decides: a column turned double is compared with a tolerance, one turned decimal is not.
    assert status(spark, "decimal(30,20)", Decimal("0.30000000000000000001"), "double", 0.3) is None


def test_row_diff(spark):
    base = spark.createDataFrame([(1, "a", 1.0, 9), (2, "b", 2.0, 9), (3, "c", 3.0, 9)], "id int, s string, x double, gone int")
    current = spark.createDataFrame([(1, "a", 1.0, 8), (2, "B", 2.5, 8), (4, "d", 4.0, 8)], "id int, s string, x double, new int")
    diff = row_diff(base, current, "id")
    rows = {r["id"]: (r["status"], r["changed_columns"]) for r in diff.collect()}
    assert rows == {1: (None, []), 2: ("modified", ["s", "x"]), 3: ("removed", []), 4: ("added", [])}
    assert {"base__gone", "current__new"} <= set(diff.columns)
    assert {r["id"] for r in row_diff(base, current, "id", changed_only=True).collect()} == {2, 3, 4}
    assert tuple(row_diff_stats(diff).first()) == (1, 1, 1)
    assert {tuple(r) for r in changed_columns(diff).collect()} == {("s", 1), ("x", 1)}
    cells = {tuple(r) for r in cell_diff(base, current, "id").collect()}
    assert cells == {(2, "s", "b", "B"), (2, "x", "2.0", "2.5"), (3, "s", "c", None), (3, "x", "3.0", None), (4, "s", None, "d"), (4, "x", None, "4.0")}


def test_duplicate_flags(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    current = spark.createDataFrame([(None,), (None,)], "id int")
    assert tuple(duplicate_key_flags(base, current, "id").first()) == (False, True)


def test_positional(spark):
    base = spark.createDataFrame([(i, "x") for i in (5, 3, 1)], "k int, v string")
    current = spark.createDataFrame([(i, "x") for i in (1, 3, 4, 6)], "k int, v string")
    rows = {r["row_number"]: (r["base__k"], r["current__k"], r["status"]) for r in row_diff_positional(base, current, "k").collect()}
    assert rows == {1: (1, 1, None), 2: (3, 3, None), 3: (5, 4, "modified"), 4: (None, 6, "added")}
    assert [(r["base__k"], r["current__k"]) for r in zip_rows(base, current, "k").orderBy("row_number").collect()] == [(1, 1), (3, 3), (5, 4), (None, 6)]


def test_positions_with_many_copies(spark):
    from sidewise.plans.ordering import number_rows

    rows = [(7, "same")] * 500 + [(i, "other") for i in range(300)]
    numbered = number_rows(spark.createDataFrame(rows, "k int, v string").repartition(6), "k").collect()
    assert sorted(r["row_number"] for r in numbered) == list(range(1, 801))
    ordered = [r["k"] for r in sorted(numbered, key=lambda r: r["row_number"])]
    assert ordered == sorted(ordered)


def test_identifiers():
    assert [C.unquote(n) for n in ('"a"', "`a`", "[a b]", "a", '"', "")] == ["a", "a", "a b", "a", '"', ""]
    assert C.resolve_columns(["ID", '"Name"', "missing"], ["id", "NAME", "Name"]) == ["id", "Name", "missing"]


def test_merging_names():
    assert C.merge_names(list("abc"), list("axc")) == list("abxc")
    assert C.merge_names(list("abd"), list("acd")) == list("abcd")
    assert C.merge_names([], list("ab")) == list("ab")
    assert C.merge_columns(list("abc"), list("cab")) == [("c", None), ("a", "reordered"), ("b", "reordered")]
    assert dict(C.merge_columns(list("ab"), list("bc"))) == {"a": "removed", "b": None, "c": "added"}


def test_type_classes():
    assert C.comparison_class(T.DoubleType()) == "float" and C.comparison_class(T.LongType()) == "integer"
    assert C.comparison_class(T.DecimalType(18, 2)) == "number" and C.comparison_class(T.StringType()) is None
    assert [C.classify_column(t) for t in (T.ArrayType(T.LongType()), T.DateType(), T.ShortType(), T.BooleanType())] == ["skip", "datetime", "numeric", "categorical"]
    assert not C.histogram_supported(T.BooleanType()) and C.histogram_supported(T.DecimalType(3, 1))


def test_profile_scope():
    assert C.profile_scope([], []) == (False, None)
    assert C.profile_scope(["a"], ["b", "a"]) == (True, ["a", "b"])
    assert C.profile_scope(["a"], whole_model_change=True) == (True, None)
