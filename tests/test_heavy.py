"""The most frequent values of many columns: equal to counting every value, with few rows counted value by value."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError
from sidewise.operators.topk import top_k_diff, top_k_diffs
from sidewise.plans.heavy import SHORT, heavy_values

COLUMNS = ["skewed", "even", "few", "long", "none", "c"]
SCHEMA = "b boolean, skewed long, even long, few string, long string, none string, c string"


def rows(count, seed):
    generator = random.Random(seed)
    for i in range(count):
        # One in two rows holds a value of its own, the others follow a steep law.
        skewed = i if generator.random() < 0.5 else int(generator.paretovariate(1.1))
        few = generator.choice(["x", "y", "Y", "", "é", None])
        long = generator.choice("pq") * (SHORT + generator.randrange(3))
        yield generator.random() < 0.4, skewed, generator.randrange(count // 3), few, long, None, generator.choice(["c", "category", "b"])


def brute(made, place, k):
    base, current = (Counter(str(r[place]) for r in made if r[0] is side and r[place] is not None) for side in (True, False))
    order = sorted({*base, *current}, key=lambda v: (-current[v], -base[v], v.encode()))
    return [(v, base[v], current[v]) for v in order[:k]]


@pytest.mark.parametrize("buckets, k", [(4096, 10), (3, 7), (64, 400)])
def test_equal_to_full_counts(spark, buckets, k):
    made = list(rows(6000, k))
    found = heavy_values(spark.createDataFrame(made, SCHEMA).repartition(5), COLUMNS, F.col("b"), k, buckets)
    got = {}
    for r in found.values.orderBy("column", "place").collect():
        got.setdefault(r["column"], []).append((r["category"], r["base_count"], r["curr_count"]))
    assert got == {name: brute(made, i + 1, k) for i, name in enumerate(COLUMNS) if brute(made, i + 1, k)}
    for r in found.totals.collect():
        place = COLUMNS.index(r["column"]) + 1
        for side, name in ((True, "base"), (False, "curr")):
            own = [m[place] for m in made if m[0] is side]
            assert (r[f"{name}_total"], r[f"{name}_valids"]) == (len(own), sum(v is not None for v in own))
    assert found.totals.count() == len(COLUMNS) and found.cells == len(made) * len(COLUMNS)


def test_rare_values_are_not_counted_one_by_one(spark):
    """A million rows: half of them hold values of their own, and no bucket of those reaches the tenth frequent value."""
    share = F.pmod(F.xxhash64("id"), F.lit(1000))
    table = spark.range(1_000_000).select(
        (F.col("id") % 2 == 0).alias("b"), F.when(share < 500, F.pmod(share, F.lit(20))).otherwise(F.col("id") + 1000).alias("v")
    )
    found = heavy_values(table, ["v"], F.col("b"), 10)
    assert (found.opened, found.cells) == (0, 1_000_000)
    full = table.filter("v < 20").groupBy("v").agg(F.count_if("b").alias("x"), F.count_if(~F.col("b")).alias("y"))
    best = full.orderBy(F.desc("y"), F.desc("x"), F.col("v").cast("string")).limit(10).collect()
    assert [(r["category"], r["base_count"], r["curr_count"]) for r in found.values.orderBy("place").collect()] == [(str(r["v"]), r["x"], r["y"]) for r in best]


def test_diffs_of_all_columns(spark):
    base, current = (spark.createDataFrame(list(rows(900, s)), SCHEMA) for s in (5, 6))
    current = current.withColumn("few", F.when(F.col("few") == "x", "only here").otherwise(F.col("few"))).withColumn("list", F.array("b"))
    found = top_k_diffs(base.withColumn("list", F.array("b")), current, k=4).collect()
    for name in ("b", *COLUMNS):
        alone = [tuple(r) for r in top_k_diff(base, current, name, k=4).collect()]
        assert [tuple(r)[1:] for r in found if r["column_name"] == name] == alone
    assert "list" not in {r["column_name"] for r in found}
    with pytest.raises(ComparisonError):
        top_k_diffs(base, current, k=0)
    with pytest.raises(ComparisonError):
        top_k_diffs(base.select("b"), current.select("few"))


def test_empty_sides(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(list(rows(60, 7)), SCHEMA)
    assert top_k_diffs(empty, empty).collect() == []
    # Without rows in current, base alone orders the values.
    left = [tuple(r)[1:] for r in top_k_diffs(some, empty, ["few"]).collect()]
    assert left == [tuple(r) for r in top_k_diff(some, empty, "few").collect()] and left
    right = [tuple(r)[1:] for r in top_k_diffs(empty, some, ["FEW"]).collect()]
    assert right == [tuple(r) for r in top_k_diff(empty, some, "few").collect()]


def test_only_columns_without_frequent_values_are_counted_by_value(spark):
    """Cells are looked up by one number, and columns whose buckets stay closed are not stacked a second time."""
    table = spark.range(20_000).select((F.col("id") % 2 == 0).alias("b"), (F.col("id") % 5).alias("few"), F.col("id").alias("own"))
    found = heavy_values(table, ["few", "own"], F.col("b"), 3)
    text = found.values._jdf.queryExecution().executedPlan().toString()
    assert found.opened <= 20_000 and "AS v0" not in text and "AS v1" in text
    assert [r["category"] for r in found.values.filter("column = 'few'").orderBy("place").collect()] == ["0", "1", "2"]
