"""Stored sketches: merged for any parts within the documented errors, without reading the table again."""

import random

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError
from sidewise.operators import distribution, sketched
from sidewise.plans.sketches import RANK_ERROR, merged, sketch
from sidewise.plans.storage import shared_path

SCHEMA = "day string, n long, x double, word string, at timestamp, list array<int>, flag boolean"


def rows(count, seed=1):
    generator = random.Random(seed)
    for i in range(count):
        day = generator.choice(["mon", "tue", "wed", None])
        x = generator.choice([None, float("nan"), generator.gauss(0, 5), generator.gauss(100, 1)])
        yield day, i, x, generator.choice(["a", "b", "c", None]), None, [i], generator.random() < 0.3


def test_merged_parts(spark, tmp_path):
    made = list(rows(6000))
    table = spark.createDataFrame(made, SCHEMA).repartition(5)
    path = f"{tmp_path}/table"
    table.write.parquet(path)
    sketches = sketch(spark.read.parquet(path), F.col("day"))
    assert {r["part"] for r in sketches.select("part").distinct().collect()} == {"mon", "tue", "wed", None}
    some = sketches.filter("part in ('mon', 'wed')")
    found = {r["column"]: r for r in merged(some, [0.1, 0.5, 0.9]).collect()}
    assert set(found) == {"day", "n", "x", "word", "at", "flag"}
    own = [r for r in made if r[0] in ("mon", "wed")]
    xs = sorted(r[2] for r in own if r[2] is not None and r[2] == r[2])
    assert found["n"]["rows"] == len(own) and found["x"]["filled"] == sum(r[2] is not None for r in own)
    assert (found["x"]["low"], found["x"]["high"]) == (xs[0], xs[-1]) and found["x"]["total"] == pytest.approx(sum(xs))
    for fraction, value in zip((0.1, 0.5, 0.9), found["x"]["quantiles"]):
        assert abs(sum(v <= value for v in xs) / len(xs) - fraction) <= RANK_ERROR + 1 / len(xs)
    assert abs(found["n"]["distinct_count"] - len(own)) <= 0.04 * len(own)
    counts = {w: sum(r[3] == w for r in own) for w in "abc"}
    assert {t["value"]: t["count"] for t in found["word"]["top"]} == counts
    assert {t["value"] for t in found["flag"]["top"]} == {"true", "false"} and found["n"]["top"] is None
    # A column without a value has no bounds and no quantiles.
    assert (found["at"]["filled"], found["at"]["low"], found["at"]["quantiles"], found["at"]["distinct_count"]) == (0, None, None, 0)
    # The table is not read again.
    assert path not in merged(some, [0.5])._jdf.queryExecution().executedPlan().toString().replace("file:", "")


def test_parts_are_added(spark):
    path = shared_path(spark, "test-sketches")
    first = spark.createDataFrame(list(rows(500, 2)), SCHEMA)
    second = spark.createDataFrame(list(rows(700, 3)), SCHEMA)
    sketch(first, F.lit("one"), path=path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sketch(second, F.lit("two"), path=path)
    both = sketch(second, F.lit("two"), path=path, append=True)
    whole = sketch(first.unionByName(second))
    keep = ["column", "class", "rows", "filled", "low", "high", "distinct_count"]
    key = lambda df: sorted(map(str, merged(df).select(*keep).collect()))
    assert key(both) == key(whole)


def test_distribution_and_profile(spark):
    base = spark.createDataFrame([(i, i / 7, "a" if i % 3 else "b", str(i)) for i in range(3000)], "id long, x double, kind string, name string")
    current = base.filter("id % 10 != 0").withColumn("kind", F.when(F.col("id") % 50 == 1, "c").otherwise(F.col("kind"))).withColumn("extra", F.lit(True))
    found = {r["column"]: r for r in sketched.distribution_diff(sketch(base, F.col("kind")), sketch(current)).collect()}
    exact = {r["column"]: r for r in distribution.distribution_diff(base, current, mode="exact").collect()}
    assert set(found) == set(exact) and all(found[c]["kind"] == exact[c]["kind"] for c in exact)
    for name in ("kind", "name", "extra"):
        for field in ("values", "base_counts", "curr_counts", "base_ranks", "curr_ranks", "trimmed"):
            assert found[name][field] == exact[name][field]
    # Practically unique: no list.
    assert found["name"]["values"] == []
    for near, value in zip(found["x"]["base_bin_edges"], exact["x"]["base_bin_edges"]):
        assert abs(near - value) <= RANK_ERROR * 3000 / 7 + 1 / 7
    alone = {r["column"]: r for r in sketched.distribution_diff(sketch(base), None).collect()}
    assert alone["x"]["curr_bin_edges"] in (None, []) and alone["x"]["curr_total"] == 0
    with pytest.raises(ComparisonError):
        sketched.distribution_diff(None, None)

    one = {r["column_name"]: r for r in sketched.profile(sketch(base, F.col("kind"))).collect()}
    assert (one["x"]["row_count"], one["x"]["min"], one["name"]["is_unique"], one["kind"]["is_unique"]) == (3000, 0.0, True, False)
    assert one["x"]["avg"] == pytest.approx(2999 / 14) and one["kind"]["median"] is None
    same = sketched.profile_diff(sketch(base, F.col("kind")), sketch(base.repartition(3)))
    assert {(r["column_name"], r["status"]) for r in same.collect()} == {(c, None) for c in base.columns}
    diff = {r["column_name"]: (r["status"], r["changed_fields"]) for r in sketched.profile_diff(sketch(base), sketch(current)).collect()}
    assert diff["extra"][0] == "added" and "row_count" in diff["x"][1] and "distinct_count" in diff["name"][1]


def test_nothing_to_describe(spark):
    empty = sketch(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and merged(empty).count() == 0 and sketched.profile(empty).collect() == []
    with pytest.raises(ComparisonError):
        sketch(spark.createDataFrame([([1],)], "list array<int>"))
