"""Exact distinct counts from stored codes: equal to counting the rows, for any parts, without reading the table again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError
from sidewise.operators.profile import CODES, profile
from sidewise.plans.codes import LONG, encode
from sidewise.plans.storage import cut, shared_path

SCHEMA = "day string, n long, x double, word string, raw binary, at timestamp, flag boolean, list array<int>"
PARTS = ["mon", "tue", "wed", None]


def rows(count, seed=1):
    generator = random.Random(seed)
    long_texts = ["z" * LONG, "z" * (LONG + 1), "z" * 5000, "z" * 4999 + "y"]
    for _ in range(count):
        x = generator.choice([None, 0.0, -0.0, float("nan"), float(generator.randrange(50))])
        word = generator.choice([None, "", "a", "A", "a ", *long_texts])
        at = datetime(2026, 10, 25) + timedelta(minutes=generator.randrange(300))
        yield generator.choice(PARTS), generator.randrange(3000), x, word, bytes([generator.randrange(4)]), at, None, [1]


def exact(df):
    names = [c for c in df.columns if c != "list"]
    found = df.agg(*[F.count_distinct(c).alias(c) for c in names], *[F.count(c).alias(f"{c} filled") for c in names], F.count(F.lit(1)).alias("all")).first()
    return {c: (found["all"], found[f"{c} filled"], found[c]) for c in names}


def counted(df):
    return {r["column_name"]: (r["row_count"], r["filled"], r["distinct_count"]) for r in df.collect()}


def test_parts(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.createDataFrame(list(rows(8000)), SCHEMA).repartition(6).write.parquet(path)
    table = spark.read.parquet(path)
    # The hour that occurs twice when summer time ends.
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        codes = encode(table, F.col("day"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert counted(codes.counts()) == exact(table)
    for some in ("part = 'mon'", "part in ('mon', 'wed')", "part is null"):
        assert counted(codes.counts(some)) == exact(table.filter(some.replace("part", "day")))
    # Dense codes, in value order; the table is not read again.
    numbers = [r["code"] for r in codes.dictionary().orderBy("column", "value").collect()]
    assert numbers == list(range(1, len(numbers) + 1))
    assert path not in codes.counts("part = 'tue'")._jdf.queryExecution().executedPlan().toString().replace("file:", "")
    overlap = {r["column_name"]: r for r in codes.overlap("part = 'mon'", "part = 'tue'").collect()}
    for name in ("n", "word", "at", "flag"):
        one, two = ({r[0] for r in table.filter(F.col("day") == d).select(name).distinct().collect()} - {None} for d in ("mon", "tue"))
        got = overlap[name]
        assert (got["base_count"], got["current_count"], got["both_count"]) == (len(one), len(two), len(one & two))
        assert (got["base_only"], got["current_only"]) == (len(one - two), len(two - one))


def test_more_buckets_than_one(spark):
    table = spark.range(100_000).select("id", (F.col("id") % 70_000).alias("n"), (F.col("id") % 3).cast("string").alias("day"))
    codes = encode(table, F.col("day"))
    assert codes.bitmaps().select("bucket").distinct().count() == 6
    found = counted(codes.counts())
    assert (found["id"], found["n"], found["day"]) == ((100_000, 100_000, 100_000), (100_000, 100_000, 70_000), (100_000, 100_000, 3))
    assert counted(codes.counts("part <> '1'"))["id"][2] == 66_667


def test_added_parts(spark):
    first, second = (spark.createDataFrame(list(rows(700, seed)), SCHEMA) for seed in (2, 3))
    path = shared_path(spark, "test-codes")
    codes = encode(first, F.lit("one"), path=path).add(second.withColumnRenamed("word", "WORD"), F.lit("two"))
    assert counted(codes.counts()) == exact(first.unionByName(second))
    assert counted(codes.counts("part = 'two'")) == exact(second)
    assert codes.dictionary().count() == codes.dictionary().select("column", "value").distinct().count()
    values = counted(codes.counts())["n"]
    codes.add(second, F.lit("two"))
    assert counted(codes.counts())["n"] == (values[0] + 700, values[1] + 700, values[2])
    with pytest.raises(ComparisonError, match="not found"):
        codes.add(second.drop("x"), F.lit("three"))


@pytest.mark.parametrize("count", [3, 64, 65, 200])
def test_values_stored_once_whatever_the_parts(spark, monkeypatch, count):
    """A value that many parts hold is one row with a bit for each, not one row for each part."""
    stored = {}

    def noting(df, purpose="rows"):
        stored[purpose] = cut(df, purpose)
        return stored[purpose]

    monkeypatch.setattr("sidewise.plans.codes.cut", noting)
    monkeypatch.setattr("sidewise.plans.codes._BROADCAST_PARTS", 100, raising=False)
    table = spark.range(40 * count).select(
        F.nullif(F.col("id") % count, F.lit(1)).cast("string").alias("day"), (F.col("id") % 40).cast("int").alias("n"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7 / 2).alias("x"), F.expr("cast(id % 9 as decimal(9,2))").alias("d"),
        F.expr("cast(id % 5 as float) / 3").alias("f"), F.expr("timestamp_ntz'2026-03-29 02:30:00' + make_dt_interval(0, 0, 0, id % 4)").alias("t"),
    )
    codes = encode(table, F.col("day"))
    assert counted(codes.counts()) == exact(table)
    for some in ("part in ('0', '2')", "part is null", f"part = '{count - 1}'"):
        assert counted(codes.counts(some)) == exact(table.filter(some.replace("part", "day")))
    values = codes.dictionary()
    assert [r["code"] for r in values.orderBy("column", "value").collect()] == list(range(1, values.count() + 1))
    place = {day: i for i, day in enumerate(sorted((r["day"] for r in table.select("day").distinct().collect()), key=lambda d: (d is None, d or "")))}
    assert stored["pairs"].filter("column = 'n'").count() == len({(r["n"], place[r["day"]] // 64) for r in table.select("n", "day").distinct().collect()})
    more = table.withColumns({"n": F.col("n") + 20, "day": F.concat(F.lit("m"), F.col("day"))})
    codes.add(more, F.col("day"))
    assert counted(codes.counts()) == exact(table.unionByName(more))
    assert counted(codes.counts("part in ('0', 'm0', 'm2')")) == exact(table.unionByName(more).filter("day in ('0', 'm0', 'm2')"))


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], SCHEMA)
    codes = encode(empty)
    assert set(counted(codes.counts()).values()) == {(0, 0, 0)} and len(counted(codes.counts())) == 7
    assert {r["both_count"] for r in codes.overlap("true", "true").collect()} == {0}
    assert counted(codes.add(spark.createDataFrame(list(rows(50)), SCHEMA)).counts())["n"][:2] == (50, 50)
    with pytest.raises(ComparisonError):
        encode(empty.select("list"))


@pytest.mark.parametrize("count", [0, 500])
def test_profile(spark, count):
    table = spark.createDataFrame(list(rows(count)), SCHEMA)
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(profile(table, distinct=CODES)) == plain(profile(table))
    with pytest.raises(ComparisonError):
        profile(table, median=CODES)
