import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError, UnsupportedTypeError
from sidewise.operators import distribution as D, histogram as H, profile as P, querydiff as Q, rowcount as R, topk as K
from sidewise.plans import quantiles
from sidewise.plans.quantiles import Request, exact_quantiles
from sidewise.sources.environments import EnvPair, Environment, Model
from sidewise.sources.export import export_rows

PEOPLE = "customer_id long, name string, age long"
ROWS = [(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)]


def people(spark, rows=ROWS):
    return spark.createDataFrame(rows, PEOPLE)


def environments(spark, base, current, **more):
    return EnvPair(Environment.of_frames(spark, {"customers": base, **more}), Environment.of_frames(spark, {"customers": current}))


def test_row_counts(spark):
    env = environments(spark, people(spark, ROWS[:2]), people(spark), only_base=people(spark, []))
    rows = {r["name"]: tuple(r)[1:] for r in R.row_count_diff(env, ["customers", "only_base", "nowhere"]).collect()}
    assert rows["customers"] == (2, 3, "ok", "ok")
    assert rows["only_base"] == (0, None, "ok", "not_in_manifest")
    assert rows["nowhere"] == (None, None, "not_in_manifest", "not_in_manifest")
    labels = {r["name"]: r for r in R.row_count_labels(R.row_count_diff(env, ["customers", "only_base"])).collect()}
    assert labels["customers"]["delta_label"] == "+50.0%" and labels["customers"]["direction"] == "increase"
    assert labels["customers"]["delta_pct_of_current"] == 33.33
    assert labels["only_base"]["delta_label"] == "Removed" and labels["only_base"]["status"] == "removed"


def test_statuses(spark, tmp_path):
    models = {
        "seed": Model("seed", lambda: people(spark), resource_type="seed"),
        "inlined": Model("inlined", lambda: people(spark), materialized="ephemeral"),
        "lost": Model("lost", lambda: spark.read.parquet(f"{tmp_path}/nowhere")),
        "untabled": Model("untabled", lambda: spark.table("no_such_table")),
    }
    env = Environment(spark, models)
    statuses = {name: env.resolve(name).status for name in models}
    assert statuses == {
        "seed": "unsupported_resource_type",
        "inlined": "unsupported_materialization",
        "lost": "table_not_found",
        "untabled": "table_not_found",
    }


def test_queries(spark):
    env = environments(spark, people(spark, [(1, "Alice", 35), *ROWS[1:]]), people(spark))
    sql = "select * from customers"
    assert Q.query_diff(env, sql, pk=["customer_id"]).count() == 2
    assert Q.query_diff(env, sql, base_sql="select customer_id, name, 0 as age from customers", pk="customer_id").count() == 6
    first = Q.run_query(env, "select * from customers order by customer_id", limit=2, count=True)
    assert (first.rows.count(), first.more, first.total) == (2, True, 3)
    assert Q.query_row_count(env, "select * from missing_table") is None
    preview = Q.query_diff(env, "select customer_id, name, age + 1 as age from customers", pk="customer_id", current_model="customers")
    assert preview.count() == 6
    with pytest.raises(ComparisonError):
        Q.query_diff(env, sql)
    aligned = Q.query_diff_side_by_side(env, sql, order_by="customer_id", changed_only=True).collect()
    assert [(r["base__age"], r["current__age"]) for r in aligned] == [(35, 30)]


def test_former_views_survive(spark):
    people(spark, ROWS[:1]).createOrReplaceTempView("customers")
    env = environments(spark, people(spark), people(spark, []))
    assert env.sql("select * from customers", "base").count() == 3
    assert spark.table("customers").count() == 1
    spark.catalog.dropTempView("customers")


def test_profile(spark):
    rows = {r["column_name"]: r for r in P.profile(people(spark)).collect()}
    assert rows["age"]["median"] == 30.0 and rows["age"]["avg"] == 30.0 and rows["age"]["min"] == "25"
    assert rows["name"]["is_unique"] and rows["name"]["min"] is None and rows["name"]["distinct_count"] == 3
    assert {r["column_name"] for r in P.profile(people(spark), columns=["NAME", "age"]).collect()} == {"name", "age"}
    approx = {r["column_name"]: r for r in P.profile(people(spark), distinct="approx", median="approx").collect()}
    assert approx["age"]["median"] == 30.0 and approx["age"]["distinct_count"] == 3


def test_profile_of_nothing(spark):
    for mode in ("exact", "approx"):
        rows = P.profile(people(spark, []), distinct=mode, median=mode).collect()
        assert len(rows) == 3
        for r in rows:
            assert (r["row_count"], r["not_null_proportion"], r["is_unique"], r["median"]) == (0, None, None, None)


def test_profile_of_other_types(spark):
    schema = "flag boolean, day date, parts array<int>, pair struct<a:int>, tags map<string,int>, price decimal(10,2), tiny tinyint"
    df = spark.createDataFrame(
        [(True, dt.date(2024, 1, 1), [1, 2], (1,), {"a": 1}, None, 1), (None, dt.date(2024, 1, 3), [1], None, {}, None, 3)], schema
    )
    rows = {r["column_name"]: r for r in P.profile(df).collect()}
    assert rows["flag"]["avg"] == 0.5 and rows["flag"]["min"] is None
    assert rows["day"]["max"] == "2024-01-03" and rows["day"]["avg"] is None
    assert rows["parts"]["median"] == 1.5 and rows["parts"]["distinct_count"] is None
    assert rows["pair"]["distinct_count"] is None and rows["pair"]["not_null_proportion"] == 0.5
    assert rows["tags"]["is_unique"] is None and rows["price"]["median"] is None and rows["tiny"]["median"] == 2.0


def test_profile_diff(spark):
    base = people(spark).withColumn("old", F.lit(1))
    current = people(spark, [*ROWS, (4, None, 40)])
    rows = {r["column_name"]: r for r in P.profile_diff(base, current).collect()}
    assert rows["old"]["status"] == "removed" and rows["age"]["status"] == "modified"
    assert "median" in rows["age"]["changed_fields"]
    assert {r["status"] for r in P.profile_diff(base, base).collect()} == {None}


def test_top_k(spark):
    base = people(spark, [(1, "Alice", 1), (2, "Bob", 1), (3, "Charlie", 1), (4, None, 1)])
    current = people(spark, [(1, "Alice", 1), (2, "Bob", 1), (3, "Charlie", 1), (4, "Bob", 1)])
    rows = K.top_k_diff(base, current, "name").collect()
    assert tuple(rows[0]) == ("Bob", 1, 2, 4, 3, 4, 4)
    shares = {r["label"]: (r["base_count"], r["curr_count"]) for r in K.top_k_shares(K.top_k_diff(base, current, "name", k=1)).collect()}
    assert shares == {"Bob": (1, 2), "(others)": (2, 2)}
    empty = K.top_k_diff(people(spark, [(1, None, 1)]), people(spark, [(1, None, 1)]), "name")
    assert empty.count() == 0 and K.top_k_shares(empty).count() == 0


def test_integer_histogram(spark):
    df = people(spark, [(i, "x", age) for i, age in enumerate((30, 25, 35, 50))])
    bins = H.histogram_diff(df, df, "age").orderBy("bin").collect()
    assert [b["bin_start"] for b in bins] == list(range(25, 51)) and bins[-1]["bin_end"] == 51
    assert bins[0]["base_count"] == bins[-1]["curr_count"] == 1 and bins[0]["base_total"] == 4
    assert sum(b["curr_count"] for b in bins) == 4


def test_histogram_without_rows(spark):
    none, some = people(spark, []), people(spark, ROWS)
    assert H.histogram_diff(none, none, "age").count() == 0
    one_sided = H.histogram_diff(none, some, "age").collect()
    assert sum(b["base_count"] for b in one_sided) == 0 and sum(b["curr_count"] for b in one_sided) == 3
    with pytest.raises(UnsupportedTypeError):
        H.histogram_diff(some, some, "name")


def test_constant_and_odd_floats(spark):
    df = spark.createDataFrame([(2.5,), (2.5,), (float("nan"),), (None,)], "v double")
    bins = H.histogram_diff(df, df, "v").collect()
    assert [(b["bin_start"], b["bin_end"], b["base_count"], b["base_total"]) for b in bins] == [(2.5, 2.5, 2, 3)]


def test_calendar_histograms(spark):
    def bins(days):
        df = spark.createDataFrame([(d,) for d in days], "d date")
        return H.histogram_diff(df, df, "d").orderBy("bin").collect()

    daily = bins([dt.date(2024, 1, 30), dt.date(2024, 2, 2)])
    assert [b["bin_start"] for b in daily] == [dt.date(2024, 1, 30) + dt.timedelta(i) for i in range(4)]
    assert [b["base_count"] for b in daily] == [1, 0, 0, 1]
    monthly = bins([dt.date(2023, 11, 30), dt.date(2024, 2, 29)])
    assert [b["bin_start"].month for b in monthly] == [11, 12, 1, 2] and monthly[-1]["base_count"] == 1
    decades = bins([dt.date(1800, 6, 1), dt.date(2000, 6, 1)])
    assert decades[0]["bin_end"] == dt.date(1805, 1, 1) and sum(b["base_count"] for b in decades) == 2
    far = bins([dt.date(2999, 1, 1), dt.date(3500, 1, 1)])
    assert sum(b["base_count"] for b in far) == 2


@pytest.mark.parametrize("limit", [20_000, 3])
def test_exact_quantiles(spark, monkeypatch, limit):
    # With a tiny fetch limit every column goes through brackets that are narrowed several times.
    monkeypatch.setattr(quantiles, "FETCH_LIMIT", limit)
    chance = random.Random(5)
    columns = {
        "uniform": [chance.random() for _ in range(997)],
        "hot": [7.0] * 600 + [float(chance.randrange(50)) for _ in range(397)],
        "few": [float(chance.randrange(3)) for _ in range(997)],
        "constant": [1.0] * 997,
        "wild": [chance.choice([-1, 1]) * 10.0 ** chance.randrange(-300, 300) for _ in range(997)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    fractions = [0.0, 0.1, 0.5, 0.909091, 1.0]
    found = exact_quantiles([Request(df, F.col(c), fractions) for c in columns])
    for values, results in zip(columns.values(), found):
        ordered = sorted(values)
        for fraction, result in zip(fractions, results):
            place = (len(ordered) - 1) * fraction
            low, high = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
            assert result == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-9)
    assert exact_quantiles([Request(df.limit(0), F.col("few"), [0.5])]) == [[None]]


def density(spark, low, high, cuts):
    df = spark.createDataFrame([(low, high, cuts)], "min double, max double, cuts array<double>")
    row = D.quantile_density(df).first()
    return row["edges"], row["density"]


def test_density(spark):
    edges, heights = density(spark, 0.0, 100.0, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 95.0])
    areas = [h * (b - a) for h, a, b in zip(heights, edges, edges[1:])]
    assert areas == pytest.approx([1 / 11] * 11, abs=1e-5)
    tied = density(spark, 0.0, 10.0, [5.0] * 10)[1]
    assert len(tied) == 11 and tied[1:10] == [0.0] * 9
    assert density(spark, None, None, None) == ([], [])


def test_fair_union(spark):
    df = spark.createDataFrame([(list("ABCDE"), list("ABXYZ"))], "b array<string>, c array<string>")
    assert df.select(D.fair_union(F.col("b"), F.col("c"), 6)).first()[0] == list("ABCDXY")


def distribution(spark, rows, schema, mode):
    df = spark.createDataFrame(rows, schema)
    return D.distribution_diff(df, df, mode=mode).first()


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_distributions(spark, mode):
    amount = distribution(spark, [(i,) for i in range(1, 101)], "amount int", mode)
    assert amount["kind"] == "histogram" and amount["base_total"] == 100
    assert len(amount["curr_density"]) == len(amount["curr_bin_edges"]) - 1
    statuses = ["active"] * 50 + ["pending"] * 30 + ["done"] * 20
    status = distribution(spark, [(s,) for s in statuses], "status string", mode)
    assert status["values"] == ["active", "pending", "done"] and status["base_ranks"] == [1, 2, 3]
    assert status["curr_counts"] == [50, 30, 20] and status["trimmed"] is False
    labels = distribution(spark, [(f"label{i % 30}",) for i in range(300)], "label string", mode)
    assert len(labels["values"]) <= 12 and labels["trimmed"]
    unique = distribution(spark, [(str(uuid.uuid4()),) for _ in range(200)], "uid string", mode)
    assert unique["kind"] == "topk" and unique["values"] == []
    days = [(dt.datetime(2023, m, 1),) for m in range(1, 7)]
    assert distribution(spark, days, "ts timestamp", mode)["base_total"] == 6


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_one_sided_distribution(spark, mode):
    df = spark.createDataFrame([(1, "a", [1]), (2, "b", [2]), (3, "a", [3])], "n int, s string, skipped array<int>")
    rows = {r["column"]: r for r in D.distribution_diff(None, df, mode=mode).collect()}
    assert set(rows) == {"n", "s"}
    assert rows["n"]["base_bin_edges"] == [] and rows["s"]["base_ranks"] == [None, None]
    with pytest.raises(ComparisonError):
        D.distribution_diff(None, None)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', [1, 2]), (2, None, [])], "id int, text string, parts array<int>")
    path = export_rows(df, f"{tmp_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {tuple(r) for r in back.collect()} == {("1", 'say "hi"', "[1,2]"), ("2", None, "[]")}
    with pytest.raises(ComparisonError):
        export_rows(df, f"{tmp_path}/other", "xlsx")
    assert spark.read.csv(export_rows(df, f"{tmp_path}/one", "tsv", max_rows=1), header=True, sep="\t").count() == 1


def test_histograms_of_all_columns(spark):
    """Each column as by itself: with NULLs, NaN, infinities, one value, no value, and times of every span."""
    import datetime

    day = datetime.datetime(2024, 1, 5)
    rows = [(i, [None, float("nan"), float("inf"), i / 3][i % 4], 7.0, None, day + datetime.timedelta(days=i), day.date() + datetime.timedelta(days=40 * i), "x", 2**62 * (-1) ** i) for i in range(40)]
    schema = "id int, x double, same double, none long, at timestamp, on date, word string, wide long"
    base, current = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[10:], schema).withColumn("id", F.col("id").cast("long"))
    found: dict = {}
    for r in H.histogram_diff_all(base, current).collect():
        found.setdefault(r["column"], []).append(tuple(r)[1:])
    assert set(found) == {"id", "x", "same", "at", "on", "wide"}
    for name, own in found.items():
        alone = H.histogram_diff(base, current, name)
        text = [F.col(c).cast("string") if c in ("bin_start", "bin_end") else F.col(c) for c in alone.columns]
        assert sorted(own) == sorted(map(tuple, alone.select(*text).collect()))
    assert H.histogram_diff_all(base, current, ["none"]).collect() == []
    assert H.histogram_diff_all(base.select("word"), current.select("word")).collect() == []
    with pytest.raises(UnsupportedTypeError):
        H.histogram_diff_all(base, current, ["word"])
