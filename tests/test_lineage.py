import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sidewise.functions.columns import merge_columns
from sidewise.operators import impact as I, lineage as L, results as R, schema as S
from sidewise.operators.selection import LineageGraph
from sidewise.plans import closure as closures
from sidewise.plans.closure import DOWN, UP, closure
from sidewise.sources.artifacts import ArtifactTables, load_artifact_tables, write_artifacts
from sidewise.sources.environments import EnvPair, Environment

NODES = "env string, node_id string, name string, resource_type string, package_name string, schema_name string, materialized string, tags array<string>, checksum string, primary_key string"


def node(env, name, checksum="1", kind="model", materialized="table", tags=("t",), schema="main"):
    return (env, f"{kind}.{name}", name, kind, "pkg", schema, materialized, list(tags), checksum, None)


def edge(env, parent, child):
    return (env, f"model.{parent}", f"model.{child}")


def ids(df):
    return {r["node_id"] for r in df.select("node_id").collect()}


@pytest.fixture(scope="module")
def graph(spark):
    """raw -> stg -> mart, old removed, fresh added; stg is modified."""
    nodes = [node(e, n) for e in ("base", "current") for n in ("raw", "mart")]
    nodes += [node("base", "stg", "1"), node("current", "stg", "2", schema="dev"), node("base", "old"), node("current", "fresh", tags=("x",))]
    edges = [edge(e, a, b) for e in ("base", "current") for a, b in (("raw", "stg"), ("stg", "mart"))]
    edges += [edge("base", "raw", "old"), edge("current", "stg", "fresh"), edge("base", "ghost", "mart")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "env string, parent_id string, child_id string")


def test_lineage_diff(graph):
    nodes, edges = graph
    assert {tuple(r) for r in L.lineage_diff(nodes).collect()} == {("model.stg", "modified"), ("model.old", "removed"), ("model.fresh", "added")}
    merged = {r["name"]: (r["schema_name"], r["base_schema"], r["change_status"]) for r in L.merged_nodes(nodes).collect()}
    assert merged["stg"] == ("dev", "main", "modified") and merged["raw"] == ("main", None, None) and merged["old"][2] == "removed"
    marks = {(r["parent_id"], r["child_id"]): r["change_status"] for r in L.merged_edges(edges, nodes).collect()}
    assert marks[("model.raw", "model.old")] == "removed" and marks[("model.stg", "model.fresh")] == "added"
    assert marks[("model.raw", "model.stg")] is None and ("model.ghost", "model.mart") not in marks


def test_missing_checksum_is_modified(spark):
    nodes = spark.createDataFrame([node("base", "a", None), node("current", "a", None)], NODES)
    assert L.lineage_diff(nodes).first()["change_status"] == "modified"


@pytest.mark.parametrize("limit", [closures.BROADCAST_BYTES, 0])
def test_closure(spark, monkeypatch, limit):
    monkeypatch.setattr(closures, "BROADCAST_BYTES", limit)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 4), (4, 4)], "parent int, child int")
    seeds = spark.createDataFrame([(1,)], "vertex int")
    assert {tuple(r) for r in closure(edges, seeds, DOWN).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r["vertex"] for r in closure(edges, seeds, DOWN, 1).collect()} == {1, 2}
    ups = closure(edges, spark.createDataFrame([(4,)], "vertex int"), UP)
    assert {tuple(r) for r in ups.collect()} == {(4, 0), (3, 1), (9, 1), (2, 2), (1, 3)}
    assert closure(edges, seeds.limit(0)).count() == 0


def test_selection(graph):
    g = LineageGraph.of(*graph)
    assert ids(g.by_name("raw").ids) == {"model.raw"} and len(ids(g.by_type("model").ids)) == 5
    assert ids(g.by_tag("x").ids) == {"model.fresh"} and ids(g.by_materialization("incremental").ids) == set()
    assert ids(g.modified().ids) == {"model.stg", "model.old", "model.fresh"}
    assert ids(g.modified().plus_down().ids) == {"model.stg", "model.old", "model.fresh", "model.mart"}
    assert ids(g.changed_models().ids) == ids(g.all().ids)
    assert ids(g.by_name("raw").union(g.by_name("mart")).ids) == {"model.raw", "model.mart"}
    assert ids(g.by_name("raw").intersect(g.by_name("mart")).ids) == set()
    assert ids(g.select(exclude=g.by_name("raw")).ids) == ids(g.all().ids) - {"model.raw"}
    assert ids(g.by_name("mart").plus_up(1).ids) == {"model.mart", "model.stg"}
    assert ids(g.select(packages=["other"]).ids) == set()
    assert g.by_name("old").nodes().first()["change_status"] == "removed"


COL_EDGES = "parent_node string, parent_column string, child_node string, child_column string"


@pytest.fixture(scope="module")
def columns_graph(spark):
    edges = [
        ("raw", "a", "stg", "a"), ("raw", "b", "stg", "b"), ("stg", "a", "mart", "x"), ("stg", "b", "mart", None),
        ("raw", None, "stg", None), ("stg", None, "mart", None), ("mart", "x", "report", "x"), ("mart", None, "report", None),
    ]
    names = [("raw", "a"), ("raw", "b"), ("stg", "a"), ("stg", "b"), ("mart", "x"), ("mart", "y"), ("report", "x")]
    columns = spark.createDataFrame([("current", n, c, i, "int") for i, (n, c) in enumerate(names, 1)], "env string, node_id string, column_name string, ordinal int, data_type string")
    nodes = columns.select("node_id").distinct()
    return nodes, columns, spark.createDataFrame(edges, COL_EDGES)


def changes(spark, nodes, columns):
    return (
        spark.createDataFrame(nodes, "node_id string, change_status string, category string"),
        spark.createDataFrame(columns, "node_id string, column_name string, change_status string"),
    )


def test_column_lineage(spark, columns_graph):
    rows = {(r["node_id"], r["column_name"]): r["direction"] for r in L.column_lineage(columns_graph[2], "stg", "a").collect()}
    assert rows == {("raw", "a"): "up", ("stg", "a"): "self", ("mart", "x"): "down", ("report", "x"): "down"}
    assert {tuple(r) for r in L.direct_downstream(columns_graph[2], "stg").collect()} == {("mart", None), ("mart", "x")}


def test_impact_radius(spark, columns_graph):
    nodes, columns, edges = columns_graph
    partial = changes(spark, [("stg", "modified", "partial_breaking")], [("stg", "b", "modified")])
    rows = {(r["node_id"], r["column_name"]): r["impacted"] for r in L.impact_radius(nodes, columns, edges, *partial).collect()}
    # Column b is used by mart as a whole; stg itself is kept although its own flag stays false.
    assert rows == {("stg", None): False, ("mart", None): True, ("report", None): True, ("stg", "b"): True, ("raw", "b"): True}
    only = {(r["node_id"], r["column_name"]): r["impacted"] for r in L.impact_radius(nodes, columns, edges, *partial, node_only=True).collect()}
    assert only == {(n, None): True for n in ("raw", "stg", "mart", "report")}
    added = changes(spark, [("mart", "added", None)], [])
    rows = {(r["node_id"], r["column_name"]) for r in L.impact_radius(nodes, columns, edges, *added, up=False).collect()}
    assert rows == {("mart", None), ("report", None), ("mart", "x"), ("mart", "y"), ("report", "x")}
    removed = changes(spark, [("raw", "removed", None)], [])
    assert [tuple(r) for r in L.impact_radius(nodes, columns, edges, *removed).collect()] == [("raw", None, False)]


def test_impact_flags(spark, columns_graph):
    nodes, columns, edges = columns_graph
    node_changes, column_changes = changes(spark, [("stg", "modified", "model_wide"), ("raw", "removed", None)], [("stg", "a", "modified")])
    assert {tuple(r) for r in L.impacted_columns(edges, column_changes).collect()} == {("stg", "a"), ("mart", "x"), ("report", "x")}
    node_edges = edges.filter("parent_column is null").selectExpr("parent_node as parent_id", "child_node as child_id")
    assert {tuple(r) for r in L.whole_model_impact(node_edges, node_changes).collect()} == {("stg", True), ("mart", False), ("report", False)}
    flags = spark.createDataFrame([("mart", True)], "node_id string, impacted boolean")
    impacted = {r["node_id"]: r["impacted"] for r in L.node_impacted(nodes, node_changes, flags, column_changes.limit(0)).collect()}
    assert impacted == {"raw": True, "stg": True, "mart": True, "report": False}
    marked = {(r["node_id"], r["column_name"]): r["change_status"] for r in L.annotate_changes(nodes, columns, node_changes, column_changes)[1].collect()}
    assert marked[("raw", "a")] == "removed" and marked[("stg", "a")] == "modified" and marked[("stg", "b")] is None


def columns_table(spark, base, current):
    rows = [
        (env, f"n{i}", name, position, kind)
        for env, lists in (("base", base), ("current", current))
        for i, names in enumerate(lists)
        for position, (name, kind) in enumerate(names, 1)
    ]
    return spark.createDataFrame(rows, "env string, node_id string, column_name string, ordinal int, data_type string")


def test_reordering_matches_the_merged_list(spark):
    chance = random.Random(3)
    base, current = [], []
    for _ in range(150):
        names = list("abcdefgh")
        sides = []
        for _ in range(2):
            chance.shuffle(names)
            sides.append(names[: chance.randrange(1, 9)])
        base.append([(n, "int") for n in sides[0]])
        current.append([(n, "int") for n in sides[1]])
    rows = S.schema_diff_ordered(columns_table(spark, base, current)).collect()
    found = {(r["node_id"], r["column_name"]) for r in rows if r["reordered"]}
    expected = {
        (f"n{i}", name)
        for i, (b, c) in enumerate(zip(base, current))
        for name, status in merge_columns([n for n, _ in b], [n for n, _ in c])
        if status == "reordered"
    }
    assert found == expected


def test_schema_diff(spark):
    columns = columns_table(spark, [[("a", "int"), ("b", "int")], [("a", "int")]], [[("b", "long"), ("c", "int")]])
    assert {tuple(r) for r in S.schema_diff(columns).collect()} == {("n0", "a", "removed"), ("n0", "b", "modified"), ("n0", "c", "added")}
    report = S.schema_diff_report(columns, limit=2)
    rows, more = report.rows, report.more
    assert rows.count() == 2 and more
    assert {r["node_id"]: r["schema_changed"] for r in S.schema_changed(columns).collect()} == {"n0": True, "n1": None}


def test_schema_coverage(spark):
    nodes = [(e, n, k, m) for e in ("base", "current") for n, k, m in (("n0", "model", "table"), ("n1", "model", "table"), ("e", "exposure", None), ("inl", "model", "ephemeral"))]
    nodes = spark.createDataFrame([*nodes, ("current", "new", "model", "table")], "env string, node_id string, resource_type string, materialized string")
    columns = columns_table(spark, [[("a", "int")], [("a", "int")]], [[("a", "int")]])
    assert tuple(S.schema_coverage(nodes, columns, 50).first()) == ("partial", ["n1"], 1, False)
    assert S.schema_coverage(nodes.filter("node_id <> 'n1'"), columns, 50).first()["status"] == "complete"


def test_constraints_and_key(spark):
    columns = columns_table(spark, [], [[("a", "int"), ("b", "int"), ("c", "int")]])
    tests = spark.createDataFrame(
        [("current", "n0", "c", "t1", "unique"), ("current", "n0", "b", "t2", "unique"), ("current", "n0", "b", "t3", "not_null")],
        "env string, node_id string, column_name string, test_name string, test_type string",
    )
    flags = {r["column_name"]: (r["not_null"], r["unique"]) for r in L.column_constraints(columns, tests).collect()}
    assert flags == {"a": (False, False), "b": (True, True), "c": (False, True)}
    assert L.inferred_primary_key(columns, tests).first()["primary_key"] == "b"


def test_artifacts(spark, tmp_path):
    manifest = {
        "nodes": {"model.p.orders": {"name": "orders", "resource_type": "model", "package_name": "p", "schema": "main", "tags": ["t"], "config": {"materialized": "table"}, "checksum": {"checksum": "abc"}},
                  "model.p.stale": {"name": "stale", "resource_type": "model"}},
        "sources": {"source.p.raw": {"name": "raw", "resource_type": "source"}},
        "child_map": {"source.p.raw": ["model.p.orders"], "model.p.orders": ["test.p.unique_orders_id.1", "test.p.not_null_orders_ghost.2", "test.p.not_null_orders_amount.3"]},
    }
    catalog = {"nodes": {"model.p.orders": {"columns": {"AMOUNT": {"type": "int"}, "ID": {"type": "long"}, "amount": {"type": "text"}}}}}
    other = {"nodes": {"model.p.stale": {"columns": {"x": {"type": "int"}}}, "model.p.orders": {"columns": {"y": {"type": "int"}}}}, "sources": {}}
    for side, files in (("current", (manifest, catalog)), ("base", (manifest, other))):
        for project in ("one", "two"):
            folder = tmp_path / side / project
            folder.mkdir(parents=True)
            (folder / "manifest.json").write_text(json.dumps(files[0]))
            (folder / "catalog.json").write_text(json.dumps(files[1]))
    tables = load_artifact_tables(spark, f"{tmp_path}/current/*/manifest.json", f"{tmp_path}/current/*/catalog.json", "current", f"{tmp_path}/base/*/catalog.json")
    assert tables.nodes.count() == 6 and tables.edges.count() == 8
    orders = tables.nodes.filter("node_id = 'model.p.orders'").first()
    assert (orders["primary_key"], orders["checksum"], orders["materialized"]) == ("ID", "abc", "table")
    columns = {(r["node_id"], r["column_name"], r["ordinal"], r["data_type"]) for r in tables.columns.collect()}
    assert columns == {("model.p.orders", "AMOUNT", 1, "int"), ("model.p.orders", "ID", 2, "long"), ("model.p.stale", "x", 1, "int")}
    tests = {(r["column_name"], r["test_type"]) for r in tables.node_tests.collect()}
    assert tests == {("ID", "unique"), ("AMOUNT", "not_null")}


MODELS = "node_id string, name string, change_status string, materialized string, primary_key string"
SCHEMA_CHANGES = "node_id string, column_name string, change_status string"


def test_impact_analysis(spark):
    people = "id long, name string, age long"
    base = {"customers": spark.createDataFrame([(1, "A", 1), (2, "B", 2)], people), "orders": spark.createDataFrame([(1, "x", 5)], people)}
    current = {"customers": spark.createDataFrame([(1, "A", 9), (2, "B", 9), (3, "C", 3)], people), "orders": base["orders"], "fresh": base["orders"]}
    current["v"] = base["v"] = base["orders"]
    env = EnvPair(Environment.of_frames(spark, base), Environment.of_frames(spark, current))
    models = [
        ("model.customers", "customers", "modified", "table", "id"),
        ("model.orders", "orders", None, "table", "id"),
        ("model.fresh", "fresh", "added", "table", "id"),
        ("model.v", "v", None, "view", "id"),
        ("model.gone", "gone", "removed", "table", "id"),
    ]
    schema_changes = spark.createDataFrame([("model.fresh", "id", "added")], SCHEMA_CHANGES)
    unchecked = spark.createDataFrame([("model.v",)], "node_id string")
    found = I.impact_analysis(env, spark.createDataFrame(models, MODELS), schema_changes, unchecked=unchecked)
    rows = {r["name"]: r for r in found.collect()}
    assert rows["customers"]["data_impact"] == "confirmed" and rows["customers"]["affected_row_count"] == 3
    assert rows["customers"]["next_action"] is None and rows["customers"]["delta_pct"] == 50.0
    assert rows["orders"]["data_impact"] == "none" and rows["orders"]["schema_changes"] == []
    assert rows["fresh"]["next_action"]["priority"] == "high" and rows["fresh"]["next_action"]["columns"] == ["id"]
    assert rows["v"]["data_impact"] == "potential" and rows["v"]["next_action"]["priority"] == "low"
    assert rows["v"]["schema_changes"] is None and rows["gone"]["base_rows"] is None
    skipped = I.impact_analysis(env, spark.createDataFrame(models[:2], MODELS), schema_changes, skip_downstream_value_diff=True)
    assert {r["name"]: r["data_impact"] for r in skipped.collect()} == {"customers": "confirmed", "orders": "potential"}


def test_stable_counts_with_many_changes(spark):
    base = spark.createDataFrame([(i, 0) for i in range(10)], "id int, v int")
    current = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, v int")
    env = EnvPair(Environment.of_frames(spark, {"t": base}), Environment.of_frames(spark, {"t": current}))
    models = spark.createDataFrame([("model.t", "t", "modified", "table", "id")], MODELS)
    row = I.impact_analysis(env, models, spark.createDataFrame([], SCHEMA_CHANGES)).first()
    assert row["next_action"]["priority"] == "medium" and row["next_action"]["columns"] == ["v"]


CHECKS = "check_id string, name string, type string, params string, view_options string, is_checked boolean, is_preset boolean, updated_at timestamp, created_by string"


def test_log_tables(spark):
    def checks(*rows):
        return spark.createDataFrame(rows, CHECKS).withColumn("updated_at", F.col("updated_at").cast("timestamp"))

    from datetime import datetime as at

    existing = checks(
        ("1", "old", "q", "p1", None, True, False, at(2024, 1, 2), "me"),
        ("2", "tie", "q", "p2", None, False, False, at(2024, 1, 2), "me"),
        ("3", "preset", "q", "p3", None, False, True, at(2024, 1, 1), "me"),
    )
    incoming = checks(
        ("1", "new", "q", "p1", None, False, False, at(2024, 1, 3), "you"),
        ("2", "later tie", "q", "p2", None, True, False, at(2024, 1, 2), "you"),
        ("9", "same preset", "q", "p3", None, True, True, at(2024, 1, 5), "you"),
        ("10", "own", "q", "p3", None, True, False, at(2024, 1, 5), "you"),
    )
    merged = {r["check_id"]: (r["name"], r["created_by"]) for r in R.upsert_latest(existing, incoming).collect()}
    assert merged == {"1": ("new", "me"), "2": ("tie", "me"), "3": ("same preset", "me"), "10": ("own", "you")}

    runs = "run_id string, check_id string, type string, run_at timestamp, status string, error string, params map<string,string>, changed boolean"
    log = spark.createDataFrame(
        [
            ("a", "1", "query", at(2024, 1, 1), "finished", None, {"m": "x"}, True),
            ("b", "1", "query", at(2024, 1, 2), "finished", None, {"m": "y"}, False),
            ("c", "2", "query", at(2024, 1, 1), "failed", "boom", {"m": "x"}, None),
            ("d", "3", "query", at(2024, 1, 1), "finished", None, {"m": "x"}, True),
        ],
        runs,
    )
    assert tuple(R.check_stats(existing, log).first()) == (3, 1, 1, 1)
    assert [r["run_id"] for r in R.search_runs(log, "query", {"m": "x"}, limit=2).collect()] == ["d", "c"]
    assert R.merge_runs(log, log).count() == 4
    results = log.selectExpr("run_id", "run_at", "type", "status", "check_id as node_id", "if(error is null, 1, null) as result")
    assert {r["node_id"]: r["run_id"] for r in R.latest_results(results).collect()} == {"1": "b", "3": "d"}


def test_verdicts(spark):
    counts = spark.createDataFrame([("a", 1, 1), ("b", 2, 3)], "name string, base int, curr int")
    assert R.is_changed(counts, "row_count_diff").first()[0] and not R.passes(counts, "row_count_diff").first()[0]
    assert [r["name"] for r in R.changed_nodes(counts, "row_count_diff").collect()] == ["b"]
    same = counts.filter("name = 'a'")
    assert R.passes(same, "row_count_diff").first()[0] and not R.is_changed(same, "row_count_diff").first()[0]
    unknown = spark.createDataFrame([("a", None, None)], "name string, base int, curr int")
    assert not R.passes(unknown, "row_count_diff").first()[0]
    values = spark.createDataFrame([("id", None, 0, 0)], "column string, matched_p double, added long, removed long")
    assert not R.is_changed(values, "value_diff").first()[0]
    assert not R.is_changed(values.limit(0), "query_diff").first()[0] and R.is_changed(values, "query_diff").first()[0]


def test_what_changed(spark):
    changes_ = spark.createDataFrame([("a", "modified"), ("b", "added"), ("c", "removed")], "node_id string, change_status string")
    counts = spark.createDataFrame([("a", 50, 100), ("d", 10, 10), ("e", 2, 1)], "node_id string, base long, curr long")
    schema_changes = spark.createDataFrame([("a",)], "node_id string")
    rows = {r["node_id"]: r["what"] for r in R.what_changed(changes_, counts, schema_changes).collect()}
    assert rows == {"a": ["Code", "Row Count +50.0%", "Schema"], "b": ["Added Node"], "c": ["Removed Node"], "e": ["Row Count -100.0%"]}


def test_radius_of_one_node_or_column(spark):
    """m1(c) -> m2(c, y) -> m3(c); m2.y -> m4(year); m1 -> m5; m2.y has no source; m6 reads m1.c past m2 and feeds m3."""
    nodes = spark.createDataFrame([(f"m{i}",) for i in range(1, 7)], "node_id string")
    columns = spark.createDataFrame(
        [("current", "m1", "c"), ("current", "m2", "c"), ("current", "m2", "y"), ("current", "m3", "c"), ("current", "m4", "year"), ("current", "m6", "c"), ("base", "m2", "gone")],
        "env string, node_id string, column_name string",
    )
    links = [("m1", "c", "m2", "c"), ("m2", "c", "m3", "c"), ("m2", "y", "m4", "year"), ("m1", "c", "m6", "c"), ("m6", "c", "m3", "c")]
    links += [("m1", None, "m2", None), ("m2", None, "m3", None), ("m2", None, "m4", None), ("m1", None, "m5", None), ("m2", "y", "m3", None)]
    edges = spark.createDataFrame([*links, links[0]], "parent_node string, parent_column string, child_node string, child_column string")
    of = lambda *args, **how: L.radius_of(nodes, columns, edges, *args, **how)
    vertices = lambda radius: {(r["node_id"], r["column_name"]) for r in radius.vertices.collect()}
    kept = lambda radius: {tuple(r)[:4]: r["on_path"] for r in radius.edges.collect()}

    column = of("m2", "y")
    assert vertices(column) == {("m2", "y"), ("m4", "year"), ("m3", None)}
    assert kept(column) == {("m2", "y", "m4", "year"): True, ("m2", "y", "m3", None): True}
    assert {r["impacted"] for r in column.vertices.collect()} == {None}
    assert vertices(of("m3", "c")) == {("m3", "c"), ("m2", "c"), ("m1", "c"), ("m6", "c")}
    assert vertices(of("m2", "c", up=False, down=False)) == {("m2", "c")} and kept(of("m2", "c", up=False, down=False)) == {}
    # A node starts at itself and its columns; what hangs on its ancestors alone is out of reach.
    whole = of("m2")
    assert vertices(whole) == {("m1", None), ("m1", "c"), ("m2", None), ("m2", "c"), ("m2", "y"), ("m3", None), ("m3", "c"), ("m4", None), ("m4", "year")}
    assert ("m1", None, "m5", None) not in kept(whole) and all(kept(whole).values()) and len(kept(whole)) == 7
    # An edge from above to below that passes the anchor by is kept, but lies on no path through it.
    aside = L.radius_of(nodes, columns, spark.createDataFrame([("m1", None, "m2", None), ("m2", None, "m3", None), ("m1", None, "m3", None)], edges.schema), "m2", node_only=True)
    assert kept(aside) == {("m1", None, "m2", None): True, ("m2", None, "m3", None): True, ("m1", None, "m3", None): False}
    assert vertices(of("m4", node_only=True)) == {("m4", None), ("m2", None), ("m1", None)}
    assert vertices(of("nothing")) == set()

    node_changes = spark.createDataFrame([("m1", "modified", "non_breaking"), ("m2", "modified", "breaking"), ("m4", "modified", "partial_breaking")], "node_id string, change_status string, category string")
    column_changes = spark.createDataFrame([("m4", "year", "modified"), ("m1", "c", "modified")], "node_id string, column_name string, change_status string")
    changed = lambda node, **how: of(node, None, node_changes, column_changes, **how)
    flags = lambda radius: {(r["node_id"], r["column_name"]): r["impacted"] for r in radius.vertices.collect()}
    # Breaking: everything below the node. Partially breaking: its changed column; the node stays, not impacted.
    assert flags(changed("m2", up=False)) == {("m2", None): True, ("m3", None): True, ("m4", None): True}
    assert flags(changed("m4", up=False)) == {("m4", None): False, ("m4", "year"): True}
    assert flags(changed("m4", up=False, node_only=True)) == {("m4", None): True}
    assert flags(changed("m1", up=False))[("m1", None)] is False and ("m3", "c") in flags(changed("m1", up=False))
    # An unchanged node starts at itself alone.
    assert flags(changed("m5")) == {("m5", None): True, ("m1", None): True}


def test_repeated_node_ids_count_once(spark):
    nodes = spark.createDataFrame([node("base", "a", "1"), node("base", "a", "2"), node("current", "a", "2"), node("current", "a", "1", schema="z"), node("current", "b", "1"), node("current", "b", "1")], NODES)
    assert {tuple(r) for r in L.lineage_diff(nodes).collect()} == {("model.b", "added")}
    merged = {r["node_id"]: (r["schema_name"], r["base_schema"]) for r in L.merged_nodes(nodes).collect()}
    assert merged == {"model.a": ("z", "main"), "model.b": ("main", None)}
    changes = spark.createDataFrame([("model.a", "modified", "breaking"), ("model.a", "modified", None)], "node_id string, change_status string, category string")
    columns = spark.createDataFrame([("model.a", "x")], "node_id string, column_name string")
    column_changes = spark.createDataFrame([("model.a", "x", "modified")] * 2, "node_id string, column_name string, change_status string")
    annotated, marked = L.annotate_changes(nodes, columns, changes, column_changes)
    assert annotated.count() == 6 and [r["change_status"] for r in marked.collect()] == ["modified"]


def test_artifact_variants_and_round_trip(spark, tmp_path):
    """Older forms of a field, files that hold no JSON object, and tables written and read back."""
    old = {"nodes": {"model.p.a": {"name": "a", "resource_type": "model", "tags": "nightly", "checksum": "abc", "config": None}, "model.p.none": None, "model.p.odd": {"name": "odd", "tags": 5, "config": "x"}}, "child_map": None}
    for name, text in (("good", json.dumps(old)), ("broken", '{"nodes": {'), ("list", "[1]"), ("empty", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    tables = load_artifact_tables(spark, f"{tmp_path}/*/manifest.json", None, "base")
    rows = {r["node_id"]: (r["tags"], r["checksum"], r["materialized"]) for r in tables.nodes.collect()}
    assert rows == {"model.p.a": (["nightly"], "abc", None), "model.p.odd": ([], None, None)}
    assert {r["artifact"].split("/")[-1] for r in tables.unreadable.collect()} == {"broken", "list"}

    fields = "artifact string, node_id string, name string, resource_type string, package_name string, schema_name string, materialized string, tags array<string>, checksum string"
    nodes = [("one", "model.p.a", 'a "quoted"', "model", "p", "main", "view", ["x", "y"], "1"), ("one", "source.p.s", "s", "source", None, None, None, [], None), ("two", "model.p.b", "b", "model", "p", "main", "table", [], "2")]
    made = ArtifactTables(
        spark.createDataFrame(nodes, fields),
        spark.createDataFrame([("one", "model.p.a", "z", 1, "int"), ("one", "model.p.a", "b", 2, None), ("two", "model.p.b", "k", 1, "text")], "artifact string, node_id string, column_name string, ordinal int, data_type string"),
        spark.createDataFrame([("one", "source.p.s", "model.p.a"), ("two", "model.p.a", "model.p.b")], "artifact string, parent_id string, child_id string"),
        spark.createDataFrame([("two", "model.p.b", "k", "test.p.unique_b_k.1", "unique")], "artifact string, node_id string, column_name string, test_name string, test_type string"),
    )
    back = load_artifact_tables(spark, *write_artifacts(made, f"{tmp_path}/written"), "current")
    named = {r["node_id"]: (r["name"], r["schema_name"], r["tags"], r["checksum"], r["primary_key"]) for r in back.nodes.collect()}
    assert named == {"model.p.a": ('a "quoted"', "main", ["x", "y"], "1", None), "source.p.s": ("s", None, [], None, None), "model.p.b": ("b", "main", [], "2", "k")}
    assert {(r["node_id"], r["column_name"], r["ordinal"], r["data_type"]) for r in back.columns.collect()} == {("model.p.a", "z", 1, "int"), ("model.p.a", "b", 2, None), ("model.p.b", "k", 1, "text")}
    assert {(r["parent_id"], r["child_id"]) for r in back.edges.collect()} == {("source.p.s", "model.p.a"), ("model.p.a", "model.p.b"), ("model.p.b", "test.p.unique_b_k.1")}
    assert [(r["column_name"], r["test_type"]) for r in back.node_tests.collect()] == [("k", "unique")] and back.unreadable.count() == 0


def plain_distances(edges, seeds):
    """Breadth-first search on the driver."""
    after = {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    found, frontier = dict.fromkeys(seeds, 0), set(seeds)
    while frontier:
        frontier = {t for s in frontier for t in after.get(s, ())} - set(found)
        found |= dict.fromkeys(frontier, max(found.values()) + 1)
    return found


@pytest.mark.parametrize("segment", [3, 1024])
def test_deep_closures(spark, monkeypatch, segment):
    """Chains, loops, circles, branches and seeds inside chains: the distances of a plain search, from either direction."""
    from sidewise.plans import chains

    monkeypatch.setattr(closures, "PLAIN_LEVELS", 1)
    monkeypatch.setattr(chains, "SEGMENT", segment)
    edges = [(i, i + 1) for i in range(1, 14)] + [(14, 5), (7, 100), (100, 101), (101, 102), (102, 9)]  # a loop and a detour
    edges += [(200, 201), (201, 202), (202, 200), (14, 300), (300, 301), (301, 302), (302, 303), (303, 303), (3, 400), (400, 3)]
    table = spark.createDataFrame([*edges, edges[0]], "parent int, child int")
    for direction, seeds in ((DOWN, [1]), (DOWN, [6, 12, 201]), (UP, [303, 10])):
        way = edges if direction == DOWN else [(t, s) for s, t in edges]
        found = closure(table, spark.createDataFrame([(s,) for s in seeds], "vertex int"), direction)
        assert sorted(map(tuple, found.collect())) == sorted(plain_distances(way, seeds).items())


def test_long_chain_in_few_jobs(spark):
    """A chain of 10 000 vertices, which plain levels would take in as many jobs."""
    chain = spark.range(10_000).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    seeds = spark.createDataFrame([("n0",)], "vertex string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long-chain", "")
    found = closure(chain, seeds, DOWN)
    assert found.agg({"degree": "max", "vertex": "count"}).first().asDict() == {"max(degree)": 10_000, "count(vertex)": 10_001}
    assert found.filter("degree != cast(substring(vertex, 2) as int)").isEmpty()
    assert len(tracker.getJobIdsForGroup("long-chain")) < 600
    spark.sparkContext.setJobGroup("", "")


def test_artifacts_are_parsed_once(spark, tmp_path):
    """Every table comes from stored rows of one parse of the manifests, and of one of the catalogs."""
    for side in ("base", "current"):
        folder = tmp_path / side
        folder.mkdir()
        node = {"name": "a", "resource_type": "model", "tags": [], "config": {}, "checksum": {"checksum": side}}
        manifest = {"nodes": {"model.p.a": node}, "sources": {}, "child_map": {"model.p.a": ["test.p.unique_a_k.1"]}}
        (folder / "manifest.json").write_text(json.dumps(manifest))
        (folder / "catalog.json").write_text(json.dumps({"nodes": {"model.p.a": {"columns": {"k": {"type": "int"}}}}, "sources": {}}))
    tables = load_artifact_tables(spark, f"{tmp_path}/*/manifest.json", f"{tmp_path}/*/catalog.json", "current")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(" text")
    assert scans(tables.nodes) <= 1 and scans(tables.node_tests) <= 1 and scans(tables.columns) <= 1
    assert scans(tables.edges) == 0
    assert sorted((r["checksum"], r["primary_key"]) for r in tables.nodes.collect()) == [("base", "k"), ("current", "k")]


def test_selection_reads_stored_tables(spark, tmp_path):
    """Steps of a selection read stored nodes and edges, not what these are derived from."""
    fields = "env string, node_id string, name string, resource_type string, package_name string, schema_name string, materialized string, tags array<string>, checksum string"
    rows = [(env, n, n, "model", "p", "s", "view", [], sums) for env, n, sums in (("base", "a", "1"), ("current", "a", "2"), ("base", "b", "1"), ("current", "b", "1"), ("base", "c", "1"))]
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame([("base", "b", "c"), ("current", "a", "b")], "env string, parent_id string, child_id string").write.parquet(f"{tmp_path}/edges")
    graph = LineageGraph.of(spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/edges"))
    chosen = graph.select(packages=["p"], changed_models=True).ids
    assert f"{tmp_path}/nodes" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert not any("/nodes" in f or "/edges/" in f for f in chosen.inputFiles())
    assert {r["node_id"] for r in chosen.collect()} == {"a", "b", "c"}


def test_radius_stores_node_changes(spark, tmp_path):
    """The changes are made once, whatever they are derived from."""
    spark.createDataFrame([("a", "modified", "breaking")], "node_id string, change_status string, category string").write.parquet(f"{tmp_path}/made")
    nodes = spark.createDataFrame([("current", "a"), ("current", "b")], "env string, node_id string")
    columns = spark.createDataFrame([("current", "a", "k")], "env string, node_id string, column_name string")
    edges = spark.createDataFrame([("a", None, "b", None)], "parent_node string, parent_column string, child_node string, child_column string")
    changed = spark.createDataFrame([], "node_id string, column_name string, change_status string")
    found = L.impact_radius(nodes, columns, edges, spark.read.parquet(f"{tmp_path}/made"), changed)
    assert not any("/made/" in f for f in found.inputFiles())
    assert {(r["node_id"], r["column_name"], r["impacted"]) for r in found.collect()} == {("a", None, True), ("b", None, True)}


def test_columns_are_shuffled_once_by_rows(spark, tmp_path, monkeypatch):
    """Ordered schema rows need one shuffle, into as many partitions as there are rows for, and store what they are made of."""
    from sidewise.plans import storage

    monkeypatch.setattr(storage, "ROWS_A_TASK", 2)
    columns_table(spark, *([[(n, "int") for n in names]] for names in ("abc", "acbd"))).write.parquet(f"{tmp_path}/made")
    made = spark.read.parquet(f"{tmp_path}/made")
    for found in (S.schema_diff_ordered(made), S.schema_changed(made)):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and f"{-(-made.count() // 2)}), REPARTITION_BY_NUM" in text
        assert not any("/made/" in f for f in found.inputFiles())


def test_causes_from_one_shuffle(spark):
    """The same rows as by joining changes and hits; a change given twice counts once, one of an unknown column not at all."""
    columns = columns_table(spark, *([[(n, "int") for n in names]] for names in ("abcd", "adbce")))
    node = columns.first()["node_id"]
    changes = spark.createDataFrame([(node, "a", "modified"), (node, "c", "unknown"), (node, "zz", "modified"), (None, "a", "unknown")], "node_id string, column_name string, change_status string")
    hits = spark.createDataFrame([(node, "b"), (node, "c"), (node, "yy"), (node, "b")], "node_id string, column_name string")
    joined = S.column_change_causes(S.schema_diff_ordered(columns), changes, hits)
    found = S.schema_change_causes(columns, changes.unionByName(changes), hits)
    assert sorted(found.select(joined.columns).collect()) == sorted(joined.collect())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_derived_table_is_stored_once(spark):
    """Column changes read the columns that are stored, and lines are shuffled once for each version."""
    from workload.tables import derived

    columns, changes = derived(spark, "/root/testdata/sf0.001", "columns_t", "column_changes_t", stored=("columns_t",))
    assert not any("lineitem" in f for f in (*columns.inputFiles(), *changes.inputFiles()))
    (plain,) = derived(spark, "/root/testdata/sf0.001", "columns_t")
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert sorted(map(str, plain.collect())) == sorted(map(str, columns.collect()))


def test_unchecked_nodes_need_one_shuffle(spark):
    """Nodes and columns meet in one grouping; a node listed on one side, or only in the columns, is not checked."""
    made = [(env, n, "model", "table") for env in ("base", "current") for n in ("n0", "n1", "n2")]
    nodes = spark.createDataFrame(made, "env string, node_id string, resource_type string, materialized string")
    listed = [("base", "n0"), ("current", "n0"), ("current", "n0"), ("base", "n1"), ("base", "zz"), ("current", "zz")]
    found = S.unchecked_nodes(nodes, spark.createDataFrame(listed, "env string, node_id string"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert {r["node_id"] for r in found.collect()} == {"n1", "n2"}


@pytest.mark.parametrize("hashed", [L.HASHED_IDS, 0])
def test_merged_edges_are_shuffled_by_child_and_not_sorted(spark, monkeypatch, hashed):
    """Edges meet once for the grouping and the look-up of the child; known ids are looked up by hash while they are few."""
    monkeypatch.setattr(L, "HASHED_IDS", hashed)
    ids = spark.range(60).select(F.concat(F.lit("n"), F.col("id")).alias("node_id"))
    nodes = ids.select(F.lit("base").alias("env"), "node_id").unionByName(ids.select(F.lit("current").alias("env"), "node_id"))
    drawn = spark.range(4000).select(
        F.expr("if(id % 2 = 0, 'base', 'current')").alias("env"), F.expr("concat('n', nullif(id * 7 % 71, 5))").alias("parent_id"),
        F.expr("concat('n', nullif(id * 11 % 67 % 65, 9))").alias("child_id"),
    ).filter("not (env = 'base' and parent_id = 'n3') and not (env = 'current' and child_id = 'n4')")
    merged = L.merged_edges(drawn, nodes)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    sides = {}
    for r in drawn.collect():
        sides.setdefault((r["parent_id"], r["child_id"]), set()).add(r["env"])
    known = {f"n{i}" for i in range(60)}
    label = lambda envs: "added" if "base" not in envs else "removed" if "current" not in envs else None
    want = sorted((*edge, str(label(envs))) for edge, envs in sides.items() if set(edge) <= known)
    assert sorted((r["parent_id"], r["child_id"], str(r["change_status"])) for r in merged.collect()) == want
    assert {w[2] for w in want} == {"added", "removed", "None"}
    if hashed:
        assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
        # Edges by child and by parent, known ids for each.
        assert plan.count("Exchange hashpartitioning") == 4 and plan.count("Exchange hashpartitioning(child_id") == 1
    else:
        assert "ShuffledHashJoin" not in plan


def test_edges_of_the_workload_are_made_by_child(spark, monkeypatch):
    """Lines are shuffled once, as numbers: neither making the edges distinct nor grouping both sides shuffles their texts."""
    from workload import tables

    monkeypatch.setattr(tables, "LINES_A_TASK", 1000)
    folder = "/root/testdata/sf0.001"
    (edges,), (plain,) = tables.derived(spark, folder, "edges_t", by_child=True), tables.derived(spark, folder, "edges_t")
    assert edges.exceptAll(plain).isEmpty() and plain.exceptAll(edges).isEmpty() and not edges.isEmpty()
    nodes = spark.range(3).select(F.lit("base").alias("env"), F.col("id").cast("string").alias("node_id"))
    plan = L.merged_edges(edges, nodes, by_child=True)._jdf.queryExecution().executedPlan().toString()
    # Edges by parent, and known ids for child and parent, beside what each table's rows are shuffled by.
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in shuffles if "REPARTITION_BY_NUM" not in line]) == 3
    assert all("REPARTITION_BY_NUM" in line for line in shuffles if "concat(order." in line or "child_id" in line)


def _project_folder(folder, manifest, catalog=None):
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text(manifest if isinstance(manifest, str) else json.dumps(manifest))
    if catalog is not None:
        (folder / "catalog.json").write_text(json.dumps(catalog))


def _load_projects(spark, tmp_path):
    return load_artifact_tables(spark, f"{tmp_path}/*/manifest.json", f"{tmp_path}/*/catalog.json", "current")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_artifact_rows_meet_once_by_node(spark, tmp_path):
    """nodes, tests and columns take one shuffle each, by node, and not one for every table that is joined."""
    manifest = {"nodes": {f"model.p.m{i}": {"name": f"m{i}", "resource_type": "model"} for i in range(3)}, "child_map": {f"model.p.m{i}": [f"test.p.unique_m{i}_B.1", f"test.p.unique_m{i}_a.1", f"test.p.not_null_m{i}_a.1", "test.p"] for i in range(3)}}
    catalog = {"nodes": {f"model.p.m{i}": {"columns": {"a": {"type": "int"}, "b": {"type": "text"}, "A": {"type": "long"}}} for i in range(3)}, "sources": {"model.p.ghost": {"columns": {"x": {"type": "int"}}}}}
    for project in ("one", "two"):
        _project_folder(tmp_path / project, manifest, catalog)
    tables = _load_projects(spark, tmp_path)
    assert [_exchanges(df) for df in (tables.nodes, tables.node_tests, tables.columns)] == [1, 1, 1]
    assert {(r["node_id"], r["primary_key"]) for r in tables.nodes.collect()} == {(f"model.p.m{i}", "a") for i in range(3)}
    listed = sorted((r["node_id"], r["column_name"], r["ordinal"], r["data_type"]) for r in tables.columns.collect())
    assert listed == sorted(2 * [x for i in range(3) for x in ((f"model.p.m{i}", "a", 1, "int"), (f"model.p.m{i}", "b", 2, "text"))])
    tests = sorted((r["node_id"], r["column_name"], r["test_type"]) for r in tables.node_tests.collect())
    assert tests == sorted(2 * [x for i in range(3) for x in ((f"model.p.m{i}", "a", "unique"), (f"model.p.m{i}", "b", "unique"), (f"model.p.m{i}", "a", "not_null"))])


def test_artifact_files_are_made_in_parts(spark, tmp_path, monkeypatch):
    """as many tasks and parts as the rows ask for, with the same files; what is stored on the way is gone afterwards."""
    from sidewise.plans.storage import CLEANUP_SETTING, checkpoint_dir
    from sidewise.sources import artifacts

    monkeypatch.setattr(artifacts, "ROWS_A_WRITER", 10)
    nodes = spark.range(40).selectExpr(
        "concat('p', id % 5) as artifact", "concat('model.p.n', id) as node_id", "concat('n', id) as name", "if(id % 7 = 0, null, 'model') as resource_type",
        "'p' as package_name", "'s' as schema_name", "'view' as materialized", "array('t') as tags", "cast(id as string) as checksum",
    )
    columns = spark.range(40).selectExpr("concat('p', id % 5) as artifact", "concat('model.p.n', id) as node_id", "'k' as column_name", "1 as ordinal", "'int' as data_type")
    edges = spark.range(80).selectExpr("concat('p', id % 5) as artifact", "concat('model.p.n', id % 40) as parent_id", "concat('model.p.n', (id + 5) % 40) as child_id")
    tests = columns.selectExpr("artifact", "node_id", "column_name", "concat('test.p.unique_', substring(node_id, 9), '_k.t') as test_name", "'unique' as test_type")
    made = ArtifactTables(nodes, columns, edges, tests)
    before, setting = set(os.listdir(f"{checkpoint_dir(spark).removeprefix('file:')}/sidewise")), spark.conf.get(CLEANUP_SETTING)
    globs = write_artifacts(made, f"{tmp_path}/written")
    assert set(os.listdir(f"{checkpoint_dir(spark).removeprefix('file:')}/sidewise")) == before and spark.conf.get(CLEANUP_SETTING) == setting
    files = [f.suffix for f in (tmp_path / "written").glob("*/part-*")]
    assert sorted(files) == [".deflate"] * 5 + [".gz"] * 5
    back = load_artifact_tables(spark, *globs, "current")
    assert back.nodes.count() == 40 and {r["primary_key"] for r in back.nodes.collect()} == {"k"}
    assert back.columns.count() == 40 and back.node_tests.count() == 40 and back.edges.count() == 80 - 40 + 40


def test_artifact_edges_are_not_shuffled(spark, tmp_path):
    """links of a manifest are told apart where it is read; repeated ones, in a file or in several of a folder, count once."""
    child_map = {"a": ["b", "c"], "b": ["c", "c", None], "c": []}
    _project_folder(tmp_path / "one", {"nodes": {}, "child_map": child_map})
    _project_folder(tmp_path / "two", '{"child_map": {"a": ["b"], "d": ["e"], "a": ["b", "c"]}}')
    tables = load_artifact_tables(spark, f"{tmp_path}/*/manifest.json", None, "current")
    plan = tables.edges._jdf.queryExecution().executedPlan().toString()
    found = lambda df: sorted((r["artifact"].rpartition("/")[2], r["parent_id"], r["child_id"] or "") for r in df.collect())
    first = [("one", "a", "b"), ("one", "a", "c"), ("one", "b", ""), ("one", "b", "c")]
    assert [x for x in found(tables.edges) if x[0] == "one"] == first
    two = [x for x in found(tables.edges) if x[0] == "two"]
    assert len(two) == len(set(two)) and {("two", "a", "c"), ("two", "d", "e")} <= set(two)
    # What may be repeated is shuffled, the rest is not.
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange ") == 1 and "Union" in plan
    (tmp_path / "one" / "manifest_more.json").write_text(json.dumps({"child_map": {"a": ["b", "z"]}}))
    both = load_artifact_tables(spark, f"{tmp_path}/one/manifest*.json", None, "current").edges
    assert found(both) == sorted([*first, ("one", "a", "z")])


@pytest.mark.parametrize("hashed", [True, False])
def test_radius_edges_are_made_once(spark, tmp_path, monkeypatch, hashed):
    """closures and kept edges read the stored edges, which are looked up at either end and not sorted; equal ones count once."""
    monkeypatch.setattr(L, "HASHED_IDS", 1_000_000 if hashed else 0)
    rows = [("a", None, "b", None), ("a", None, "b", None), ("b", None, "c", None), ("a", "k", "b", "k"), ("a", "k", "b", None), ("x", None, "y", None), ("x", None, "c", None)]
    spark.createDataFrame(rows, "parent_node string, parent_column string, child_node string, child_column string").write.parquet(f"{tmp_path}/links")
    nodes = spark.createDataFrame([("current", n) for n in "abcxy"], "env string, node_id string")
    columns = spark.createDataFrame([("current", "a", "k"), ("current", "b", "k")], "env string, node_id string, column_name string")
    changes = spark.createDataFrame([("b", "modified", "breaking"), ("a", "modified", "non_breaking")], "node_id string, change_status string, category string")
    of_columns = spark.createDataFrame([("a", "k", "modified")], "node_id string, column_name string, change_status string")
    edges = L.impact_radius_graph(nodes, columns, spark.read.parquet(f"{tmp_path}/links"), changes, of_columns).edges
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert f"{tmp_path}/links" not in plan and ("ShuffledHashJoin" in plan) == hashed
    # Two shuffles of the edges and two of the marks; equal edges are together then.
    assert plan.count("Exchange hashpartitioning") == 4
    found = sorted((r["parent_node"], r["parent_column"] or "", r["child_node"], r["child_column"] or "", r["on_path"]) for r in edges.collect())
    assert found == [("a", "", "b", "", True), ("a", "k", "b", "", True), ("a", "k", "b", "k", True), ("b", "", "c", "", True)]


def test_column_edges_of_the_workload_are_made_by_child(spark):
    """lines are shuffled as narrow rows by the child, not the texts made of them; the same edges come out."""
    from workload.tables import derived

    folder = "/root/testdata/sf0.001"
    (edges,), (plain,) = derived(spark, folder, "col_edges_t", by_child=True), derived(spark, folder, "col_edges_t")
    # No distinct takes a shuffle of its own.
    assert edges._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
    assert edges.count() == plain.count() and edges.exceptAll(plain).isEmpty()


def test_artifact_tests_are_found_in_the_row_of_the_node(spark, tmp_path):
    """no test is joined or grouped on its own; several names of a node and columns of several catalogs give a test once."""
    node = lambda name: {"name": name, "resource_type": "model"}
    child_map = {"model.p.a": ["test.p.unique_a_k.1", "test.p.unique_a_b_k.2", "test.p.not_null_a_K.3", "test.p.unique_a_ghost.4", "model.p.unique_a_k", "test.p"], "model.p.c": ["test.p.unique_c_x.1"]}
    manifest = {"nodes": {"model.p.a": node("a"), "model.p.c": node("c")}, "sources": {"model.p.a": node("a_b")}, "child_map": child_map}
    _project_folder(tmp_path / "now" / "one", manifest, {"nodes": {"model.p.a": {"columns": {"k": {"type": "int"}, "b_k": {"type": "int"}}}}})
    for old in ("old", "older"):
        _project_folder(tmp_path / old / "one", {}, {"nodes": {"model.p.c": {"columns": {"x": {"type": "int"}}}, "model.p.a": {"columns": {"z": {"type": "int"}}}}})
    tables = load_artifact_tables(spark, f"{tmp_path}/now/*/manifest.json", f"{tmp_path}/now/*/catalog.json", "current", f"{tmp_path}/old*/*/catalog.json")
    plan = tables.node_tests._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[artifact#" not in plan.replace("ObjectHashAggregate(keys=[artifact#", "") and plan.count("Generate inline") <= 3
    found = sorted((r["node_id"], r["column_name"], r["test_name"], r["test_type"]) for r in tables.node_tests.collect())
    assert found == [
        ("model.p.a", "b_k", "test.p.unique_a_b_k.2", "unique"), ("model.p.a", "k", "test.p.not_null_a_K.3", "not_null"), ("model.p.a", "k", "test.p.unique_a_b_k.2", "unique"),
        ("model.p.a", "k", "test.p.unique_a_k.1", "unique"), ("model.p.c", "x", "test.p.unique_c_x.1", "unique"),
    ]
    assert sorted((r["node_id"], r["column_name"]) for r in tables.columns.collect()) == [("model.p.a", "b_k")] * 2 + [("model.p.a", "k")] * 2 + [("model.p.c", "x")] * 2
