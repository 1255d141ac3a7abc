"""Verdicts over comparison results, and the tables that log runs and checks.

``runs(run_id, check_id, type, run_at, status, error, params map<string,string>, changed)``;
``checks(check_id, name, type, params, view_options, is_checked, is_preset, updated_at, ...)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col

CANCELLED = "cancelled"


def _differs(left: str, right: str) -> Column:
    return ~F.col(left).eqNullSafe(F.col(right))


# For each kind of comparison, when one row of its result counts as a change.
CHANGE_RULES = {
    "row_count_diff": lambda: _differs("base", "curr"),
    "value_diff": lambda: (F.col("added") > 0)
    | (F.col("removed") > 0)
    | F.coalesce(F.col("matched_p") < 1.0, F.lit(False)),
    "value_diff_detail": lambda: F.lit(True),
    "query_diff": lambda: F.lit(True),
    "row_diff": lambda: F.col("status").isNotNull(),
    "profile_diff": lambda: F.col("status").isNotNull(),
    "top_k_diff": lambda: _differs("base_count", "curr_count")
    | _differs("base_total", "curr_total")
    | _differs("base_valids", "curr_valids"),
    "histogram_diff": lambda: _differs("base_count", "curr_count") | _differs("base_total", "curr_total"),
    "schema_diff": lambda: F.col("change_status").isNotNull(),
}


def is_changed(diff: DataFrame, kind: str, totals: DataFrame | None = None) -> DataFrame:
    """One row, ``is_changed``: whether a comparison found any difference.

    A top-k or histogram result may have no rows (no category, no finite value) although its sides differ in their rows;
    ``totals``, the result of ``column_totals`` or ``column_bounds``, then decides as well.
    """
    verdict = diff.agg(F.coalesce(F.bool_or(_rule(kind)), F.lit(False)).alias("is_changed"))
    if totals is None:
        return verdict
    if "side" in totals.columns:
        differ = totals.agg((F.count_distinct(F.struct("total", "valids")) > 1).alias("is_changed"))
    else:
        differ = totals.select(_differs("base_total", "curr_total").alias("is_changed"))
    return verdict.unionByName(differ).agg(F.bool_or("is_changed").alias("is_changed"))


def changed_nodes(diff: DataFrame, kind: str, node: str = "name") -> DataFrame:
    """The nodes of a comparison of many nodes that changed."""
    return diff.filter(_rule(kind)).select(col(node)).distinct()


def passes(diff: DataFrame, kind: str) -> DataFrame:
    """One row, ``passes``: a row-count gate wants both counts and equal ones, a schema gate no difference; others never pass."""
    if kind == "row_count_diff":
        good = F.coalesce(F.col("base") == F.col("curr"), F.lit(False))
    elif kind == "schema_diff":
        good = ~_rule(kind)
    else:
        good = F.lit(False)
        return diff.agg(F.coalesce(F.bool_and(good), good).alias("passes"))
    return diff.agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("passes"))


def _rule(kind: str) -> Column:
    if kind not in CHANGE_RULES:
        raise ComparisonError(f"Unknown kind of comparison {kind!r}; one of {sorted(CHANGE_RULES)}")
    return CHANGE_RULES[kind]()


def content_hash() -> Column:
    """Identity of what a check does, whatever its id."""
    return F.sha2(F.to_json(F.struct("type", "params", "view_options")), 256)


def upsert_latest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Checks after an import: the newer of two versions wins, an existing one on a tie, and keeps the existing id.

    Versions belong together by id, else, for presets, by content. What neither side matches is kept as it is.
    """
    fixed = [c for c in ("created_at", "created_by") if c in existing.columns]
    known = existing.select(F.col("check_id").alias("__known"))
    presets = (
        existing.filter("is_preset")
        .groupBy(content_hash().alias("__hash"))
        .agg(F.max("check_id").alias("__preset"))
    )
    # Only presets have a content to match by; leaving the others out keeps them from meeting in one NULL key.
    is_preset = F.coalesce("is_preset", F.lit(False))
    by_content = incoming.filter(is_preset).withColumn("__hash", content_hash()).join(presets, "__hash", "left")
    by_id_only = incoming.filter(~is_preset).withColumn("__preset", F.lit(None).cast("string"))
    targeted = (
        by_content.drop("__hash")
        .unionByName(by_id_only)
        .join(known, F.col("check_id") == F.col("__known"), "left")
        .withColumn("__target", F.coalesce("__known", "__preset", "check_id"))
        .select(*[col(c) for c in existing.columns], "__target", F.lit(0).alias("__old"))
    )
    rows = existing.select("*", F.col("check_id").alias("__target"), F.lit(1).alias("__old")).unionByName(targeted)
    whole = F.struct(*[col(c) for c in existing.columns])
    recency = F.struct("updated_at", "__old", "check_id")
    picked = rows.groupBy("__target").agg(
        F.max_by(whole, recency).alias("newest"),
        F.max_by(whole, F.struct("__old", "updated_at")).alias("first"),
    )
    return picked.select(
        *[
            F.col("__target").alias(c) if c == "check_id" else F.col(f"{'first' if c in fixed else 'newest'}.{c}").alias(c)
            for c in existing.columns
        ]
    )


def merge_runs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All runs of both tables, one per id; an existing run wins. Order the result by ``run_at`` to list it."""
    new = incoming.join(existing.select("run_id"), "run_id", "left_anti").select(*[col(c) for c in existing.columns])
    whole = F.struct(*[col(c) for c in existing.columns])
    once = new.groupBy("run_id").agg(F.min_by(whole, F.col("run_at")).alias("r")).select("r.*")
    return existing.unionByName(once)


def latest_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest run of each key; among runs of the same time, the one with the highest id."""
    whole = F.struct(*[col(c) for c in runs.columns])
    newest = F.max_by(whole, F.struct("run_at", "run_id"))
    return runs.groupBy(*[col(k) for k in keys]).agg(newest.alias("r")).select("r.*")


def latest_results(results: DataFrame) -> DataFrame:
    """Newest result per node and run type; cancelled runs and runs without result are passed over.

    ``results(run_id, run_at, type, status, node_id, result)`` holds one row per run and node.
    """
    usable = results.filter(F.col("result").isNotNull() & ~F.col("status").eqNullSafe(F.lit(CANCELLED)))
    return latest_runs(usable, "node_id", "type")


def check_stats(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: ``total, approved, mismatched, failed`` checks, judged by the newest run of each."""
    latest = latest_runs(runs.filter(F.col("check_id").isNotNull()), "check_id")
    verdicts = latest.select(
        "check_id", F.col("error").isNotNull().alias("failed"), F.coalesce("changed", F.lit(False)).alias("changed")
    )
    joined = checks.join(verdicts, "check_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_checked").alias("approved"),
        F.count_if(F.col("changed") & ~F.col("failed")).alias("mismatched"),
        F.count_if("failed").alias("failed"),
    )


def search_runs(runs: DataFrame, run_type: str, params: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Runs of one type whose parameters include the given ones; with ``limit``, the newest ones, newest first."""
    found = runs.filter(F.col("type") == run_type)
    for name, value in (params or {}).items():
        found = found.filter(F.col("params")[name] == value)
    return found if limit is None else newest_first(found).limit(limit)


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_at").desc(), F.col("run_id").desc())


def what_changed(changes: DataFrame, counts: DataFrame, schema_changes: DataFrame) -> DataFrame:
    """``node_id, what``: words for each node that differs: Added Node, Removed Node, or Code, Row Count and Schema.

    ``changes(node_id, change_status)``, ``counts(node_id, base, curr)``, ``schema_changes(node_id, ...)``. The row
    count is given in percent of current.
    """
    schema = schema_changes.select("node_id", F.lit(True).alias("schema_changed")).distinct()
    base, current = F.col("base"), F.col("curr")
    percent = F.try_divide(F.abs(current - base).cast("double"), current.cast("double")) * 100
    size = F.when(percent > 0.1, F.round(percent, 2).cast("string")).otherwise("<0.1")
    moved = F.when(
        (current != 0) & (base != current),
        F.concat(F.lit("Row Count "), F.when(current > base, "+").otherwise("-"), size, F.lit("%")),
    )
    labels = F.array(
        F.when(F.col("change_status") == "modified", "Code"), moved, F.when(F.col("schema_changed"), "Schema")
    )
    what = (
        F.when(F.col("change_status") == "added", F.array(F.lit("Added Node")))
        .when(F.col("change_status") == "removed", F.array(F.lit("Removed Node")))
        .otherwise(F.array_compact(labels))
    )
    return (
        changes.select("node_id", "change_status")
        .join(counts.select("node_id", "base", "curr"), "node_id", "full_outer")
        .join(schema, "node_id", "full_outer")
        .select("node_id", what.alias("what"))
        .filter(F.size("what") > 0)
    )
