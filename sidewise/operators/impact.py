"""Impact analysis: for every model that a change may reach, what the data says."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from sidewise.errors import ComparisonError
from sidewise.functions.columns import common_columns, key_columns
from sidewise.functions.labels import delta_pct_of_base
from sidewise.operators.rowcount import row_count_diff
from sidewise.operators.valuediff import impact_value_diff
from sidewise.plans.keys import key_facts_many
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import cut
from sidewise.sources.environments import OK, EnvPair

# A stable row count moves by at most this percentage, and a change ratio above this share is high.
STABLE_ROW_COUNT_PCT = 5
HIGH_CHANGE_RATIO = 0.2

# Models whose values are compared in one plan.
BATCH_MODELS = 16

# Why a model deserves a closer look, as codes.
SCHEMA_CHANGED = "schema_changed_without_values"
CHANGED_UNCOMPARED = "changed_without_values"
VIEW_DOWNSTREAM = "view_downstream_without_values"
DOWNSTREAM_UNCOMPARED = "downstream_without_values"
VALUES_SHIFTED = "many_values_changed_in_stable_rows"

_VALUES = (
    "name string, error string, rows_added long, rows_removed long, rows_changed long, value_affected long, "
    "value_columns array<struct<column:string,affected_row_count:bigint,base_mean:double,current_mean:double>>"
)


def impact_analysis(
    env: EnvPair,
    models: DataFrame,
    schema_changes: DataFrame,
    primary_keys: Mapping[str, str | Sequence[str]] | None = None,
    skip_value_diff: bool = False,
    skip_downstream_value_diff: bool = False,
    unchecked: DataFrame | None = None,
) -> DataFrame:
    """One row per impacted model: row counts, schema changes, value changes, evidence of impact and what to do next.

    ``models(node_id, name, change_status, materialized, primary_key)`` are the changed models (with their status) and
    those downstream (NULL status); ``schema_changes(node_id, column_name, change_status)``; ``unchecked(node_id)`` names
    models whose schema could not be compared (their schema changes read NULL). A model whose values cannot be compared,
    because a key column is missing or its table cannot be opened, has an ``error`` text and counts as potential; the
    others go on. Models whose name neither environment lists are not even planned for. The others are read as a list to
    plan their comparisons, in batches that are stored one by one; their rows never leave the executors.
    """
    wanted = cut(models.select("node_id", "name", "change_status", "materialized", "primary_key"), "models")
    listed = list(_openable(env, wanted).toLocalIterator())
    keys = {m["name"]: (primary_keys or {}).get(m["name"], m["primary_key"]) for m in listed}
    counted = [m["name"] for m in listed if m["change_status"] != "removed"]
    compared = []
    if not skip_value_diff:
        compared = [
            m["name"]
            for m in listed
            if keys[m["name"]]
            and m["materialized"] != "view"
            and not (skip_downstream_value_diff and m["change_status"] is None)
        ]
    result = wanted.select("node_id", "name", "change_status", "materialized")
    result = result.join(_counts(env, counted), "name", "left") if counted else _without_counts(result)
    result = result.join(_values(env, {name: keys[name] for name in compared}), "name", "left")
    result = result.join(_schema_lists(schema_changes), "node_id", "left")
    gap = F.lit(False)
    if unchecked is not None:
        result = result.join(unchecked.select("node_id", F.lit(True).alias("__gap")).distinct(), "node_id", "left")
        gap = F.coalesce(F.col("__gap"), F.lit(False))
    listed_changes = F.coalesce("listed", F.array().cast("array<struct<column:string,change_status:string>>"))
    result = result.withColumn("schema_changes", F.when(~gap, listed_changes))
    return _judged(result)


def _openable(env: EnvPair, models: DataFrame) -> DataFrame:
    """The models that an environment may open: no more than the environments list, unless they look names up."""
    names = [env.side(side).names() for side in (BASE, CURRENT)]
    if any(known is None for known in names):
        return models
    spark = models.sparkSession
    known = spark.createDataFrame([(name,) for name in sorted({*names[0], *names[1]})], "name string")
    return models.join(F.broadcast(known), "name", "left_semi")


def _counts(env: EnvPair, names: Sequence[str]) -> DataFrame:
    counts = row_count_diff(env, names)
    return counts.select(
        "name",
        F.col("base").alias("base_rows"),
        F.col("curr").alias("current_rows"),
        (F.col("curr") - F.col("base")).alias("delta"),
        delta_pct_of_base(F.col("base"), F.col("curr")).alias("delta_pct"),
    )


def _without_counts(models: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast("long") for n in ("base_rows", "current_rows", "delta")}
    return models.withColumns({**missing, "delta_pct": F.lit(None).cast("double")})


def _values(env: EnvPair, keys: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Value changes of each model present on both sides, or why they are unknown; one row per model."""
    spark = env.base.spark
    pairs, errors = {}, []
    for name, pk in keys.items():
        try:
            sides = [env.side(side).resolve(name) for side in ("base", "current")]
            if all(s.status == OK for s in sides):
                base, current = (s.frame for s in sides)
                names = key_columns(base, pk)
                key_columns(current, pk)
                if set(common_columns(base, current, names)) - set(names):
                    pairs[name] = (base, current, names)
        except (ComparisonError, PySparkException) as error:
            errors.append((name, str(error).splitlines()[0]))
    parts = [spark.createDataFrame(errors, "name string, error string")]
    batches = [list(pairs)[i : i + BATCH_MODELS] for i in range(0, len(pairs), BATCH_MODELS)]
    parts += [cut(_batch({name: pairs[name] for name in batch}), "impact") for batch in batches]
    empty = spark.createDataFrame([], _VALUES)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)


def _batch(pairs: Mapping[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    facts = dict(zip(pairs, key_facts_many(list(pairs.values()))))
    parts = []
    for name, (base, current, names) in pairs.items():
        columns = F.collect_list(
            F.struct("column", F.col("changed").alias("affected_row_count"), "base_mean", "current_mean")
        )
        parts.append(
            impact_value_diff(base, current, names, facts=facts[name])
            .agg(
                *[F.max(c).alias(c) for c in ("rows_added", "rows_removed", "rows_changed")],
                F.max("affected_row_count").alias("value_affected"),
                columns.alias("value_columns"),
            )
            .select(F.lit(name).alias("name"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def _schema_lists(schema_changes: DataFrame) -> DataFrame:
    item = F.struct(F.col("column_name").alias("column"), "change_status")
    return schema_changes.groupBy("node_id").agg(F.array_sort(F.collect_list(item)).alias("listed"))


def _judged(models: DataFrame) -> DataFrame:
    """The evidence (``data_impact``), the affected rows and the suggested next step of each model."""
    impact = (
        F.when(F.col("value_affected").isNull(), "potential")
        .when(F.col("value_affected") > 0, "confirmed")
        .otherwise("none")
    )
    return (
        models.withColumn("data_impact", impact)
        .withColumn("affected_row_count", F.col("value_affected"))
        .withColumn("next_action", _next_action())
        .select(
            "node_id",
            "name",
            "change_status",
            "materialized",
            "base_rows",
            "current_rows",
            "delta",
            "delta_pct",
            "schema_changes",
            "rows_added",
            "rows_removed",
            "rows_changed",
            "value_columns",
            "affected_row_count",
            "data_impact",
            "next_action",
            "error",
        )
    )


def impact_summary(found: DataFrame, all_models: DataFrame) -> DataFrame:
    """One row over an impact analysis: how many of ``all_models(node_id)`` there are, how many are not impacted, confirmed,
    without change, potential and failed, and the largest number of affected rows."""
    impact = F.col("data_impact")
    totals = found.agg(
        F.count(F.lit(1)).alias("impacted_models"),
        *[F.count_if(impact == kind).alias(kind) for kind in ("confirmed", "none", "potential")],
        F.count("error").alias("failed"),
        F.max("affected_row_count").alias("largest_affected_row_count"),
    )
    others = unaffected_models(found, all_models).agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.withColumn("not_impacted_models", others)


def unaffected_models(found: DataFrame, all_models: DataFrame) -> DataFrame:
    """The models of ``all_models(node_id)`` that the analysis does not list."""
    return all_models.select("node_id").distinct().join(found.select("node_id"), "node_id", "left_anti")


def _next_action() -> Column:
    own = F.coalesce(F.col("change_status").isin("modified", "added"), F.lit(False))
    downstream = F.col("change_status").isNull()
    potential = F.col("data_impact") == "potential"
    schema_moved = F.size(F.coalesce("schema_changes", F.array())) > 0
    schema_columns = F.transform("schema_changes", lambda c: c["column"])
    touched = F.filter("value_columns", lambda c: c["affected_row_count"] > 0)
    touched = F.transform(touched, lambda c: c["column"])
    matched = F.coalesce("current_rows", F.lit(0)) - F.col("rows_added")
    stable = F.coalesce(F.abs("delta_pct") <= STABLE_ROW_COUNT_PCT, F.lit(False))
    high_ratio = (matched > 0) & (F.try_divide(F.col("rows_changed").cast("double"), matched) > HIGH_CHANGE_RATIO)
    none = F.lit(None).cast("array<string>")

    def action(columns: Column, reason: str, priority: Column) -> Column:
        return F.struct(
            F.lit("profile_diff").alias("tool"),
            columns.alias("columns"),
            F.lit(reason).alias("reason"),
            priority.alias("priority"),
        )

    return (
        F.when(
            potential & schema_moved,
            action(
                schema_columns,
                SCHEMA_CHANGED,
                F.when(own, F.lit("high")).otherwise(F.lit("medium")),
            ),
        )
        .when(
            potential & own,
            action(none, CHANGED_UNCOMPARED, F.lit("high")),
        )
        .when(
            potential & downstream & (F.col("materialized") == "view"),
            action(none, VIEW_DOWNSTREAM, F.lit("low")),
        )
        .when(potential & downstream, action(none, DOWNSTREAM_UNCOMPARED, F.lit("medium")))
        .when(
            (F.col("data_impact") == "confirmed") & stable & F.coalesce(high_ratio, F.lit(False)),
            action(
                F.when(F.size(touched) > 0, touched),
                VALUES_SHIFTED,
                F.lit("medium"),
            ),
        )
    )
