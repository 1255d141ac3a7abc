"""Comparison of table schemas, for two frames or for column tables of many nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sidewise.functions.columns import merge_columns, table_columns
from sidewise.operators.lineage import of_env
from sidewise.plans.limits import Limited, first
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import by_rows, cut, spread

NON_RELATION_TYPES = ("exposure", "metric", "semantic_model", "saved_query")


def schema_diff_frames(base: DataFrame, current: DataFrame) -> DataFrame:
    """Both schemas side by side: ``column_name, base_index, current_index, base_type, current_type, reordered, change_status``."""
    sides = [dict((n, (i, t)) for i, (n, t) in enumerate(table_columns(df), 1)) for df in (base, current)]
    rows = []
    for name, status in merge_columns(base.columns, current.columns):
        (base_index, base_type), (current_index, current_type) = (s.get(name, (None, None)) for s in sides)
        change = "added" if base_index is None else "removed" if current_index is None else None
        if change is None and base_type != current_type:
            change = "modified"
        rows.append((name, base_index, current_index, base_type, current_type, status == "reordered", change))
    return base.sparkSession.createDataFrame(
        rows,
        "column_name string, base_index int, current_index int, base_type string, current_type string, "
        "reordered boolean, change_status string",
    )


def column_pairs(columns: DataFrame, marks: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """``node_id, column_name`` with ordinal and type on both sides; ordinals are NULL where the column is missing.

    The columns are read once and shuffled once, by node; a node's columns are as many as its table is wide. ``marks`` holds
    ``node_id, column_name`` and further columns: listed columns get the largest value of each, from the same grouping.
    ``stored`` rows are read as they are.
    """
    rows = columns.select("env", "node_id", "column_name", "ordinal", "data_type", F.lit(True).alias("__listed"))
    extra = []
    if marks is not None:
        extra = [c for c in marks.columns if c not in ("node_id", "column_name")]
        rows = rows.unionByName(marks.filter("node_id is not null and column_name is not null"), allowMissingColumns=True)
    picked = [
        F.max(F.when(of_env(side), F.struct("ordinal", "data_type"))).alias(side) for side in (BASE, CURRENT)
    ]
    return (
        (by_rows if stored else spread)(rows, "node_id")
        .groupBy("node_id", "column_name")
        .agg(*picked, *[F.max(c).alias(c) for c in extra], F.bool_or("__listed").alias("__listed"))
        .filter("__listed")
        .select(
            "node_id",
            "column_name",
            F.col("base.ordinal").alias("base_index"),
            F.col("current.ordinal").alias("current_index"),
            F.col("base.data_type").alias("base_type"),
            F.col("current.data_type").alias("current_type"),
            *extra,
        )
    )


def schema_diff(columns: DataFrame) -> DataFrame:
    """``node_id, column_name, change_status`` over the nodes whose columns are known on both sides."""
    node = Window.partitionBy("node_id")
    known = [F.bool_or(F.col(f"{side}_type").isNotNull() | F.col(f"{side}_index").isNotNull()).over(node) for side in ("base", "current")]
    return (
        column_pairs(columns)
        .withColumn("comparable", known[0] & known[1])
        .filter("comparable")
        .select("node_id", "column_name", _presence_or_type().alias("change_status"))
        .filter(F.col("change_status").isNotNull())
    )


def schema_diff_report(columns: DataFrame, limit: int | None) -> Limited:
    """The first ``limit`` schema changes by node and column, their total, and whether there are more."""
    return first(schema_diff(columns), [F.col("node_id"), F.col("column_name")], limit)


def schema_diff_ordered(columns: DataFrame, marks: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Every column of every node with both positions and types, ``reordered`` and ``change_status``.

    Both sides' lists are merged, base order first, with current columns pulled ahead of the base column they precede;
    a column of base is reordered when one further on in base comes before it in that list. The windows run per node
    over its list of columns. ``marks`` and ``stored`` are as in ``column_pairs``.
    """
    pairs = column_pairs(columns, marks, stored)
    of_node = Window.partitionBy("node_id")
    later_in_current = of_node.orderBy("current_index").rowsBetween(1, Window.unboundedFollowing)
    puller = F.when(
        F.col("current_index").isNotNull() & F.col("base_index").isNotNull(),
        F.min(F.when(F.col("current_index").isNotNull(), F.col("base_index"))).over(later_in_current),
    )
    pulled = F.coalesce(F.col("puller") < F.col("base_index"), F.lit(False))
    merged_order = of_node.orderBy(
        F.when(pulled, F.col("puller")).otherwise(F.col("base_index")).asc_nulls_last(),
        F.when(pulled, 0).otherwise(1),
        "current_index",
        "column_name",
    ).rowsBetween(Window.unboundedPreceding, -1)
    reordered = F.col("base_index") <= F.max("base_index").over(merged_order)
    return (
        pairs.withColumn("puller", puller)
        .withColumn("reordered", F.coalesce(reordered, F.lit(False)))
        .withColumn("change_status", _presence_or_type())
        .drop("puller")
    )


def schema_changed(columns: DataFrame) -> DataFrame:
    """``node_id, schema_changed``: a different number, order or type of columns; NULL when a side has none."""
    pairs = column_pairs(columns)
    differs = (
        F.col("base_index").isNull()
        | F.col("current_index").isNull()
        | (F.col("base_index") != F.col("current_index"))
        | ~F.col("base_type").eqNullSafe(F.col("current_type"))
    )
    return pairs.groupBy("node_id").agg(
        F.when((F.count("base_index") > 0) & (F.count("current_index") > 0), F.bool_or(differs)).alias("schema_changed")
    )


def unchecked_nodes(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """Nodes of both sides whose columns are unknown on a side although they should have some.

    Nodes and columns meet by node in one shuffle, in as many partitions as their rows ask for.
    """
    current = of_env(CURRENT)
    listed = columns.select("env", "node_id").distinct().select("node_id", F.col("env").alias("listed"))
    rows = nodes.select("env", "node_id", "resource_type", "materialized").unionByName(listed, allowMissingColumns=True)
    both = spread(rows, "node_id").groupBy("node_id").agg(
        F.bool_or(of_env(BASE)).alias("in_base"),
        F.bool_or(current).alias("in_current"),
        F.max(F.when(current, F.col("resource_type"))).alias("resource_type"),
        F.max(F.when(current, F.col("materialized"))).alias("materialized"),
        *[F.coalesce(F.bool_or(F.col("listed") == side), F.lit(False)).alias(f"listed_{side}") for side in (BASE, CURRENT)],
    )
    relation = ~F.coalesce(F.col("resource_type").isin(*NON_RELATION_TYPES), F.lit(False)) & ~F.coalesce(
        F.col("materialized") == "ephemeral", F.lit(False)
    )
    # A node without an id is in no list of columns.
    checked = F.col("listed_base") & F.col("listed_current") & F.col("node_id").isNotNull()
    return both.filter(F.col("in_base") & F.col("in_current") & relation & ~checked).select("node_id")


def schema_coverage(nodes: DataFrame, columns: DataFrame, limit: int) -> DataFrame:
    """One row: ``status`` complete or partial, the first ``limit`` unchecked nodes by id, how many there are, and whether more.

    ``unchecked_nodes`` has all their names.
    """
    # Read for the list and for the count.
    unchecked = cut(unchecked_nodes(nodes, columns), "unchecked")
    listed = unchecked.orderBy("node_id").limit(limit)
    names = listed.agg(F.array_sort(F.collect_list("node_id")).alias("names")).scalar()
    count = F.col("unchecked_node_count")
    return unchecked.agg(F.count(F.lit(1)).alias("unchecked_node_count")).select(
        F.when(count > 0, "partial").otherwise("complete").alias("status"),
        names.alias("unchecked_nodes"),
        "unchecked_node_count",
        (count > limit).alias("more"),
    )


def with_change_flags(rows: DataFrame, column_changes: DataFrame) -> DataFrame:
    """Ordered schema rows with ``definition_changed`` and ``change_unknown``: changes to a column that show nowhere else."""
    declared = column_changes.select("node_id", "column_name", F.col("change_status").alias("__declared"))
    return _flagged(rows.join(declared, ["node_id", "column_name"], "left"))


def _flagged(rows: DataFrame) -> DataFrame:
    silent = F.col("change_status").isNull() & ~F.col("reordered")
    return (
        rows.withColumn("definition_changed", silent & F.coalesce(F.col("__declared") == "modified", F.lit(False)))
        .withColumn("change_unknown", silent & F.coalesce(F.col("__declared") == "unknown", F.lit(False)))
        .drop("__declared")
    )


def column_change_status(impacted: Column) -> Column:
    """Why a column of a flagged schema row differs: added, removed, changed, impacted, unknown or unchanged."""
    type_changed = ~F.col("base_type").eqNullSafe(F.col("current_type"))
    own = F.col("definition_changed") | F.col("reordered")
    inherited = type_changed & ~own & impacted & ~F.col("change_unknown")
    return (
        F.when(F.col("base_index").isNull(), "added")
        .when(F.col("current_index").isNull(), "removed")
        .when(inherited, "impacted")
        .when(type_changed | own, "changed")
        .when(F.col("change_unknown"), "unknown")
        .when(impacted, "impacted")
        .otherwise("unchanged")
    )


def column_change_causes(rows: DataFrame, column_changes: DataFrame, impacted: DataFrame) -> DataFrame:
    """Ordered schema rows with the cause of each column's change in ``cause``."""
    hits = impacted.select("node_id", "column_name", F.lit(True).alias("__hit")).distinct()
    flagged = with_change_flags(rows, column_changes).join(hits, ["node_id", "column_name"], "left")
    return flagged.withColumn("cause", column_change_status(F.coalesce(F.col("__hit"), F.lit(False)))).drop("__hit")


def schema_change_causes(columns: DataFrame, column_changes: DataFrame, impacted: DataFrame, stored: bool = False) -> DataFrame:
    """``column_change_causes`` of the ordered schema rows of ``columns``: changes and hits meet the columns in their one shuffle.

    A change that is given more than once for a column counts once, with its largest status. ``stored`` tables are read as they are.
    """
    declared = column_changes.select("node_id", "column_name", F.col("change_status").alias("__declared"))
    hits = impacted.select("node_id", "column_name", F.lit(True).alias("__hit"))
    rows = _flagged(schema_diff_ordered(columns, declared.unionByName(hits, allowMissingColumns=True), stored))
    return rows.withColumn("cause", column_change_status(F.coalesce(F.col("__hit"), F.lit(False)))).drop("__hit")


def _presence_or_type() -> Column:
    return (
        F.when(F.col("base_index").isNull(), "added")
        .when(F.col("current_index").isNull(), "removed")
        .when(~F.col("base_type").eqNullSafe(F.col("current_type")), "modified")
    )
