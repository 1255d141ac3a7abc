"""Comparison of lineage and propagation of changes along it.

Tables: ``nodes(env, node_id, name, resource_type, package_name, schema_name, materialized, tags, checksum,
primary_key)``, ``edges(env, parent_id, child_id)``, ``columns(env, node_id, column_name, ordinal, data_type)``,
``node_tests(env, node_id, column_name, test_name, test_type)``, and
``col_edges(parent_node, parent_column, child_node, child_column)``, where a NULL column stands for the node itself.
Changes: ``node_changes(node_id, change_status, category)`` and ``column_changes(node_id, column_name, change_status)``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.functions.columns import col
from sidewise.functions.labels import normalize_category
from sidewise.plans.closure import CHILD, DEGREE, DOWN, PARENT, UP, VERTEX, closure, closures
from sidewise.plans.limits import Limited, first
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import cut

# Categories whose changes reach every reader of a node, with and without column lineage.
PROPAGATING = ("breaking", "unknown")
PROPAGATING_NODE_ONLY = ("breaking", "partial_breaking", "unknown")
# Ids to a partition that are looked up by hash, about 100 MB; more are joined by sorting.
HASHED_IDS = 1_000_000


def of_env(side: str) -> Column:
    return F.col("env") == side


def _change() -> tuple[list[Column], Column]:
    """Aggregates of a node's rows, and its change from them."""
    sums = {side: F.max(F.when(of_env(side), F.col("checksum"))).alias(f"__{side}_sum") for side in (BASE, CURRENT)}
    status = (
        F.when(~F.col("__in_base"), "added")
        .when(~F.col("__in_current"), "removed")
        .when(~F.coalesce(F.col("__base_sum") == F.col("__current_sum"), F.lit(False)), "modified")
    )
    return [*[F.bool_or(of_env(side)).alias(f"__in_{side}") for side in sums], *sums.values()], status.alias("change_status")


def lineage_diff(nodes: DataFrame) -> DataFrame:
    """``node_id, change_status``: added, removed, or modified when the checksums differ or one is missing.

    An id that a side holds more than once counts once, with its largest checksum.
    """
    facts, status = _change()
    return nodes.groupBy("node_id").agg(*facts).select("node_id", status).filter(F.col("change_status").isNotNull())


def merged_nodes(nodes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per node of either side with current's attributes preferred, ``base_schema`` where it differs, and the change.

    Of an id that a side holds more than once, each attribute has its largest value. Without ``changes``, the change is taken
    from the same grouping.
    """
    attributes = [c for c in nodes.columns if c not in ("env", "node_id")]
    facts, status = _change()
    in_current = F.bool_or(of_env(CURRENT))
    # A node has few rows, on different sides: they meet before they are grouped, so that they are sorted once.
    merged = nodes.repartition("node_id").groupBy("node_id").agg(
        *[F.when(in_current, F.max(F.when(of_env(CURRENT), col(c)))).otherwise(F.max(col(c))).alias(c) for c in attributes],
        F.max(F.when(of_env(BASE), F.col("schema_name"))).alias("__base_schema"),
        *facts,
    )
    differs = F.col("__in_current") & (F.col("__base_schema") != F.coalesce(F.col("schema_name"), F.lit("")))
    wanted = ["node_id", *[col(c) for c in attributes], F.when(differs, F.col("__base_schema")).alias("base_schema")]
    if changes is None:
        return merged.select(*wanted, status)
    return merged.select(*wanted).join(changes, "node_id", "left")


def merged_edges(edges: DataFrame, nodes: DataFrame, by_child: bool = False) -> DataFrame:
    """``parent_id, child_id, change_status`` of the edges of either side between known nodes.

    ``by_child`` tells that ``edges`` are already partitioned by ``child_id``, so that they are not shuffled for it again.
    """
    known = cut(nodes.select(F.col("node_id").alias("__known")).distinct(), "known-nodes")
    partitions = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if known.count() <= HASHED_IDS * partitions:
        # Ids are short and each is there once: looked up by hash, the edges need not be sorted.
        known = known.hint("shuffle_hash")
    sides = edges.select("parent_id", "child_id", of_env(BASE).alias("__base"), of_env(CURRENT).alias("__current"))
    # An edge has few rows: they meet before they are grouped, by the child alone, where the child is looked up too.
    return (
        (sides if by_child else sides.repartition("child_id"))
        .groupBy("parent_id", "child_id")
        .agg(F.bool_or("__base").alias("in_base"), F.bool_or("__current").alias("in_current"))
        .select(
            "parent_id",
            "child_id",
            F.when(~F.col("in_base"), "added").when(~F.col("in_current"), "removed").alias("change_status"),
        )
        .join(known, F.col("child_id") == F.col("__known"), "left_semi")
        .join(known, F.col("parent_id") == F.col("__known"), "left_semi")
    )


def node_edges(edges: DataFrame) -> DataFrame:
    """Edges in the form the closure reads."""
    return edges.select(F.col("parent_id").alias(PARENT), F.col("child_id").alias(CHILD))


def upstream(edges: DataFrame, seeds: DataFrame, max_degree: int | None = None, stored: bool = False) -> DataFrame:
    """``node_id, degree`` of the seeds and their ancestors; ``seeds`` holds ``node_id``; ``stored`` edges are read as they are."""
    return _walk(edges, seeds, UP, max_degree, stored)


def downstream(edges: DataFrame, seeds: DataFrame, max_degree: int | None = None, stored: bool = False) -> DataFrame:
    """``node_id, degree`` of the seeds and their descendants; ``seeds`` holds ``node_id``; ``stored`` edges are read as they are."""
    return _walk(edges, seeds, DOWN, max_degree, stored)


def _walk(edges: DataFrame, seeds: DataFrame, direction: str, max_degree: int | None, stored: bool) -> DataFrame:
    found = closure(node_edges(edges), seeds.select(F.col("node_id").alias(VERTEX)), direction, max_degree, stored)
    return found.select(F.col(VERTEX).alias("node_id"), DEGREE)


def vertex(node: str = "node_id", column: str | None = "column_name") -> Column:
    """Identity of a node (no column) or of one of its columns."""
    name = F.lit(None).cast("string") if column is None else F.col(column)
    return F.struct(F.col(node).alias("node_id"), name.alias("column_name"))


def mixed_edges(col_edges: DataFrame) -> DataFrame:
    """Edges between nodes and columns in the form the closure reads."""
    return col_edges.select(
        vertex("parent_node", "parent_column").alias(PARENT), vertex("child_node", "child_column").alias(CHILD)
    )


def column_lineage(col_edges: DataFrame, node_id: str, column_name: str) -> DataFrame:
    """``node_id, column_name, direction, degree`` of all columns one column is made of or flows into, and itself."""
    start = col_edges.sparkSession.range(1).select(
        F.struct(F.lit(node_id).alias("node_id"), F.lit(column_name).alias("column_name")).alias(VERTEX)
    )
    above, below = closures(mixed_edges(col_edges), start, [UP, DOWN])
    above = above.withColumn("direction", F.lit(UP))
    below = below.filter(F.col(DEGREE) > 0).withColumn("direction", F.lit(DOWN))
    rows = above.unionByName(below).select(f"{VERTEX}.*", "direction", DEGREE)
    return rows.filter(F.col("column_name").isNotNull()).withColumn(
        "direction", F.when(F.col(DEGREE) == 0, "self").otherwise(F.col("direction"))
    )


def impacted_columns(col_edges: DataFrame, column_changes: DataFrame) -> DataFrame:
    """``node_id, column_name`` of the changed columns and of all columns derived from them."""
    seeds = column_changes.filter(F.col("change_status").isNotNull()).select(vertex().alias(VERTEX))
    reached = closure(mixed_edges(col_edges), seeds, DOWN).select(f"{VERTEX}.*")
    return reached.filter(F.col("column_name").isNotNull())


def whole_model_impact(edges: DataFrame, node_changes: DataFrame) -> DataFrame:
    """``node_id, is_changed``: nodes with a breaking change, flagged, and everything downstream of one."""
    roots = node_changes.filter(normalize_category(F.col("category")) == "breaking").select("node_id").distinct()
    reached = downstream(edges, roots)
    return reached.select("node_id", (F.col(DEGREE) == 0).alias("is_changed"))


def impact_anchors(
    columns: DataFrame, node_changes: DataFrame, column_changes: DataFrame, node_only: bool = False
) -> DataFrame:
    """``vertex``: where impact starts: added nodes with their columns, modified nodes whose change propagates, changed columns."""
    added = node_changes.filter(F.col("change_status") == "added").select("node_id")
    current = columns.filter(of_env(CURRENT)) if "env" in columns.columns else columns
    category = normalize_category(F.col("category"))
    modified = node_changes.filter(F.col("change_status") == "modified")
    propagating = modified.filter(category.isin(*(PROPAGATING_NODE_ONLY if node_only else PROPAGATING)))
    classified = modified.filter(F.col("category").isNotNull()).select("node_id")
    parts = [
        added.select(vertex(column=None).alias(VERTEX)),
        current.join(added, "node_id", "left_semi").select(vertex().alias(VERTEX)),
        propagating.select(vertex(column=None).alias(VERTEX)),
        column_changes.join(classified, "node_id", "left_semi").select(vertex().alias(VERTEX)),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


class Radius(NamedTuple):
    """``vertices``: ``node_id, column_name, impacted``. ``edges``: ``parent_node, parent_column, child_node, child_column,
    on_path``, a NULL column standing for the node itself."""

    vertices: DataFrame
    edges: DataFrame


def radius_anchors(
    columns: DataFrame,
    node_id: str,
    column_name: str | None = None,
    node_changes: DataFrame | None = None,
    column_changes: DataFrame | None = None,
    node_only: bool = False,
) -> DataFrame:
    """``vertex``: where the radius of one node or column starts.

    A column starts at itself and a node at itself and its columns. With ``node_changes``, a node whose change is classified
    starts where that change does: at itself if its change propagates, and at its changed columns; any other node at itself.
    """
    spark = columns.sparkSession
    if column_name is not None:
        one = spark.range(1).select(F.lit(node_id).alias("node_id"), F.lit(column_name).alias("column_name"))
        return one.select(vertex().alias(VERTEX))
    itself = spark.range(1).select(F.lit(node_id).alias("node_id"))
    own = lambda df: df.filter(F.col("node_id") == node_id)
    if node_changes is None:
        if node_only:
            return itself.select(vertex(column=None).alias(VERTEX))
        current = columns.filter(of_env(CURRENT)) if "env" in columns.columns else columns
        return itself.select(vertex(column=None).alias(VERTEX)).unionByName(own(current).select(vertex().alias(VERTEX))).distinct()
    classified = own(node_changes).filter((F.col("change_status") == "modified") & F.col("category").isNotNull())
    category = normalize_category(F.col("category"))
    spreading = classified.filter(category.isin(*(PROPAGATING_NODE_ONLY if node_only else PROPAGATING)))
    parts = [
        itself.join(classified.select("node_id"), "node_id", "left_anti").select(vertex(column=None).alias(VERTEX)),
        spreading.select(vertex(column=None).alias(VERTEX)),
    ]
    if column_changes is not None:
        changed = own(column_changes).join(classified.select("node_id"), "node_id", "left_semi")
        parts.append(changed.select(vertex().alias(VERTEX)))
    return reduce(DataFrame.unionByName, parts).distinct()


def radius_of(
    nodes: DataFrame,
    columns: DataFrame,
    col_edges: DataFrame,
    node_id: str,
    column_name: str | None = None,
    node_changes: DataFrame | None = None,
    column_changes: DataFrame | None = None,
    up: bool = True,
    down: bool = True,
    node_only: bool = False,
) -> Radius:
    """What one node or column is made of and flows into: vertices within reach of its anchors, and the edges among them.

    The chosen node stays in the result when its own change is classified, even if the change does not start at it.
    ``impacted`` tells whether a node is within reach; it is NULL without ``node_changes``.
    """
    anchors = radius_anchors(columns, node_id, column_name, node_changes, column_changes, node_only)
    edges = _stored_edges(col_edges, node_only)
    above, below = _reach(edges, anchors, up, down)
    kept = nodes.filter(F.lit(False))
    if node_changes is not None and column_name is None:
        kept = node_changes.filter(
            (F.col("node_id") == node_id) & (F.col("change_status") == "modified") & F.col("category").isNotNull()
        )
    reached = above.unionByName(below).select(f"{VERTEX}.*").distinct()
    vertices = _kept_vertices(nodes, columns, reached, kept.select("node_id"), node_only)
    if node_changes is None:
        vertices = vertices.withColumn("impacted", F.lit(None).cast("boolean"))
    return Radius(vertices, kept_edges(edges, above, below))


def kept_edges(col_edges: DataFrame, above: DataFrame, below: DataFrame) -> DataFrame:
    """The edges between reached vertices: ``parent_node, parent_column, child_node, child_column, on_path``.

    ``above`` and ``below`` hold ``vertex``: what leads to the anchors and what they lead to, the anchors in both. An edge lies on
    a path from or to an anchor if both its ends are above or both below; any other one links a vertex above with one below.
    """
    sides = above.select(VERTEX, F.lit(True).alias("a")).unionByName(below.select(VERTEX, F.lit(False).alias("a")))
    marks = cut(sides.groupBy(VERTEX).agg(F.bool_or("a").alias("above"), F.bool_or(~F.col("a")).alias("below")), "marks")
    hashed = marks.count() <= HASHED_IDS * int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = mixed_edges(col_edges)
    # Children first: most edges are dropped there, as parents are fewer and more of them are reached.
    for end in (CHILD, PARENT):
        ends = marks.select(F.col(VERTEX).alias(f"__{end}"), F.col("above").alias(f"{end}_above"), F.col("below").alias(f"{end}_below"))
        found = found.join(ends.hint("shuffle_hash") if hashed else ends, F.col(end) == F.col(f"__{end}"))
    # Equal edges are together by then.
    found = found.select(PARENT, CHILD, "parent_above", "child_above", "parent_below", "child_below").distinct()
    on_path = (F.col("parent_above") & F.col("child_above")) | (F.col("parent_below") & F.col("child_below"))
    return found.select(
        F.col(f"{PARENT}.node_id").alias("parent_node"), F.col(f"{PARENT}.column_name").alias("parent_column"),
        F.col(f"{CHILD}.node_id").alias("child_node"), F.col(f"{CHILD}.column_name").alias("child_column"), on_path.alias("on_path"),
    )


def _between_nodes(col_edges: DataFrame) -> DataFrame:
    return col_edges.filter(F.col("parent_column").isNull() & F.col("child_column").isNull())


def _stored_edges(col_edges: DataFrame, node_only: bool) -> DataFrame:
    """The edges that count, stored, as they are read for every level of the closures and again for what is kept."""
    edges = _between_nodes(col_edges) if node_only else col_edges
    return cut(edges.select("parent_node", "parent_column", "child_node", "child_column"), "edges")


def _reach(stored: DataFrame, anchors: DataFrame, up: bool, down: bool) -> tuple[DataFrame, DataFrame]:
    """``vertex`` above and below the anchors, with the anchors themselves; one of a direction left out holds them alone."""
    wanted = [way for way, on in ((UP, up), (DOWN, down)) if on]
    found = dict(zip(wanted, closures(mixed_edges(stored), anchors, wanted, stored=True) if wanted else ()))
    start = anchors.select(VERTEX).distinct()
    return tuple(found[way].select(VERTEX) if way in found else start for way in (UP, DOWN))


def impact_radius(
    nodes: DataFrame,
    columns: DataFrame,
    col_edges: DataFrame,
    node_changes: DataFrame,
    column_changes: DataFrame,
    up: bool = True,
    down: bool = True,
    node_only: bool = False,
) -> DataFrame:
    """``node_id, column_name, impacted``: nodes (NULL column) and columns within reach of the changes.

    Removed and classified modified nodes are kept even when not reached, with ``impacted`` false. With ``node_only``
    only edges between nodes count.
    """
    return impact_radius_graph(nodes, columns, col_edges, node_changes, column_changes, up, down, node_only).vertices


def impact_radius_graph(
    nodes: DataFrame,
    columns: DataFrame,
    col_edges: DataFrame,
    node_changes: DataFrame,
    column_changes: DataFrame,
    up: bool = True,
    down: bool = True,
    node_only: bool = False,
) -> Radius:
    """``impact_radius`` with the edges among what is within reach."""
    edges = _stored_edges(col_edges, node_only)
    # Read for each kind of anchor and for the nodes that are kept.
    node_changes = cut(node_changes.select("node_id", "change_status", "category"), "node-changes")
    anchors = impact_anchors(columns, node_changes, column_changes, node_only)
    above, below = _reach(edges, anchors, up, down)
    reached = above.unionByName(below).distinct().select(f"{VERTEX}.*")
    kept = node_changes.filter(
        (F.col("change_status") == "removed")
        | ((F.col("change_status") == "modified") & F.col("category").isNotNull())
    ).select("node_id")
    return Radius(_kept_vertices(nodes, columns, reached, kept, node_only), kept_edges(edges, above, below))


def _kept_vertices(
    nodes: DataFrame, columns: DataFrame, reached: DataFrame, kept: DataFrame, node_only: bool
) -> DataFrame:
    """Known nodes that are reached or in ``kept``, the reached ones ``impacted``, and known columns that are reached."""
    marks = (
        reached.filter(F.col("column_name").isNull())
        .select("node_id", F.lit(True).alias("impacted"))
        .unionByName(kept.select("node_id", F.lit(False).alias("impacted")))
        .groupBy("node_id")
        .agg(F.bool_or("impacted").alias("impacted"))
    )
    known = nodes.select("node_id").distinct()
    node_rows = known.join(marks, "node_id").select(
        "node_id", F.lit(None).cast("string").alias("column_name"), "impacted"
    )
    if node_only:
        return node_rows
    listed = columns.select("node_id", "column_name").distinct()
    hit = reached.filter(F.col("column_name").isNotNull())
    column_rows = listed.join(hit, ["node_id", "column_name"], "left_semi").withColumn("impacted", F.lit(True))
    return node_rows.unionByName(column_rows)


def node_impacted(
    nodes: DataFrame, node_changes: DataFrame, flags: DataFrame, impacted: DataFrame
) -> DataFrame:
    """``node_id, impacted``: changed itself, flagged impacted, or holding an impacted column.

    ``flags`` holds ``node_id, impacted`` and ``impacted`` holds ``node_id, column_name``.
    """
    evidence = [
        node_changes.filter(F.col("change_status").isNotNull()).select("node_id"),
        flags.filter(F.col("impacted")).select("node_id"),
        impacted.select("node_id"),
    ]
    found = reduce(DataFrame.unionByName, evidence).distinct().withColumn("impacted", F.lit(True))
    return (
        nodes.select("node_id")
        .distinct()
        .join(found, "node_id", "left")
        .select("node_id", F.coalesce("impacted", F.lit(False)).alias("impacted"))
    )


def direct_downstream(col_edges: DataFrame, node_id: str) -> DataFrame:
    """``node_id, column_name`` of the nodes (NULL column) and columns fed directly by a node or one of its columns."""
    fed = col_edges.filter((F.col("parent_node") == node_id) & (F.col("child_node") != node_id))
    from_node = fed.filter(F.col("parent_column").isNull() & F.col("child_column").isNull())
    from_columns = fed.filter(F.col("parent_column").isNotNull() & F.col("child_column").isNotNull())
    models = from_node.select("child_node").unionByName(from_columns.select("child_node"))
    rows = models.select("child_node", F.lit(None).cast("string").alias("child_column")).unionByName(
        from_columns.select("child_node", "child_column")
    )
    return rows.distinct().select(F.col("child_node").alias("node_id"), F.col("child_column").alias("column_name"))


def impact_sets(nodes: DataFrame) -> DataFrame:
    """``node_id, impacting, impacted`` from ``node_id, impacted, category, change_status``.

    Partially breaking and removed nodes pass impact on without counting as impacted themselves.
    """
    impacted = F.coalesce(F.col("impacted"), F.lit(False))
    passes_on = (normalize_category(F.col("category")) == "partial_breaking") | (F.col("change_status") == "removed")
    return nodes.select(
        "node_id", (impacted | F.coalesce(passes_on, F.lit(False))).alias("impacting"), impacted.alias("impacted")
    )


def annotate_changes(
    nodes: DataFrame, columns: DataFrame, node_changes: DataFrame, column_changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``columns`` with the change of each; an added or removed node marks all its columns.

    Every row of both stays; changes that are given more than once for an id count once, with their largest values.
    """
    once = node_changes.groupBy("node_id").agg(*[F.max(c).alias(c) for c in ("change_status", "category")])
    annotated = nodes.join(once, "node_id", "left")
    of_node = once.select("node_id", F.col("change_status").alias("__node"))
    of_column = column_changes.groupBy("node_id", "column_name").agg(F.max("change_status").alias("__column"))
    marked = (
        columns.join(of_node, "node_id", "left")
        .join(of_column, ["node_id", "column_name"], "left")
        .withColumn(
            "change_status",
            F.when(F.col("__node").isin("added", "removed"), F.col("__node")).when(
                F.col("__node").isNotNull(), F.col("__column")
            ),
        )
        .drop("__node", "__column")
    )
    return annotated, marked


def column_constraints(columns: DataFrame, node_tests: DataFrame) -> DataFrame:
    """``columns`` with ``not_null`` and ``unique`` flags from the tests declared on them."""
    kind = F.col("test_type")
    tested = node_tests.groupBy("env", "node_id", "column_name").agg(
        F.bool_or(kind == "not_null").alias("not_null"), F.bool_or(kind == "unique").alias("unique")
    )
    return columns.join(tested, ["env", "node_id", "column_name"], "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(False)) for name in ("not_null", "unique")}
    )


def inferred_primary_key(columns: DataFrame, node_tests: DataFrame) -> DataFrame:
    """``env, node_id, primary_key``: the first column, in stored order, that is tested to be unique."""
    flagged = column_constraints(columns, node_tests).filter("unique")
    return flagged.groupBy("env", "node_id").agg(F.min_by("column_name", "ordinal").alias("primary_key"))


def lineage_view(nodes: DataFrame, impacted: DataFrame, limit: int | None) -> Limited:
    """The first ``limit`` merged nodes, changed or impacted ones first, then by id, with how many there are in all."""
    flagged = nodes.join(impacted.select("node_id", F.lit(True).alias("__hit")).distinct(), "node_id", "left")
    priority = F.when(F.col("change_status").isNotNull() | F.col("__hit"), 0).otherwise(1)
    return first(flagged.withColumn("priority", priority).drop("__hit"), [F.col("priority"), F.col("node_id")], limit)
