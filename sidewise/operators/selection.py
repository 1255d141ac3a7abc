"""Sets of lineage nodes, chosen by attribute or change and combined by set algebra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.operators.lineage import downstream, merged_nodes, of_env, upstream
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import cut


@dataclass(frozen=True)
class LineageGraph:
    """What a selection is made from: merged nodes, the edges to walk, and the changes.

    Nodes removed from current stay selectable; the edges are current's plus those that led to a removed node.
    """

    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> LineageGraph:
        """Nodes, edges and changes are stored, since every step of a selection reads them again."""
        merged = cut(merged_nodes(nodes), "merged-nodes")
        changes = merged.filter(F.col("change_status").isNotNull()).select("node_id", "change_status")
        removed = changes.filter(F.col("change_status") == "removed").select(F.col("node_id").alias("child_id"))
        kept = edges.filter(of_env(BASE)).join(removed, "child_id", "left_semi")
        walked = (
            edges.filter(of_env(CURRENT))
            .select("parent_id", "child_id")
            .unionByName(kept.select("parent_id", "child_id"))
            .distinct()
        )
        return cls(merged, cut(walked, "walked-edges"), changes)

    def all(self) -> Selection:
        return self.where(F.lit(True))

    def where(self, condition: Column) -> Selection:
        return Selection(self, self.nodes.filter(condition).select("node_id"))

    def by_name(self, *names: str) -> Selection:
        return self.where(F.col("name").isin(*names))

    def by_type(self, *resource_types: str) -> Selection:
        return self.where(F.col("resource_type").isin(*resource_types))

    def by_tag(self, tag: str) -> Selection:
        return self.where(F.array_contains("tags", tag))

    def by_package(self, *packages: str) -> Selection:
        return self.where(F.col("package_name").isin(*packages))

    def by_materialization(self, *kinds: str) -> Selection:
        return self.where(F.col("materialized").isin(*kinds))

    def modified(self) -> Selection:
        """Nodes added, removed or modified."""
        return Selection(self, self.changes.select("node_id"))

    def changed_models(self) -> Selection:
        """The changed nodes, their direct parents and everything downstream of them."""
        return self.modified().plus(up=1, down=None)

    def select(
        self,
        chosen: Selection | None = None,
        exclude: Selection | None = None,
        packages: Sequence[str] | None = None,
        changed_models: bool = False,
    ) -> Selection:
        """``chosen`` (default: all nodes) without ``exclude``, within the packages and, if asked, the changed-models view."""
        result = chosen or self.all()
        if exclude is not None:
            result = result.exclude(exclude)
        if packages is not None:
            result = result.intersect(self.by_package(*packages))
        if changed_models:
            result = result.intersect(self.changed_models())
        return result


@dataclass(frozen=True)
class Selection:
    """A set of node ids of a graph."""

    graph: LineageGraph
    ids: DataFrame

    def union(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids.union(other.ids).distinct())

    def intersect(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids.intersect(other.ids))

    def exclude(self, other: Selection) -> Selection:
        return Selection(self.graph, self.ids.subtract(other.ids))

    def plus_up(self, degree: int | None = None) -> Selection:
        return self.plus(up=degree, down=0)

    def plus_down(self, degree: int | None = None) -> Selection:
        return self.plus(up=0, down=degree)

    def plus(self, up: int | None = None, down: int | None = None) -> Selection:
        """With ancestors up to ``up`` and descendants up to ``down`` steps away; None is without bound."""
        start = cut(self.ids, "selected")
        ids = start
        if up != 0:
            ids = ids.union(upstream(self.graph.edges, start, up, stored=True).select("node_id"))
        if down != 0:
            ids = ids.union(downstream(self.graph.edges, start, down, stored=True).select("node_id"))
        return Selection(self.graph, ids.distinct())

    def nodes(self) -> DataFrame:
        return self.graph.nodes.join(self.ids, "node_id", "left_semi")
