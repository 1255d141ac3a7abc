"""Environments: the same table names resolved in two places, base and current."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sidewise.errors import ComparisonError
from sidewise.functions.columns import quote
from sidewise.plans.sides import BASE, CURRENT

# Outcome of looking a table up.
OK = "ok"
NOT_IN_MANIFEST = "not_in_manifest"
UNSUPPORTED_RESOURCE_TYPE = "unsupported_resource_type"
UNSUPPORTED_MATERIALIZATION = "unsupported_materialization"
TABLE_NOT_FOUND = "table_not_found"
PERMISSION_DENIED = "permission_denied"

# What can hold rows of its own.
COUNTABLE_RESOURCE_TYPES = ("model", "snapshot")
COUNTABLE_MATERIALIZATIONS = ("table", "view", "incremental", "snapshot")

# Spark error conditions for a table that is known but cannot be read.
MISSING_CONDITIONS = (
    "TABLE_OR_VIEW_NOT_FOUND",
    "PATH_NOT_FOUND",
    "SCHEMA_NOT_FOUND",
    "DELTA_TABLE_NOT_FOUND",
)
DENIED_CONDITIONS = ("INSUFFICIENT_PERMISSIONS", "PERMISSION_DENIED", "INSUFFICIENT_PRIVILEGES", "UNAUTHORIZED_ACCESS")


@dataclass(frozen=True)
class Model:
    """A named table of an environment and how to open it; opened once, since that reads file footers or the catalog."""

    name: str
    opener: Callable[[], DataFrame]
    resource_type: str = "model"
    materialized: str | None = "table"

    @cached_property
    def frame(self) -> DataFrame:
        return self.opener()

    def open(self) -> DataFrame:
        return self.frame


@dataclass(frozen=True)
class Resolved:
    """A looked-up table; ``frame`` is None unless ``status`` is ok."""

    frame: DataFrame | None
    status: str


def _no_other(name: str) -> Model | None:
    return None


@dataclass(frozen=True)
class Environment:
    """Table names of one side. ``find`` is asked for names that are not listed in ``models``."""

    spark: SparkSession
    models: Mapping[str, Model] = field(default_factory=dict)
    find: Callable[[str], Model | None] = _no_other

    @classmethod
    def of_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Environment:
        return cls(spark, {name: Model(name, lambda frame=frame: frame) for name, frame in frames.items()})

    @classmethod
    def of_files(cls, spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet") -> Environment:
        """Files or folders ``<folder>/<name>.<fmt>``."""

        def model(name: str) -> Model:
            return Model(name, lambda: spark.read.format(fmt).load(f"{folder.rstrip('/')}/{name}.{fmt}"))

        return cls(spark, {name: model(name) for name in names})

    @classmethod
    def of_schema(cls, spark: SparkSession, schema: str, names: Sequence[str] | None = None, suffix: str = "") -> Environment:
        """Tables of a catalog schema; ``suffix`` is added to the schema name, as when each environment has its own."""

        def model(name: str) -> Model:
            return Model(name, lambda: spark.table(f"{schema}{suffix}.{quote(name)}"))

        if names is None:
            return cls(spark, find=model)
        return cls(spark, {name: model(name) for name in names})

    def names(self) -> list[str] | None:
        """All names there are; None if names beyond the listed ones are looked up."""
        return list(self.models) if self.find is _no_other else None

    def table(self, name: str) -> DataFrame | None:
        """The table, or None when this environment does not know it."""
        model = self._model(name)
        return None if model is None else model.open()

    def resolve(self, name: str) -> Resolved:
        """The table for counting and comparing, or the reason why there is none."""
        model = self._model(name)
        if model is None:
            return Resolved(None, NOT_IN_MANIFEST)
        if model.resource_type not in COUNTABLE_RESOURCE_TYPES:
            return Resolved(None, UNSUPPORTED_RESOURCE_TYPE)
        if model.materialized is not None and model.materialized not in COUNTABLE_MATERIALIZATIONS:
            return Resolved(None, UNSUPPORTED_MATERIALIZATION)
        try:
            frame = model.open()
            frame.schema  # forces the lookup
        except AnalysisException as error:
            condition = (error.getCondition() or "").split(".")[0]
            if condition in DENIED_CONDITIONS:
                return Resolved(None, PERMISSION_DENIED)
            if condition in MISSING_CONDITIONS:
                return Resolved(None, TABLE_NOT_FOUND)
            raise
        return Resolved(frame, OK)

    def sql(self, query: str) -> DataFrame:
        """Run a query whose table names are resolved in this environment, and nowhere else.

        Exactly the tables that the query names are opened, under view names of this call alone, so that neither the
        session's own tables nor a query of another thread can be read instead. A name without a table is an error.
        """
        views: dict[str, str] = {}
        try:
            text = query
            # From the last one on, so that the earlier positions stay valid.
            for table in sorted(tables_named(self.spark, query), key=lambda t: t.start, reverse=True):
                if table.name not in views:
                    view = f"sidewise_{uuid.uuid4().hex}"
                    self._open(table.name).createOrReplaceTempView(view)
                    views[table.name] = view
                bound = views[table.name] + ("" if table.aliased else f" as {quote(table.name.split('.')[-1])}")
                text = text[: table.start] + bound + text[table.end :]
            return self.spark.sql(text)
        finally:
            # The analysed plan keeps what it resolved.
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def _open(self, name: str) -> DataFrame:
        resolved = self.resolve(name)
        if resolved.frame is not None:
            return resolved.frame
        model = self._model(name)
        if model is not None and resolved.status in (UNSUPPORTED_RESOURCE_TYPE, UNSUPPORTED_MATERIALIZATION):
            return model.open()
        raise ComparisonError(f"The query reads {name!r}, which this environment cannot open: {resolved.status}")

    def _model(self, name: str) -> Model | None:
        return self.models.get(name) or self.find(name)


class NamedTable(NamedTuple):
    """A table that a query names, the place of the name in its text, and whether the query gives it an alias."""

    name: str
    start: int
    end: int
    aliased: bool


_IDENTIFIER = re.compile(r"(?:`(?:[^`]|``)*`|\w+)(?:\s*\.\s*(?:`(?:[^`]|``)*`|\w+))*")


def tables_named(spark: SparkSession, query: str) -> list[NamedTable]:
    """The tables that a query reads by name, subqueries included, common table expressions left out."""
    found: list[NamedTable] = []

    def items(sequence) -> list:
        return [sequence.apply(i) for i in range(sequence.size())]

    def walk(node, known: frozenset[str], aliased: bool = False) -> None:
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            parts = items(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in known:
                start = node.origin().startIndex().get()
                text = _IDENTIFIER.match(query, start)
                found.append(NamedTable(".".join(parts), start, text.end(), aliased))
            return
        if kind == "UnresolvedWith":
            # A definition sees those before it; its own name means the table outside unless it recurses.
            for entry in items(node.cteRelations()):
                own = frozenset({entry._1().lower()})
                walk(entry._2(), known | own if node.allowRecursion() else known)
                known = known | own
            walk(node.child(), known)
            return
        inner = kind == "SubqueryAlias"
        for child in items(node.children()):
            walk(child, known, inner)
        for child in items(node.subqueries()):
            walk(child, known)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset())
    return found


@dataclass(frozen=True)
class EnvPair:
    """The two environments of a comparison."""

    base: Environment
    current: Environment

    def side(self, side: str) -> Environment:
        return {BASE: self.base, CURRENT: self.current}[side]

    def table(self, name: str, side: str = CURRENT) -> DataFrame | None:
        return self.side(side).table(name)

    def sql(self, query: str, side: str = CURRENT) -> DataFrame:
        return self.side(side).sql(query)
