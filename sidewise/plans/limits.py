"""The first rows of a result, with what the limit leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.plans.storage import cut


@dataclass(frozen=True)
class Limited:
    """``rows`` in order, how many there are in all, and whether some were left out."""

    rows: DataFrame
    total: int
    more: bool

    def flagged(self) -> DataFrame:
        """The rows with ``total`` and ``more`` in each."""
        return self.rows.withColumns({"total": F.lit(self.total).cast("long"), "more": F.lit(self.more)})


def first(df: DataFrame, order: Sequence[Column], limit: int | None) -> Limited:
    """The first ``limit`` rows of ``df`` (all with None). ``df`` is computed and stored once for rows and total."""
    stored = cut(df, "limited")
    total = stored.count()
    rows = stored.orderBy(*order) if order else stored
    return Limited(rows if limit is None else rows.limit(limit), total, limit is not None and total > limit)
