"""Bringing the two sides of a comparison into one plan: stacked (union) or matched by key (join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, type_family

BASE, CURRENT = "base", "current"
SIDES = (BASE, CURRENT)
IN_BASE, IN_CURRENT = "__in_base", "__in_current"


def stack(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides' rows under one another, with a boolean ``__in_base``; column types are widened where they differ."""
    return _tagged(base, columns, True).unionByName(_tagged(current, columns, False))


def _tagged(df: DataFrame, columns: Sequence[str], in_base: bool) -> DataFrame:
    return df.select(*[col(c) for c in columns], F.lit(in_base).alias(IN_BASE))


def of_side(side: str) -> Column:
    return F.col(IN_BASE) if side == BASE else ~F.col(IN_BASE)


def base_of(column: str) -> str:
    return f"base__{column}"


def current_of(column: str) -> str:
    return f"current__{column}"


def match(base: DataFrame, current: DataFrame, pk: Sequence[str], base_values: Sequence[str], current_values: Sequence[str]) -> DataFrame:
    """Full outer join on the key, NULL keys matching NULL keys.

    Yields the key columns, ``base__x`` and ``current__x`` for each value column and the presence flags. A key must
    occur at most once per side (see ``plans.keys``), so no key is skewed and the join emits one row per key.
    """
    pk_of = {side: [f"__{side}_key_{i}" for i in range(len(pk))] for side in SIDES}
    left = base.select(
        *[_join_key(base, current, k).alias(n) for k, n in zip(pk, pk_of[BASE])],
        *[col(c).alias(base_of(c)) for c in base_values],
        F.lit(True).alias(IN_BASE),
    )
    right = current.select(
        *[_join_key(current, base, k).alias(n) for k, n in zip(pk, pk_of[CURRENT])],
        *[col(c).alias(current_of(c)) for c in current_values],
        F.lit(True).alias(IN_CURRENT),
    )
    condition = F.lit(True)
    for b, c in zip(pk_of[BASE], pk_of[CURRENT]):
        condition = condition & F.col(b).eqNullSafe(F.col(c))
    joined = left.join(right, condition, "full_outer")
    return joined.select(
        *[F.coalesce(F.col(b), F.col(c)).alias(k) for k, b, c in zip(pk, pk_of[BASE], pk_of[CURRENT])],
        *[col(base_of(c)) for c in base_values],
        *[col(current_of(c)) for c in current_values],
        F.coalesce(F.col(IN_BASE), F.lit(False)).alias(IN_BASE),
        F.coalesce(F.col(IN_CURRENT), F.lit(False)).alias(IN_CURRENT),
    )


def _join_key(df: DataFrame, other: DataFrame, name: str) -> Column:
    """The key column, as text when the two sides hold different kinds of values."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.MapType, T.VariantType)):
        raise ComparisonError(f"Column {name} of type {dtype.simpleString()} cannot be a key")
    same = type_family(dtype) == type_family(other.schema[name].dataType)
    return col(name) if same else col(name).cast("string")


def added() -> Column:
    return ~F.col(IN_BASE)


def removed() -> Column:
    return ~F.col(IN_CURRENT)


def in_both() -> Column:
    return F.col(IN_BASE) & F.col(IN_CURRENT)
