"""Cell comparison as Column expressions.

``same_value`` is exact, ``cell_changed`` forgives floating-point noise. Both treat NULL as equal to NULL and descend into
arrays, structs and maps; neither ever yields NULL.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from sidewise.functions.columns import comparison_class, type_family

# Two floats are equal when they differ by no more than
# max(FLOAT_RELATIVE_TOLERANCE * max(|a|, |b|), FLOAT_ABSOLUTE_TOLERANCE).
FLOAT_RELATIVE_TOLERANCE = 1e-9
FLOAT_ABSOLUTE_TOLERANCE = 1e-12


def comparable(value: Column, dtype: T.DataType) -> Column:
    """``value`` in a form that Spark can group and compare: maps become sorted entry arrays, variants become JSON text."""
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    if not _holds_incomparable(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: comparable(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [comparable(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda entry: F.struct(
            comparable(entry["key"], dtype.keyType).alias("key"),
            comparable(entry["value"], dtype.valueType).alias("value"),
        ),
    )
    return F.array_sort(entries)


def same_value(base: Column, current: Column, base_type: T.DataType, current_type: T.DataType) -> Column:
    """Exact null-safe equality; sides of different type families only match when both are NULL."""
    if not _same_shape(base_type, current_type):
        return base.isNull() & current.isNull()
    return comparable(base, base_type).eqNullSafe(comparable(current, current_type))


def cell_changed(base: Column, current: Column, base_type: T.DataType, current_type: T.DataType) -> Column:
    """True when a cell differs. The current side's type decides whether a tolerance applies."""
    return ~_equal_with_tolerance(base, current, base_type, current_type)


def any_changed(pairs: Iterable[tuple[Column, Column, T.DataType, T.DataType]]) -> Column:
    """True when any of the column pairs is distinct, compared exactly."""
    return any_of(~same_value(*pair) for pair in pairs)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def within_tolerance(base: Column, current: Column) -> Column:
    """Float equality: equal values (NULL, NaN and infinities included) or finite values closer than the tolerance."""
    base, current = base.cast("double"), current.cast("double")
    infinity = F.lit(float("inf"))
    margin = F.greatest(
        F.lit(FLOAT_RELATIVE_TOLERANCE) * F.greatest(F.abs(base), F.abs(current)), F.lit(FLOAT_ABSOLUTE_TOLERANCE)
    )
    close = (F.abs(base) < infinity) & (F.abs(current) < infinity) & (F.abs(base - current) <= margin)
    return base.eqNullSafe(current) | F.coalesce(close, F.lit(False))


def _equal_with_tolerance(base: Column, current: Column, base_type: T.DataType, current_type: T.DataType) -> Column:
    if not _same_shape(base_type, current_type) or not _holds_float(current_type):
        return same_value(base, current, base_type, current_type)
    if comparison_class(current_type) == "float":
        return within_tolerance(base, current)
    if isinstance(current_type, T.ArrayType):
        return _same_items(base, current, base_type.elementType, current_type.elementType)
    if isinstance(current_type, T.MapType):
        base_items, current_items = F.map_entries(base), F.map_entries(current)
        return _same_items(
            F.array_sort(comparable(base_items, _entry_type(base_type))),
            F.array_sort(comparable(current_items, _entry_type(current_type))),
            _comparable_type(_entry_type(base_type).elementType),
            _comparable_type(_entry_type(current_type).elementType),
        )
    fields = all_of(
        _equal_with_tolerance(base.getField(b.name), current.getField(c.name), b.dataType, c.dataType)
        for b, c in zip(base_type.fields, current_type.fields)
    )
    return F.when(base.isNull() | current.isNull(), base.isNull() & current.isNull()).otherwise(fields)


def _same_items(base: Column, current: Column, base_type: T.DataType, current_type: T.DataType) -> Column:
    pairwise = F.zip_with(base, current, lambda b, c: _equal_with_tolerance(b, c, base_type, current_type))
    deep = (F.size(base) == F.size(current)) & F.forall(pairwise, lambda same: same)
    return F.when(base.isNull() | current.isNull(), base.isNull() & current.isNull()).otherwise(deep)


def _entry_type(map_type: T.MapType) -> T.ArrayType:
    return T.ArrayType(
        T.StructType([T.StructField("key", map_type.keyType, False), T.StructField("value", map_type.valueType)])
    )


def _comparable_type(dtype: T.DataType) -> T.DataType:
    """The type that ``comparable`` produces."""
    if isinstance(dtype, T.VariantType):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_comparable_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _comparable_type(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.MapType):
        return _comparable_type(_entry_type(dtype))
    return dtype


def _holds_incomparable(dtype: T.DataType) -> bool:
    return _holds(dtype, (T.MapType, T.VariantType))


def _holds_float(dtype: T.DataType) -> bool:
    return _holds(dtype, (T.DoubleType, T.FloatType))


def _holds(dtype: T.DataType, kinds: tuple) -> bool:
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds(dtype.elementType, kinds)
    if isinstance(dtype, T.MapType):
        return _holds(dtype.keyType, kinds) or _holds(dtype.valueType, kinds)
    if isinstance(dtype, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dtype.fields)
    return False


def _same_shape(base_type: T.DataType, current_type: T.DataType) -> bool:
    """Whether values of the two types can be compared at all."""
    if isinstance(base_type, T.ArrayType) and isinstance(current_type, T.ArrayType):
        return _same_shape(base_type.elementType, current_type.elementType)
    if isinstance(base_type, T.MapType) and isinstance(current_type, T.MapType):
        return _same_shape(base_type.keyType, current_type.keyType) and _same_shape(
            base_type.valueType, current_type.valueType
        )
    if isinstance(base_type, T.StructType) and isinstance(current_type, T.StructType):
        return base_type.names == current_type.names and all(
            _same_shape(b.dataType, c.dataType) for b, c in zip(base_type.fields, current_type.fields)
        )
    return type_family(base_type) == type_family(current_type)
