"""Column lists: identifier resolution, alignment of two schemas, type classes.

Everything here works on schemas only, once per call, and starts no Spark job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError

# The quote pairs accepted around a user-written identifier.
IDENTIFIER_QUOTES = (('"', '"'), ("`", "`"), ("[", "]"))


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it holds."""
    return F.col(quote(name))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unquote(name: str) -> str:
    """Drop one pair of SQL identifier quotes."""
    for opening, closing in IDENTIFIER_QUOTES:
        if len(name) >= 2 and name[0] == opening and name[-1] == closing:
            return name[1:-1]
    return name


def resolve_columns(names: Iterable[str], available: Sequence[str]) -> list[str]:
    """Map user-written names to physical ones: exact first, then ignoring case, else unchanged."""
    exact = set(available)
    folded = {name.lower(): name for name in available}
    plain = [unquote(name) for name in names]
    return [name if name in exact else folded.get(name.lower(), name) for name in plain]


def key_columns(df: DataFrame, pk: str | Sequence[str]) -> list[str]:
    """The primary key as a list of physical column names of ``df``."""
    names = [pk] if isinstance(pk, str) else list(pk or [])
    if not names or not all(names):
        raise ComparisonError("Primary key cannot be empty")
    resolved = resolve_columns(names, df.columns)
    missing = [name for name in resolved if name not in df.columns]
    if missing:
        raise ComparisonError(f"Primary key column(s) {missing} not found in {df.columns}")
    return resolved


def common_columns(
    base: DataFrame,
    current: DataFrame,
    pk: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> list[str]:
    """Columns to compare: the requested ones, or those of both sides in base order; key columns are always included."""
    if columns:
        chosen = resolve_columns(columns, base.columns)
        unknown = [c for c in chosen if c not in base.columns or c not in current.columns]
        if unknown:
            raise ComparisonError(f"Column(s) {unknown} are not present on both sides")
    else:
        in_current = set(current.columns)
        chosen = [name for name in base.columns if name in in_current]
    return [name for name in pk if name not in chosen] + chosen


def select_ignoring_case(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """The columns of ``df`` named in ``columns``, whatever their case; all of them when none is named."""
    if not columns:
        return list(df.columns)
    wanted = {unquote(name).lower() for name in columns}
    return [name for name in df.columns if name.lower() in wanted]


def table_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Name and type of each column of a live table, in order."""
    return [(field.name, field.dataType.simpleString()) for field in df.schema.fields]


def column_types(df: DataFrame | None) -> dict[str, str]:
    """Column name to type name; empty when the table is absent."""
    return {} if df is None else dict(df.dtypes)


def merge_names(base: Sequence[str], current: Sequence[str]) -> list[str]:
    """One list holding both sides' names, keeping each side's neighbourhoods together.

    Names only found in current stay right before the base name they precede there; the rest of current goes last.
    """
    position = {name: i for i, name in enumerate(current)}
    merged: dict[str, None] = {}
    taken = 0
    for i, name in enumerate(base):
        if taken >= len(current):
            merged.update(dict.fromkeys(base[i:]))
            break
        at = position.get(name, -1)
        if name not in merged and at >= taken:
            merged.update(dict.fromkeys(current[taken:at]))
            taken = at + 1
        merged.setdefault(name)
    merged.update(dict.fromkeys(current[taken:]))
    return list(merged)


def merge_columns(base: Sequence[str], current: Sequence[str]) -> list[tuple[str, str | None]]:
    """Merged column list with a status each: added, removed, reordered or None."""
    base_index = {name: i for i, name in enumerate(base)}
    in_current = set(current)
    furthest, out = -1, []
    for name in merge_names(base, current):
        index = base_index.get(name)
        if index is None:
            out.append((name, "added"))
            continue
        status = None if name in in_current else "removed"
        if index > furthest:
            furthest = index
        else:
            status = "reordered"
        out.append((name, status))
    return out


def comparison_class(dtype: T.DataType) -> str | None:
    """``float`` compares with a tolerance, ``integer`` and ``number`` exactly; None for every other type."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "number"
    return None


def type_family(dtype: T.DataType) -> str:
    """Types of one family can be compared; a change of family always reads as a change."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dtype.typeName()


def classify_column(dtype: T.DataType) -> str:
    """How a column's distribution is described: skip, datetime, numeric or categorical."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return "skip"
    family = type_family(dtype)
    return family if family in ("datetime", "numeric") else "categorical"


def histogram_supported(dtype: T.DataType) -> bool:
    return type_family(dtype) in ("numeric", "datetime")


def profile_scope(
    changed: Iterable[str],
    impacted: Iterable[str] = (),
    whole_model_change: bool = False,
    profile_all: bool = False,
) -> tuple[bool, list[str] | None]:
    """Which columns are worth profiling: ``(enabled, columns)``, where None stands for all columns."""
    scope = list(dict.fromkeys([*changed, *impacted]))
    everything = whole_model_change or profile_all
    return bool(scope) or everything, None if everything or not scope else scope
