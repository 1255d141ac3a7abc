"""Value comparison of two tables by primary key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sidewise.errors import DuplicateKeyError
from sidewise.functions.columns import col, common_columns, key_columns, type_family
from sidewise.functions.compare import any_changed, comparable, same_value
from sidewise.plans.keys import KeyFacts, add_up, key_facts, keyed, pair_counts, require_unique, split_repeated, unkeyed
from sidewise.plans.limits import Limited, first
from sidewise.plans.sides import (
    BASE,
    CURRENT,
    IN_BASE,
    IN_CURRENT,
    added,
    base_of,
    current_of,
    in_both,
    match,
    of_side,
    removed,
    stack,
)

# The seven outcomes of comparing one cell.
MATCH = "perfect match"
BOTH_NULL = "both are null"
MISSING_BASE = "missing from a"
MISSING_CURRENT = "missing from b"
NULL_BASE = "value is null in a only"
NULL_CURRENT = "value is null in b only"
MISMATCH = "values do not match"


def duplicate_keys(df: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count. A key of one column may repeat its NULL."""
    keys = key_columns(df, pk)
    rows = keyed(df, keys) if isinstance(pk, str) else df
    return (
        rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)
    )


def verify_primary_key(base: DataFrame, current: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Number of duplicated keys and the verdict, one row per side."""
    return stack_sides(
        *(
            duplicate_keys(df, pk).agg(F.count(F.lit(1)).alias("duplicate_keys"))
            for df in (base, current)
        )
    ).select("side", "duplicate_keys", (F.col("duplicate_keys") == 0).alias("is_valid"))


def stack_sides(base: DataFrame, current: DataFrame) -> DataFrame:
    """Two results of equal shape under one another, with a ``side`` column in front."""
    return base.select(F.lit(BASE).alias("side"), "*").unionByName(current.select(F.lit(CURRENT).alias("side"), "*"))


def value_diff_join(base: DataFrame, current: DataFrame, pk: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Matched rows: key columns, ``base__x``/``current__x``, and ``status__x`` naming the outcome of each cell."""
    keys, values, _ = _plan(base, current, pk, columns, null_keys_may_repeat=False)
    joined = match(base, current, keys, values, values)
    return joined.select(
        *[col(k) for k in keys],
        *[
            c
            for v in values
            for c in (col(base_of(v)), col(current_of(v)), _cell_status(base, current, v).alias(f"status__{v}"))
        ],
    )


def value_diff(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Match rate of each column over the rows present on both sides, next to the row totals.

    ``column, matched, matched_p, total, added, removed``; ``matched_p`` is NULL when no row is common. The key must be
    unique on each side; NULL keys of a one-column key may repeat.
    """
    keys, values, facts = _plan(base, current, pk, columns, null_keys_may_repeat=True)
    counts = cell_counts(base, current, keys, values, facts, statuses=False)
    return match_rates(counts, keys, values, common_columns(base, current, keys, columns))


def match_rates(counts: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The rows of a value diff, from one row of ``cell_counts``."""
    rows = [
        _matched_row(name, F.col("common") if name in keys else F.col(f"equal_{values.index(name)}")) for name in order
    ]
    return (
        counts.select(F.explode(F.array(*rows)).alias("r"), "common", "added", "removed")
        .select(
            F.col("r.column").alias("column"),
            F.col("r.matched").alias("matched"),
            F.try_divide(F.col("r.matched").cast("double"), F.col("common").cast("double")).alias("matched_p"),
            (F.col("common") + F.col("added") + F.col("removed")).alias("total"),
            "added",
            "removed",
        )
    )


def value_diff_status(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """How often each outcome occurs per column: ``column, match_status, count_records, percent_of_total``."""
    keys, values, facts = _plan(base, current, pk, columns, null_keys_may_repeat=True)
    return status_rows(cell_counts(base, current, keys, values, facts, statuses=True), keys, values)


def status_rows(counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The outcomes per column, from one row of ``cell_counts`` with statuses."""
    total = F.col("common") + F.col("added") + F.col("removed")
    outcomes = []
    for j, name in enumerate(keys):
        both_null = F.col(f"key_null_{j}")
        outcomes += [
            _status_row(name, MATCH, F.col("common") - both_null),
            _status_row(name, BOTH_NULL, both_null),
            _status_row(name, MISSING_BASE, F.col("added")),
            _status_row(name, MISSING_CURRENT, F.col("removed")),
        ]
    for i, name in enumerate(values):
        both_null, base_null, current_null, equal = (
            F.col(f"{kind}_{i}") for kind in ("both_null", "base_null", "current_null", "equal")
        )
        outcomes += [
            _status_row(name, MATCH, equal - both_null),
            _status_row(name, BOTH_NULL, both_null),
            _status_row(name, MISSING_BASE, F.col("added")),
            _status_row(name, MISSING_CURRENT, F.col("removed")),
            _status_row(name, NULL_BASE, base_null),
            _status_row(name, NULL_CURRENT, current_null),
            _status_row(name, MISMATCH, F.col("common") - equal - base_null - current_null),
        ]
    percent = F.round(F.try_divide(F.lit(100.0) * F.col("r.count_records"), F.col("total").cast("double")), 2)
    return (
        counts.select(F.explode(F.array(*outcomes)).alias("r"), total.alias("total"))
        .filter(F.col("r.count_records") > 0)
        .select("r.column", "r.match_status", "r.count_records", percent.alias("percent_of_total"))
    )


def value_diff_detail(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
    multiset: bool = False,
    check_key: bool = True,
) -> DataFrame:
    """Distinct rows found on one side only, flagged ``in_a`` (base) or ``in_b`` (current), in no order.

    ``multiset=True`` counts copies too: a row held three times in base and once in current comes out twice. Rows are
    grouped, never joined, so the key need not be unique; ``check_key`` raises an error when it is not.
    """
    keys = key_columns(base, pk)
    if check_key:
        require_unique(base, current, keys, ignore_null=isinstance(pk, str))
    return one_sided_rows(base, current, common_columns(base, current, keys, columns), multiset)


def value_diff_detail_report(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    limit: int | None,
    columns: Sequence[str] | None = None,
    multiset: bool = False,
) -> Limited:
    """The first ``limit`` rows of the detail by key, their total, and whether there are more."""
    rows = value_diff_detail(base, current, pk, columns, multiset)
    return first(rows, report_order(rows, key_columns(base, pk)), limit)


def one_sided_rows(base: DataFrame, current: DataFrame, columns: Sequence[str], multiset: bool = False) -> DataFrame:
    """Rows of ``columns`` found on one side only, from one grouping of both sides by the whole row."""
    names = [f"__v{i}" for i in range(len(columns))]

    def groupable(df: DataFrame, other: DataFrame) -> DataFrame:
        out = []
        for name, alias in zip(columns, names):
            dtype = df.schema[name].dataType
            mixed = type_family(dtype) != type_family(other.schema[name].dataType)
            out.append((col(name).cast("string") if mixed else comparable(col(name), dtype)).alias(alias))
        return df.select(*out)

    stacked = stack(groupable(base, current), groupable(current, base), names)
    rows = stacked.groupBy(*names).agg(
        F.count_if(of_side(BASE)).alias("__nb"), F.count_if(of_side(CURRENT)).alias("__nc")
    )
    nb, nc = F.col("__nb"), F.col("__nc")
    values = [F.col(n).alias(c) for n, c in zip(names, columns)]
    if not multiset:
        return rows.filter((nb == 0) | (nc == 0)).select(
            *values, (nb > 0).alias("in_a"), (nc > 0).alias("in_b")
        )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.abs(nb - nc))).alias("__copy")
    return (
        rows.filter(nb != nc).select(*values, (nb > nc).alias("in_a"), (nc > nb).alias("in_b"), copies).drop("__copy")
    )


def report_order(rows: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The report order: key columns, then base before current; remaining columns settle ties."""
    rest = [c for c in rows.columns if c not in keys and c not in ("in_a", "in_b")]
    sortable = [c for c in rest if rows.schema[c].dataType.typeName() != "map"]
    order = [col(k).asc_nulls_last() for k in keys]
    return order + [F.col("in_a").desc(), F.col("in_b").desc()] + [col(c).asc_nulls_last() for c in sortable]


def impact_value_diff(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
    facts: KeyFacts | None = None,
) -> DataFrame:
    """Rows added, removed and changed, and per column the changed rows and the mean of either side.

    One row per column: ``column, changed, base_mean, current_mean, rows_added, rows_removed, rows_changed,
    affected_row_count``. The key need not be unique: rows of a repeated key count as the pairs a join would form.
    ``facts`` passes on a key check already made.
    """
    keys = key_columns(base, pk)
    values = [c for c in common_columns(base, current, keys, columns) if c not in keys]
    numeric = numeric_columns(base, current, values)
    counts = change_counts(base, current, keys, values, numeric, facts or key_facts(base, current, keys))
    return change_rows(counts, values, numeric)


def numeric_columns(base: DataFrame, current: DataFrame, values: Sequence[str]) -> list[str]:
    """The columns that are numbers on both sides."""
    return [v for v in values if {type_family(df.schema[v].dataType) for df in (base, current)} == {"numeric"}]


def change_rows(counts: DataFrame, values: list[str], numeric: list[str]) -> DataFrame:
    """One row per column, from one row of ``change_counts``."""

    def mean(side: str, name: str) -> Column:
        if name not in numeric:
            return F.lit(None).cast("double")
        i = numeric.index(name)
        return F.try_divide(F.col(f"{side}_sum_{i}"), F.col(f"{side}_count_{i}"))

    rows = [
        F.struct(
            F.lit(v).alias("column"),
            F.col(f"changed_{i}").alias("changed"),
            mean(BASE, v).alias("base_mean"),
            mean(CURRENT, v).alias("current_mean"),
        )
        for i, v in enumerate(values)
    ]
    return counts.select(
        F.inline(F.array(*rows)),
        F.col("added").alias("rows_added"),
        F.col("removed").alias("rows_removed"),
        F.col("changed").alias("rows_changed"),
        (F.col("added") + F.col("removed") + F.col("changed")).alias("affected_row_count"),
    )


def change_counts(
    base: DataFrame, current: DataFrame, keys: list[str], values: list[str], numeric: list[str], facts: KeyFacts
) -> DataFrame:
    """One row of change counts: unique keys are joined, repeated ones counted without forming their pairs."""
    if not facts.repeated:
        return _joined_changes(base, current, keys, values, numeric)
    parts, repeated = [], (base, current)
    if not facts.mostly_repeated:
        single, repeated = split_repeated(base, current, keys)
        parts.append(_joined_changes(*single, keys, values, numeric))
    sums = [f"{s}_{kind}_{i}" for i in range(len(numeric)) for s in (BASE, CURRENT) for kind in ("sum", "count")]
    pairs = pair_counts(*repeated, keys, values, numeric, together=facts.together).select(
        "added",
        "removed",
        (F.col("common") - F.col("identical")).alias("changed"),
        *[(F.col("common") - F.col(f"equal_{i}")).alias(f"changed_{i}") for i in range(len(values))],
        *sums,
    )
    return add_up([*parts, pairs])


def _joined_changes(base: DataFrame, current: DataFrame, keys: list[str], values: list[str], numeric: list[str]) -> DataFrame:
    joined = match(base, current, keys, values, values)
    pairs = [_pair(base, current, v) for v in values]
    sums = []
    for i, name in enumerate(numeric):
        for side, value in ((BASE, col(base_of(name))), (CURRENT, col(current_of(name)))):
            number = value.cast("double")
            sums += [
                F.coalesce(F.sum(number), F.lit(0.0)).alias(f"{side}_sum_{i}"),
                F.count(number).alias(f"{side}_count_{i}"),
            ]
    return joined.agg(
        F.count_if(added()).alias("added"),
        F.count_if(removed()).alias("removed"),
        F.count_if(in_both() & any_changed(pairs)).alias("changed"),
        *[F.count_if(in_both() & ~same_value(*pair)).alias(f"changed_{i}") for i, pair in enumerate(pairs)],
        *sums,
    )


def _plan(
    base: DataFrame,
    current: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None,
    null_keys_may_repeat: bool,
) -> tuple[list[str], list[str], KeyFacts]:
    """Key columns, compared non-key columns, and what is known about the key."""
    keys = key_columns(base, pk)
    values = [c for c in common_columns(base, current, keys, columns) if c not in keys]
    facts = require_unique(base, current, keys, ignore_null=isinstance(pk, str))
    if facts.null_repeated and not null_keys_may_repeat:
        raise DuplicateKeyError(keys, facts.base_null_duplicates, facts.current_null_duplicates)
    return keys, values, facts


def cell_counts(base: DataFrame, current: DataFrame, keys: list[str], values: list[str], facts: KeyFacts, statuses: bool) -> DataFrame:
    """One row of totals over the matched rows; NULL keys that may repeat are counted apart, without pairing them."""
    apart = len(keys) == 1 and facts.null_repeated
    left, right = (keyed(base, keys), keyed(current, keys)) if apart else (base, current)
    counts = _joined_counts(left, right, keys, values, statuses)
    if not apart:
        return counts
    pairs = pair_counts(unkeyed(base, keys), unkeyed(current, keys), keys, values, nulls=statuses)
    pairs = pairs.withColumn("key_null_0", F.col("common"))
    return add_up([counts, pairs.select(*counts.columns)])


def _joined_counts(base: DataFrame, current: DataFrame, keys: list[str], values: list[str], statuses: bool) -> DataFrame:
    joined = match(base, current, keys, values, values)
    counts = [
        F.count_if(in_both()).alias("common"),
        F.count_if(added()).alias("added"),
        F.count_if(removed()).alias("removed"),
    ]
    if statuses:
        counts += [F.count_if(in_both() & col(k).isNull()).alias(f"key_null_{j}") for j, k in enumerate(keys)]
    for i, name in enumerate(values):
        b, c = col(base_of(name)), col(current_of(name))
        counts.append(F.count_if(in_both() & same_value(*_pair(base, current, name))).alias(f"equal_{i}"))
        if statuses:
            counts += [
                F.count_if(in_both() & b.isNull() & c.isNull()).alias(f"both_null_{i}"),
                F.count_if(in_both() & b.isNull() & c.isNotNull()).alias(f"base_null_{i}"),
                F.count_if(in_both() & b.isNotNull() & c.isNull()).alias(f"current_null_{i}"),
            ]
    return joined.agg(*counts)


def _pair(base: DataFrame, current: DataFrame, name: str) -> tuple:
    return col(base_of(name)), col(current_of(name)), base.schema[name].dataType, current.schema[name].dataType


def _cell_status(base: DataFrame, current: DataFrame, name: str) -> Column:
    b, c = col(base_of(name)), col(current_of(name))
    return (
        F.when(~F.col(IN_BASE), MISSING_BASE)
        .when(~F.col(IN_CURRENT), MISSING_CURRENT)
        .when(b.isNull() & c.isNull(), BOTH_NULL)
        .when(same_value(*_pair(base, current, name)), MATCH)
        .when(b.isNull(), NULL_BASE)
        .when(c.isNull(), NULL_CURRENT)
        .otherwise(MISMATCH)
    )


def _matched_row(name: str, matched: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), matched.alias("matched"))


def _status_row(name: str, status: str, count: Column) -> Column:
    return F.struct(
        F.lit(name).alias("column"), F.lit(status).alias("match_status"), count.alias("count_records")
    )
