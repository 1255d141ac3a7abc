"""Uniqueness of keys, and exact counts for keys that are not unique.

Matching rows of a key that occurs m times in base and n times in current would emit m*n pairs. None of the aggregates
needs the pairs themselves: they follow from how often each value occurs per key and side, so repeated keys are counted
from grouped values instead of being joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sidewise.errors import DuplicateKeyError
from sidewise.functions.columns import col, type_family
from sidewise.functions.compare import all_of, any_of, comparable
from sidewise.plans.sides import BASE, CURRENT, of_side, stack
from sidewise.plans.storage import cut

BASE_ROWS, CURRENT_ROWS = "__base_rows", "__current_rows"
# Rows of a key meet in one task only while no key has more than this many rows on both sides together.
TOGETHER_ROWS = 100_000


@dataclass(frozen=True)
class KeyFacts:
    """How unique a key is on both sides; keys that hold a NULL are counted apart."""

    base_duplicates: int
    current_duplicates: int
    base_null_duplicates: int
    current_null_duplicates: int
    repeated_rows: int
    rows: int
    largest: int = TOGETHER_ROWS + 1

    @property
    def together(self) -> bool:
        """Whether every key has few enough rows for one task."""
        return self.largest <= TOGETHER_ROWS

    @property
    def mostly_repeated(self) -> bool:
        """Whether so many rows have a repeated key that telling them apart costs more than it saves."""
        return self.repeated_rows * 4 >= self.rows

    @property
    def repeated(self) -> bool:
        return bool(self.base_duplicates or self.current_duplicates or self.null_repeated)

    @property
    def null_repeated(self) -> bool:
        return bool(self.base_null_duplicates or self.current_null_duplicates)


def rows_per_key(base: DataFrame, current: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Row counts of both sides for every key; one shuffle, counted before it."""
    return (
        stack(base, current, pk)
        .groupBy(*[col(k) for k in pk])
        .agg(
            F.count_if(of_side(BASE)).alias(BASE_ROWS),
            F.count_if(of_side(CURRENT)).alias(CURRENT_ROWS),
        )
    )


def key_facts(base: DataFrame, current: DataFrame, pk: Sequence[str]) -> KeyFacts:
    """Check the uniqueness of a key on both sides; one job that returns one row."""
    return key_facts_many([(base, current, pk)])[0]


def key_facts_many(comparisons: Sequence[tuple[DataFrame, DataFrame, Sequence[str]]]) -> list[KeyFacts]:
    """The key checks of several comparisons as one job that returns one row for each."""
    parts = []
    for i, (base, current, pk) in enumerate(comparisons):
        holds_null = any_of(col(k).isNull() for k in pk)
        base_repeated, current_repeated = F.col(BASE_ROWS) > 1, F.col(CURRENT_ROWS) > 1
        rows = F.col(BASE_ROWS) + F.col(CURRENT_ROWS)
        parts.append(
            rows_per_key(base, current, pk)
            .agg(
                F.count_if(base_repeated & ~holds_null).alias("base"),
                F.count_if(current_repeated & ~holds_null).alias("current"),
                F.count_if(base_repeated & holds_null).alias("base_null"),
                F.count_if(current_repeated & holds_null).alias("current_null"),
                F.coalesce(F.sum(F.when(base_repeated | current_repeated, rows)), F.lit(0)).alias("repeated_rows"),
                F.coalesce(F.sum(rows), F.lit(0)).alias("rows"),
                F.coalesce(F.max(rows), F.lit(0)).alias("largest"),
            )
            .select(F.lit(i).alias("i"), "*")
        )
    return [KeyFacts(*row[1:]) for row in sorted(reduce(DataFrame.unionByName, parts).collect())]


def require_unique(base: DataFrame, current: DataFrame, pk: Sequence[str], ignore_null: bool) -> KeyFacts:
    """Raise when a key occurs more than once on a side; with ``ignore_null``, keys holding a NULL may repeat."""
    facts = key_facts(base, current, pk)
    base_duplicates, current_duplicates = facts.base_duplicates, facts.current_duplicates
    if not ignore_null:
        base_duplicates += facts.base_null_duplicates
        current_duplicates += facts.current_null_duplicates
    if base_duplicates or current_duplicates:
        raise DuplicateKeyError(pk, base_duplicates, current_duplicates)
    return facts


def keyed(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    return df.filter(all_of(col(k).isNotNull() for k in pk))


def unkeyed(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    return df.filter(any_of(col(k).isNull() for k in pk))


# A set of repeated keys is sent to every executor only when its measured size stays below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def split_repeated(base: DataFrame, current: DataFrame, pk: Sequence[str]) -> tuple[tuple, tuple]:
    """Divide both sides into ``(rows of keys unique on both sides, rows of the other keys)``.

    The set of repeated keys is stored, since its size is measured and both sides are divided by it.
    """
    keys = rows_per_key(base, current, pk).filter((F.col(BASE_ROWS) > 1) | (F.col(CURRENT_ROWS) > 1))
    names = [f"__repeated_{i}" for i in range(len(pk))]
    repeated = cut(keys.select(*[col(k).alias(n) for k, n in zip(pk, names)]), "repeated-keys")
    size = sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) + 16 for n in names), F.lit(0))
    if (repeated.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)

    def rows(df: DataFrame, how: str) -> DataFrame:
        condition = all_of(col(k).eqNullSafe(F.col(n)) for k, n in zip(pk, names))
        return df.join(repeated, condition, how)

    return (
        (rows(base, "left_anti"), rows(current, "left_anti")),
        (rows(base, "left_semi"), rows(current, "left_semi")),
    )


def pair_counts(
    base: DataFrame,
    current: DataFrame,
    pk: Sequence[str],
    columns: Sequence[str],
    means: Sequence[str] = (),
    nulls: bool = False,
    together: bool = False,
) -> DataFrame:
    """What a full outer join on ``pk`` would count, without building its pairs; one row.

    ``common``, ``added``, ``removed`` rows; ``identical`` pairs (equal in all columns); per column i ``equal_i`` (equal,
    both NULL included) and, with ``nulls``, ``both_null_i``, ``base_null_i``, ``current_null_i``; per column in
    ``means`` the sum and the non-NULL count of either side over the joined rows.

    With ``together`` (no key has many rows), rows are shuffled once, by key, and kept by executors; every count is taken
    from them in place. Otherwise rows are grouped once, copies merged before the shuffle, and stored; every count is
    taken from the stored groups, so that the rows of one key spread over many tasks.
    """
    if not together:
        rows = _comparable_rows(base, current, [*pk, *columns], means)
        groups = cut(_grouped(rows, [*pk, *columns], means), "row-groups")
        return add_up([_per_key(groups, pk, columns if nulls else (), means), *_equal_pairs(groups, pk, columns)])
    spark = base.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = _comparable_rows(base, current, [*pk, *columns], ())
    placed = rows.repartition(number, *[col(k) for k in pk]).persist()
    try:
        # Once the rows are kept, the groupings below see that they lie by key and need no shuffle.
        placed.count()
        numbers = placed.select("*", *[col(name).cast("double").alias(f"__number_{i}") for i, name in enumerate(means)])
        keys = _grouped(numbers, [*pk, *(columns if nulls else ())], means)
        parts = [_per_key(keys, pk, columns if nulls else (), means)]
        parts += [_equal_pairs(_grouped(placed, [*pk, *columns], ()), pk, ())[0]]
        parts += [
            _grouped(placed, [*pk, name], ()).agg(F.sum(F.col("nb") * F.col("nc")).alias(f"equal_{i}"))
            for i, name in enumerate(columns)
        ]
        return cut(add_up(parts), "pair-counts")
    finally:
        placed.unpersist()


def add_up(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row frames of counts merged into one row: columns of equal name are added, absent ones count as zero."""
    merged = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    return merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in merged.columns])


def _comparable_rows(base: DataFrame, current: DataFrame, columns: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Both sides stacked with groupable values; columns of different type families can only match on NULL."""

    def shaped(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        out = []
        for name in columns:
            dtype, other_type = df.schema[name].dataType, other.schema[name].dataType
            value = comparable(col(name), dtype)
            if type_family(dtype) != type_family(other_type):
                value = F.when(value.isNotNull(), F.lit(side))
            out.append(value.alias(name))
        numbers = [col(name).cast("double").alias(f"__number_{i}") for i, name in enumerate(means)]
        return df.select(*out, *numbers)

    extra = [f"__number_{i}" for i in range(len(means))]
    return stack(shaped(base, current, BASE), shaped(current, base, CURRENT), [*columns, *extra])


def _grouped(rows: DataFrame, columns: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Different rows with their count per side (``nb``, ``nc``) and the sums and counts of their numbers."""
    counts = [F.count_if(of_side(BASE)).alias("nb"), F.count_if(of_side(CURRENT)).alias("nc")]
    for i in range(len(means)):
        for side in (BASE, CURRENT):
            inside = F.when(of_side(side), F.col(f"__number_{i}"))
            counts += [F.sum(inside).alias(f"{side}_sum_{i}"), F.count(inside).alias(f"{side}_count_{i}")]
    return rows.groupBy(*[col(c) for c in columns]).agg(*counts)


def _per_key(groups: DataFrame, pk: Sequence[str], columns: Sequence[str], means: Sequence[str]) -> DataFrame:
    counts = [F.sum(n).alias(n) for n in ("nb", "nc")]
    for i, name in enumerate(columns):
        counts += [
            F.coalesce(F.sum(F.when(col(name).isNull(), F.col(n))), F.lit(0)).alias(f"{n}_null_{i}") for n in ("nb", "nc")
        ]
    for i in range(len(means)):
        counts += [F.sum(n).alias(n) for side in (BASE, CURRENT) for n in (f"{side}_sum_{i}", f"{side}_count_{i}")]
    nb, nc = F.col("nb"), F.col("nc")
    joined = [
        F.sum(nb * nc).alias("common"),
        F.sum(F.when(nb == 0, nc)).alias("added"),
        F.sum(F.when(nc == 0, nb)).alias("removed"),
    ]
    for i in range(len(columns)):
        b_null, c_null = F.col(f"nb_null_{i}"), F.col(f"nc_null_{i}")
        joined += [
            F.sum(b_null * c_null).alias(f"both_null_{i}"),
            F.sum(b_null * (nc - c_null)).alias(f"base_null_{i}"),
            F.sum(c_null * (nb - b_null)).alias(f"current_null_{i}"),
        ]
    for i in range(len(means)):
        for side, partners in ((BASE, nc), (CURRENT, nb)):
            times = F.greatest(partners, F.lit(1))
            joined += [
                F.sum(F.col(f"{side}_sum_{i}") * times).alias(f"{side}_sum_{i}"),
                F.sum(F.col(f"{side}_count_{i}") * times).alias(f"{side}_count_{i}"),
            ]
    return groups.groupBy(*[col(k) for k in pk]).agg(*counts).agg(*joined)


def _equal_pairs(groups: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> list[DataFrame]:
    """Pairs of rows of one key that are equal in a column, and in all columns.

    Each column is grouped on its own, from a scan of the key, that column and the counts.
    """
    pairs = F.sum(F.col("nb") * F.col("nc"))
    return [
        groups.agg(pairs.alias("identical")),
        *[
            groups.groupBy(*[col(c) for c in [*pk, name]])
            .agg(F.sum("nb").alias("nb"), F.sum("nc").alias("nc"))
            .agg(pairs.alias(f"equal_{i}"))
            for i, name in enumerate(columns)
        ],
    ]
