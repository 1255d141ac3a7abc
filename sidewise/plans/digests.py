"""Digests of keyed tables: what two tables have in common is told from stored digests, without reading or joining its rows.

The rows of a table are dealt to *leaves* by the hash of their key and leaves to ``GROUPS`` *groups*: a hash tree of two
levels, held as a table of one row per leaf. A leaf holds its number of rows and, for the keys and for every column with
its key, the exclusive or of two 64-bit hashes over its rows; besides the NULLs and the sum of each column, from which the
counts of equal leaves follow. Two leaves with equal digests hold the same rows (up to a collision of 128 hash bits), as long
as the key is unique on one side.

Two tables are compared from the top: groups first, then the leaves of unequal groups. Only rows of unequal leaves are read on.
Rows stored along with their digests lie in folders of groups, sorted by leaf, so that equal groups are not even scanned.

Rows whose key holds a NULL belong to no leaf and are always read. Types that differ only in width (integers, floats)
hash alike; others that differ make their column unequal everywhere, which costs reading but no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, common_columns, key_columns, type_family
from sidewise.functions.compare import all_of, any_of, comparable
from sidewise.plans.storage import cut, shared_path

GROUP, LEAF = "__group", "__leaf"
GROUPS = 256
LEAF_ROWS = 4096
# The list of unequal leaves is sent to every executor only while its measured size stays below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
NO_LEAF = -1
_ROWS, _KEYS = "rows", "keys"


@dataclass(frozen=True)
class Digested:
    """A table with its digests. ``rows`` has the table's columns besides group and leaf.

    ``unique`` tells whether no key without NULL occurs twice; None if that was not looked at. ``columns`` are the value
    columns with a digest, in the order of their numbers in ``leaves``.
    """

    rows: DataFrame
    leaves: DataFrame
    keys: list[str]
    columns: list[str]
    leaf_count: int
    unique: bool | None

    @cached_property
    def frame(self) -> DataFrame:
        """The table itself."""
        return self.rows.drop(GROUP, LEAF)


def digest(
    df: DataFrame,
    pk: str | Sequence[str],
    columns: Sequence[str] | None = None,
    like: Digested | None = None,
    check_key: bool = True,
    path: str | None = None,
    keep_rows: bool = False,
) -> Digested:
    """Store the digests of a table, below the session's shared folder or at ``path`` to be opened again.

    ``like`` names the digests they will be compared with: the leaves are the same then. ``keep_rows`` stores the rows too.
    """
    spark = df.sparkSession
    keys = key_columns(df, pk)
    values = [c for c in common_columns(df, df, keys, columns) if c not in keys]
    if like is not None:
        if len(like.keys) != len(keys):
            raise ComparisonError(f"The keys differ: {like.keys} and {keys}")
        leaf_count = like.leaf_count
    else:
        leaf_count = GROUPS * max(1, -(-df.count() // (LEAF_ROWS * GROUPS)))
    unique = _is_unique(df, keys) if check_key else None
    path = path or shared_path(spark, "digests")
    rows = _dealt(df, keys, leaf_count)
    if keep_rows:
        names = {c: f"c{i}" for i, c in enumerate(df.columns)}
        clustered = rows.toDF(GROUP, LEAF, *names.values()).repartitionByRange(GROUP, LEAF).sortWithinPartitions(GROUP, LEAF)
        clustered.write.partitionBy(GROUP).option("compression", "zstd").parquet(f"{path}/rows")
    _leaves(rows, df.schema, keys, values).write.parquet(f"{path}/leaves")
    facts = [(keys, values, list(df.columns), leaf_count, unique, keep_rows)]
    kinds = "keys array<string>, columns array<string>, names array<string>, leaf_count long, is_unique boolean, kept boolean"
    spark.createDataFrame(facts, kinds).coalesce(1).write.parquet(f"{path}/facts")
    return open_digested(spark, path, df)


def open_digested(spark: SparkSession, path: str, df: DataFrame | None = None) -> Digested:
    """Digests stored at ``path``, of the table ``df`` unless its rows are stored with them."""
    facts = spark.read.parquet(f"{path}/facts").first()
    if facts["kept"]:
        stored = spark.read.parquet(f"{path}/rows")
        rows = stored.select(
            col(GROUP).cast("int").alias(GROUP), LEAF, *[F.col(f"c{i}").alias(c) for i, c in enumerate(facts["names"])]
        )
    elif df is not None:
        rows = _dealt(df, facts["keys"], facts["leaf_count"])
    else:
        raise ComparisonError("The rows are not stored with these digests: name their table")
    leaves = spark.read.parquet(f"{path}/leaves")
    return Digested(rows, leaves, facts["keys"], facts["columns"], facts["leaf_count"], facts["is_unique"])


@dataclass(frozen=True)
class Ranges:
    """What two digested tables have in common, and what has to be compared.

    ``base`` and ``current`` are the rows of unequal leaves and those without leaf. ``equal`` is one row over the equal leaves:
    ``rows``, and per compared column ``nulls_i`` and, if it is numeric, ``sum_i``. ``report`` is one row about the tree.
    """

    base: DataFrame
    current: DataFrame
    equal: DataFrame
    report: DataFrame


def compare_digests(base: Digested, current: Digested, columns: Sequence[str]) -> Ranges:
    """Compare two trees from the top. ``columns`` are value columns that both have digests of."""
    if base.leaf_count != current.leaf_count:
        raise ComparisonError("The leaves differ: digest one table like the other")
    unknown = [c for c in columns if c not in base.columns or c not in current.columns]
    if unknown:
        raise ComparisonError(f"Column(s) {unknown} have no digest on both sides")
    left, right = (_numbered(d, columns) for d in (base, current))
    marks = [_ROWS, *_marks(_KEYS), *[m for i in range(len(columns)) for m in _marks(str(i))]]
    # One row per group at most; their number is fixed.
    groups = [row[GROUP] for row in _unequal(_added_up(left, marks), _added_up(right, marks), GROUP, marks).collect()]
    within = F.col(GROUP).isin(groups)
    leaves = cut(_unequal(left.filter(within), right.filter(within), LEAF, marks), "unequal-leaves")
    count = leaves.count()
    small = count * 16 <= BROADCAST_BYTES

    def rows_of(side: Digested) -> DataFrame:
        always = leaves.sparkSession.createDataFrame([(NO_LEAF,)], f"{LEAF} long")
        wanted = leaves.select(LEAF).unionByName(always)
        rows = side.rows.filter(F.col(GROUP).isin([NO_LEAF, *groups]))
        return rows.join(F.broadcast(wanted) if small else wanted, LEAF, "left_semi").select(*[col(c) for c in side.frame.columns])

    alike = left.join(leaves.select(LEAF), LEAF, "left_anti")
    facts = [c for c in left.columns if c.startswith(("nulls_", "sum_"))]
    equal = alike.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (_ROWS, *facts)])
    read = lambda side: F.coalesce(F.sum(f"{side}_rows"), F.lit(0))
    tree = leaves.agg(read("base").alias("base_rows_read"), read("current").alias("current_rows_read"))
    report = (
        tree.crossJoin(equal.select(F.col(_ROWS).alias("equal_rows")))
        .select(
            F.lit(GROUPS).alias("groups"), F.lit(len(groups)).alias("unequal_groups"),
            F.lit(base.leaf_count).cast("long").alias("leaves"), F.lit(count).cast("long").alias("unequal_leaves"),
            "equal_rows", "base_rows_read", "current_rows_read",
        )
    )
    return Ranges(rows_of(base), rows_of(current), equal, report)


def _is_unique(df: DataFrame, keys: list[str]) -> bool:
    whole = df.filter(all_of(col(k).isNotNull() for k in keys))
    return whole.groupBy(*[col(k) for k in keys]).count().filter("count > 1").isEmpty()


def _dealt(df: DataFrame, keys: list[str], leaf_count: int) -> DataFrame:
    """``df`` with its group and leaf in front."""
    hashed = F.xxhash64(*[_hashable(col(k), df.schema[k].dataType) for k in keys])
    leaf = F.when(any_of(col(k).isNull() for k in keys), NO_LEAF).otherwise(F.pmod(hashed, F.lit(leaf_count)))
    group = F.when(F.col(LEAF) == NO_LEAF, NO_LEAF).otherwise(F.col(LEAF) % GROUPS).cast("int")
    placed = df.withColumn(LEAF, leaf.cast("long"))
    return placed.select(group.alias(GROUP), LEAF, *[col(c) for c in df.columns])


def _marks(name: str) -> list[str]:
    return [f"mix_{name}_{seed}" for seed in (0, 1)]


def _leaves(rows: DataFrame, schema: T.StructType, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per leaf, from one pass over the rows; partial digests are merged before the shuffle."""
    key = [_hashable(col(k), schema[k].dataType) for k in keys]

    def digest_of(name: str, *values: Column) -> list[Column]:
        return [F.bit_xor(F.xxhash64(F.lit(seed), *key, *values)).alias(mark) for seed, mark in enumerate(_marks(name))]

    facts = digest_of(_KEYS)
    for i, name in enumerate(columns):
        dtype = schema[name].dataType
        facts += digest_of(str(i), _marked(col(name), dtype))
        facts.append(F.count_if(col(name).isNull()).alias(f"nulls_{i}"))
        if type_family(dtype) == "numeric":
            facts.append(F.sum(col(name).cast("double")).alias(f"sum_{i}"))
    return rows.filter(F.col(LEAF) != NO_LEAF).groupBy(GROUP, LEAF).agg(F.count(F.lit(1)).alias(_ROWS), *facts)


def _marked(value: Column, dtype: T.DataType) -> Column:
    """A value in a form whose hash tells NULLs apart: the hash of a NULL is no hash at all."""
    return F.struct(value.isNull(), _hashable(value, dtype))


def _hashable(value: Column, dtype: T.DataType) -> Column:
    """A value in a form in which equal values of one type family hash alike, and different ones differ."""
    if isinstance(dtype, T.IntegralType):
        return value.cast("long")
    if isinstance(dtype, T.FloatType):
        return value.cast("double")
    if isinstance(dtype, T.ArrayType):
        return F.struct(F.size(value), F.transform(value, lambda item: _marked(item, dtype.elementType)))
    if isinstance(dtype, T.StructType):
        return F.struct(*[_marked(value.getField(f.name), f.dataType) for f in dtype.fields])
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        # Entries are sorted in their comparable form, keys first.
        entries = F.array_sort(comparable(F.map_entries(value), T.ArrayType(entry)))
        kinds = T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in entry.fields])
        return _hashable(entries, T.ArrayType(kinds))
    return comparable(value, dtype)


def _plain(dtype: T.DataType) -> T.DataType:
    """The type of a comparable form: nested maps have become arrays of entries, variants text."""
    if isinstance(dtype, T.VariantType):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("key", _plain(dtype.keyType)), T.StructField("value", _plain(dtype.valueType))]))
    return dtype


def _numbered(side: Digested, columns: Sequence[str]) -> DataFrame:
    """The leaves of a table with its columns numbered as in ``columns``."""
    found = [F.col(c) for c in (GROUP, LEAF, _ROWS, *_marks(_KEYS))]
    for i, name in enumerate(columns):
        j = side.columns.index(name)
        found += [F.col(old).alias(new) for old, new in zip(_marks(str(j)), _marks(str(i)))]
        found.append(F.col(f"nulls_{j}").alias(f"nulls_{i}"))
        if f"sum_{j}" in side.leaves.columns:
            found.append(F.col(f"sum_{j}").alias(f"sum_{i}"))
    return side.leaves.select(*found)


def _added_up(leaves: DataFrame, marks: Sequence[str]) -> DataFrame:
    """One row per group: the upper level of the tree."""
    return leaves.groupBy(GROUP).agg(F.sum(_ROWS).alias(_ROWS), *[F.bit_xor(m).alias(m) for m in marks if m != _ROWS])


def _unequal(left: DataFrame, right: DataFrame, node: str, marks: Sequence[str]) -> DataFrame:
    """The nodes whose digests differ, with the rows of either side."""
    both = left.select(node, F.struct(*marks).alias("base")).join(
        right.select(node, F.struct(*marks).alias("current")), node, "full_outer"
    )
    return both.filter(~F.col("base").eqNullSafe(F.col("current"))).select(
        node, F.col(f"base.{_ROWS}").alias("base_rows"), F.col(f"current.{_ROWS}").alias("current_rows")
    )
