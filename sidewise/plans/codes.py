"""Exact distinct counts of all columns, stored by part and merged for any set of parts without reading the table again.

One scan counts the rows of each part, and a second one stacks the columns and keeps every value of a column once, with a bit for each
part that holds it; copies are merged before the shuffle. A dictionary gives each distinct value of a column a whole number, without
gaps and in value order, and a part keeps the numbers of its values as bitmaps of 32 768 bits. Counts of any parts are unions of
bitmaps: the values themselves are not touched again. Further parts extend the dictionary by the values it lacks.

A value is told by its text (floating-point zeros are one value, times are told by their microseconds). Texts beyond ``LONG`` characters
are told by length and SHA-512, so that a dictionary does not hold a second copy of a table of long texts.

Defined results: NULL is no value; a column without values counts 0; nested columns are left out; an empty table counts 0 in every column;
a part added twice counts its rows twice and its values once. Rows added later need the same columns, whatever the case of their names, of
the same types. One writer at a time; both scans of the rows must find the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, resolve_columns, select_ignoring_case
from sidewise.plans.ordering import POSITION, number_rows
from sidewise.plans.storage import cut, shared_path

# Longer texts are told by their hash; no shorter text looks like one.
LONG = 128
PART = "part"
# Parts to a row of a value, and parts that are sent to every task.
_BITS = 64
_BROADCAST_PARTS = 100_000
# Types whose values are grouped as they are; others by their text.
_PLAIN = (T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def countable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def value_text(value: Column, dtype: T.DataType) -> Column:
    """A text that two values of a column share if and only if they are equal."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # Minus zero plus zero is zero.
        return (value + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    text = F.hex(value) if isinstance(dtype, T.BinaryType) else value.cast("string")
    if isinstance(dtype, (T.BinaryType, T.StringType, T.CharType, T.VarcharType)):
        hashed = F.concat_ws(":", F.char_length(text).cast("string"), F.sha2(text, 512))
        return F.when(F.char_length(text) > LONG, hashed).otherwise(text)
    return text


@dataclass(frozen=True)
class Codes:
    """Stored dictionary, bitmaps and row counts below ``path``."""

    spark: SparkSession
    path: str

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def dictionary(self) -> DataFrame:
        """``column, value, code``: one row per distinct value."""
        return self._stored("dictionary")

    def bitmaps(self) -> DataFrame:
        """``part, column, bucket, bitmap``: the codes of a part, 32 768 to a row."""
        return self._stored("bitmaps")

    def facts(self) -> DataFrame:
        """``part, column, rows, filled``."""
        return self._stored("facts")

    def add(self, df: DataFrame, part: Column | None = None) -> Codes:
        """Describe further rows, of the parts that ``part`` names (NULL is a part of its own)."""
        known = self.dictionary()
        first = known.agg(F.coalesce(F.max("code"), F.lit(0)).alias("last")).first()["last"]
        names = [r["column"] for r in self.facts().select("column").distinct().collect()]
        own = resolve_columns(names, df.columns)
        missing = sorted(set(own) - set(df.columns))
        if missing:
            raise ComparisonError(f"Columns {missing} not found in {df.columns}")
        _describe(df, part, dict(zip(names, own)), self.path, known, first)
        return self

    def counts(self, where: Column | str = "true") -> DataFrame:
        """``column_name, row_count, filled, distinct_count`` over the parts that ``where``, a condition on ``part``, selects."""
        rows = self.facts().filter(where).groupBy("column").agg(F.sum("rows").alias("row_count"), F.sum("filled").alias("filled"))
        merged = self.bitmaps().filter(where).groupBy("column", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
        distinct = merged.groupBy("column").agg(F.sum("n").alias("n"))
        every = self.facts().select("column").distinct()
        zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
        return every.join(rows, "column", "left").join(distinct, "column", "left").select(
            F.col("column").alias("column_name"), zero("row_count").alias("row_count"), zero("filled").alias("filled"),
            zero("n").alias("distinct_count"),
        )

    def overlap(self, base: Column | str, current: Column | str) -> DataFrame:
        """Values in either set of parts: ``column_name, base_count, current_count, both_count, base_only, current_only``."""
        base, current = (F.expr(c) if isinstance(c, str) else c for c in (base, current))
        either = self.bitmaps().filter(base | current)

        def size(condition: Column) -> Column:
            return F.bitmap_count(F.bitmap_or_agg(F.when(condition, F.col("bitmap"))))

        sizes = either.groupBy("column", "bucket").agg(
            size(base).alias("b"), size(current).alias("c"), size(base | current).alias("e")
        )
        total = sizes.groupBy("column").agg(*[F.sum(n).alias(n) for n in "bce"])
        joined = self.facts().select("column").distinct().join(total, "column", "left").fillna(0, list("bce"))
        return joined.select(
            F.col("column").alias("column_name"), F.col("b").alias("base_count"), F.col("c").alias("current_count"),
            (F.col("b") + F.col("c") - F.col("e")).alias("both_count"), (F.col("e") - F.col("c")).alias("base_only"),
            (F.col("e") - F.col("b")).alias("current_only"),
        )


def encode(df: DataFrame, part: Column | None = None, columns: Sequence[str] | None = None, path: str | None = None) -> Codes:
    """Describe a table below ``path`` (by default a folder that goes with the session); ``part`` as text names a row's part."""
    names = [n for n in select_ignoring_case(df, columns) if countable(df.schema[n].dataType)]
    if not names:
        raise ComparisonError("No column has values to count")
    path = path or shared_path(df.sparkSession, "codes")
    _describe(df, part, dict(zip(names, names)), path, None, 0)
    return Codes(df.sparkSession, path)


def _describe(df: DataFrame, part: Column | None, names: dict[str, str], path: str, known: DataFrame | None, last: int) -> None:
    """``names`` maps each stored column name to that of ``df``; codes go on after ``last``."""
    spark = df.sparkSession
    key = (F.lit("") if part is None else part).cast("string").alias(PART)
    counts = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names.values())]
    filled = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *counts), "filled")
    each = [F.struct(F.lit(n).alias("column"), "rows", F.col(f"n{i}").alias("filled")) for i, n in enumerate(names)]
    facts = filled.select(PART, F.inline(F.array(*each)))
    # Every column has a row, also where the table has none.
    none = spark.createDataFrame([(n,) for n in names], "column string").select(
        F.lit(None).cast("string").alias(PART), "column", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("filled")
    )
    # Parts are numbered, so that a value has one row for 64 of them: their chunk, and a bit for each.
    place = F.col(POSITION) - 1
    parts = number_rows(filled.select(PART), PART).select(
        PART, F.floor(place / _BITS).cast("int").alias("chunk"), F.expr(f"shiftleft(1L, cast(({POSITION} - 1) % {_BITS} as int))").alias("bit")
    )
    parts, number = cut(parts, "parts"), filled.count()
    parts = F.broadcast(parts) if number <= _BROADCAST_PARTS else parts
    pairs = cut(_values(df.select(key, *[_raw(df, c).alias(f"v{i}") for i, c in enumerate(names.values())]), list(names), parts), "pairs")
    met = None
    if known is not None:
        pairs = cut(pairs.join(known, ["column", "value"], "left"), "known")
        pairs, met = pairs.filter("code is null").drop("code"), pairs.filter("code is not null")
    one = F.struct("chunk", "mask")
    if number <= _BITS:
        values = pairs.select("column", "value", F.array(one).alias("masks"))
    else:
        # In the order of the codes, so that rows are brought together once for both.
        order = [F.col(c).asc_nulls_last() for c in ("column", "value")]
        values = pairs.repartitionByRange(*order).groupBy("column", "value").agg(F.collect_list(one).alias("masks"))
    coded = number_rows(values, ["column", "value"]).withColumn("code", (F.col(POSITION) + last).cast("long"))
    coded.select("column", "value", "code").write.mode("append").parquet(f"{path}/dictionary")
    placed = coded.select("column", "code", F.inline("masks"))
    if met is not None:
        placed = placed.unionByName(met.select("column", "code", "chunk", "mask"))
    placed = placed.join(parts, "chunk").filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    placed = placed.select(PART, "column", F.bitmap_bucket_number("code").alias("bucket"), F.bitmap_bit_position("code").alias("bit"))
    # Codes meet by bucket before they become bitmaps: a bitmap per bucket and task would outweigh the codes.
    by_bucket = placed.repartition(PART, "column", "bucket").groupBy(PART, "column", "bucket")
    by_bucket.agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode("append").parquet(f"{path}/bitmaps")
    facts.unionByName(none).write.mode("append").parquet(f"{path}/facts")


def _raw(df: DataFrame, name: str) -> Column:
    """A value as it is grouped: of a plain type as it is (whole numbers as one type), else as its text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return col(name).cast("long")
    return col(name) if isinstance(dtype, _PLAIN) else value_text(col(name), dtype)


def _values(df: DataFrame, names: list[str], parts: DataFrame) -> DataFrame:
    """``column, value, chunk, mask``: the distinct values of ``v0, v1, ...`` with the parts that hold them, NULLs left out.

    A cell has a field for each type among the columns, so that values are grouped as they are and only distinct ones become texts.
    """
    types = [df.schema[f"v{i}"].dataType for i in range(len(names))]
    slots = {t: f"s{i}" for i, t in enumerate(dict.fromkeys(types))}
    cells = [
        F.struct(F.lit(i).alias("at"), *[(F.col(f"v{i}") if t == own else F.lit(None).cast(t)).alias(s) for t, s in slots.items()])
        for i, own in enumerate(types)
    ]
    numbered = df.join(parts.withColumnRenamed(PART, "__part"), F.col(PART).eqNullSafe(F.col("__part")))
    stacked = numbered.select("chunk", "bit", F.inline(F.array(*cells))).filter(reduce(Column.__or__, [F.col(s).isNotNull() for s in slots.values()]))
    grouped = stacked.groupBy("at", *slots.values(), "chunk").agg(F.bit_or("bit").alias("mask"))
    text = F.coalesce(*[F.col(s) if isinstance(t, T.StringType) else value_text(F.col(s), t) for t, s in slots.items()])
    return grouped.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("column"), text.alias("value"), "chunk", "mask")
