"""Exact duplicates by Grace hashing: partition to spill files until a bucket fits a table that compares whole texts.

1. Every task passes its rows through an open-addressing table first. Copies within a task meet there, so a text that fills
   a third of the corpus leaves each table once. The rows of the tables are spilled: the first of each text with all its
   columns, its copies with their id only.
2. The firsts are partitioned by their text's hash. Buckets that do not fit are partitioned again by further digits of the
   hash, until every bucket fits or holds copies of one text only (which need no more room than that text).
3. One task per run of buckets: the firsts of a bucket go through a table again, which says for each which row stays.
4. Rows find their answer through the first of their table.

Spill files are Parquet tables in the shared folder, so a lost executor costs its running tasks only. Tables compare the
hash and then the whole text; equal hashes of different texts are told apart.

Defined results: a null text equals an empty one. Of equal texts the row with the largest id stays, of rows with equal id
one of them; null ids are the smallest. An empty table yields an empty result. Columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sidewise.llm.common import quoted, slices
from sidewise.plans.storage import cut

TABLE_BYTES = 24 << 20
BATCH_BYTES = 4 << 20
# How many ways a bucket that does not fit is split.
FAN_OUT = 16


class TextTable:
    """An open-addressing table of texts: linear probing by a 64-bit hash, then comparison of the whole text."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.bytes = 0
        self._hashes: list[int] = []
        self._slots = np.full(1 << 10, -1, np.int64).tolist()

    def find(self, text: str, hashed: int) -> tuple[int, bool]:
        """The entry of ``text`` and whether it is new."""
        slots, mask = self._slots, len(self._slots) - 1
        place = hashed & mask
        while (entry := slots[place]) >= 0:
            if self._hashes[entry] == hashed and self.texts[entry] == text:
                return entry, False
            place = (place + 1) & mask
        entry = len(self.texts)
        slots[place] = entry
        self.texts.append(text)
        self._hashes.append(hashed)
        self.bytes += len(text)
        if 2 * len(self.texts) > len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self._slots = [-1] * (2 * len(self._slots))
        mask = len(self._slots) - 1
        for entry, hashed in enumerate(self._hashes):
            place = hashed & mask
            while self._slots[place] >= 0:
                place = (place + 1) & mask
            self._slots[place] = entry


@dataclass(frozen=True)
class ExactDuplicates:
    """``firsts``: spilled rows with all columns. ``decisions``: one row per input row."""

    firsts: DataFrame
    decisions: DataFrame
    columns: tuple[str, ...]
    text: str

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of the input. The row that stays is always the first of its table."""
        stays = self.decisions.filter("kept").select(F.col("row").alias("kept_row"))
        return self.firsts.join(stays, F.col("row") == F.col("kept_row"), "left_semi").select(
            *[F.col("text" if name == self.text else f"c{i}").alias(name) for i, name in enumerate(self.columns)]
        )


def find_exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_bytes: int = TABLE_BYTES,
    carry: bool = True,
) -> ExactDuplicates:
    """``decisions``: ``row, id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``carry=False`` leaves out the columns that only ``kept()`` needs.
    """
    spill = _spill(docs, id_column, text_column, table_bytes, carry)
    firsts = spill.filter(F.col("row") == F.col("first"))
    answers = cut(_resolve(firsts, _bucket(firsts, table_bytes), table_bytes), "grace-answers")
    decisions = spill.select("row", "id", "first").join(answers, "first").select(
        "row", "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return ExactDuplicates(firsts, decisions, tuple(docs.columns), text_column)


def _spill(docs: DataFrame, id_column: str, text_column: str, table_bytes: int, carry: bool) -> DataFrame:
    """``row, first, copies, hash, size, id, text[, c0, c1, ...]``; all but ``row, first, id`` null for copies."""
    others = [f"c{i}" for i, name in enumerate(docs.columns) if carry and name != text_column]
    text = docs[quoted(text_column)]
    rows = docs.select(
        docs[quoted(id_column)].alias("id"),
        text.alias("text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        *[docs[quoted(docs.columns[int(other[1:])])].alias(other) for other in others],
    ).withColumn("row", F.monotonically_increasing_id())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (
        f"row long, first long, copies long, hash long, size long, id {kinds['id']}, text string"
        + "".join(f", {c} {kinds[c]}" for c in others)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = TextTable(), []
        for batch in slices(batches, "text", BATCH_BYTES):
            held.append(batch)
            # The table is emptied between batches only, so its rows leave in order.
            if sum(b.nbytes for b in held) > table_bytes:
                yield from _leave(held, table, others)
                table, held = TextTable(), []
        if held:
            yield from _leave(held, table, others)

    return cut(rows.mapInArrow(run, schema), "grace-spill")


def _leave(held: list[pa.RecordBatch], table: TextTable, others: list[str]) -> Iterator[pa.RecordBatch]:
    """Pass held batches through the table and yield them as spilled rows."""
    entries: list[int] = []
    best: list[int] = []  # by entry, the place of the row with the largest id
    copies: list[int] = []
    ids = [key for batch in held for key in batch.column("id").to_pylist()]
    for batch in held:
        for text, hashed in zip(batch.column("text").to_pylist(), batch.column("hash").to_pylist()):
            entry, new = table.find(text or "", hashed)
            place = len(entries)
            entries.append(entry)
            if new:
                best.append(place)
                copies.append(1)
            else:
                copies[entry] += 1
                if _larger(ids[place], ids[best[entry]]):
                    best[entry] = place
    rows = np.concatenate([batch.column("row").to_numpy() for batch in held])
    entry_of = np.array(entries)
    best_of = np.array(best)[entry_of]
    is_first = best_of == np.arange(len(entry_of))
    start = 0
    for batch in held:
        part = slice(start, start + batch.num_rows)
        start += batch.num_rows
        first = is_first[part]
        # Taken by place, a null for each copy.
        chosen = pa.array(np.arange(batch.num_rows), mask=~first)
        arrays = {
            "row": batch.column("row"),
            "first": pa.array(rows[best_of[part]]),
            "copies": pa.array(np.array(copies)[entry_of[part]], mask=~first),
            "hash": pa.array(batch.column("hash").to_numpy(), mask=~first),
            "size": pa.array(
                pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype("i8"), mask=~first
            ),
            "id": batch.column("id"),
        }
        for name in ("text", *others):
            arrays[name] = batch.column(name).take(chosen)
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _larger(a, b) -> bool:
    return a is not None and (b is None or a > b)


def _bucket(firsts: DataFrame, table_bytes: int) -> Column:
    """The bucket of a first row. Buckets that do not fit are split by more digits of the hash, as often as it takes."""
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    ways = max(1, -(-2 * total // table_bytes))
    bucket = F.pmod(F.col("hash"), F.lit(ways)).cast("string")
    for level in range(12):
        # Only buckets beyond the bound are collected: their number is at most that of all bytes over the bound.
        large = [
            row["bucket"]
            for row in firsts.groupBy(bucket.alias("bucket"))
            .agg(F.sum("size").alias("b"), F.min("hash").alias("low"), F.max("hash").alias("high"))
            .filter((F.col("b") > table_bytes) & (F.col("low") != F.col("high")))
            .collect()
        ]
        if not large:
            break
        digit = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(FAN_OUT))
        bucket = F.when(bucket.isin(large), F.concat_ws(".", bucket, digit.cast("string"))).otherwise(bucket)
    return bucket


def _resolve(firsts: DataFrame, bucket: Column, table_bytes: int) -> DataFrame:
    """``first, keep_row, keep_id, group_size, text_sha256``: bucket after bucket through a table."""
    kind = firsts.schema["id"].dataType.simpleString()
    rows = firsts.select("row", "copies", "hash", "id", "text", bucket.alias("bucket"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table, members = None, TextTable(), []
        for batch in slices(batches, "text", BATCH_BYTES):
            columns = [batch.column(c).to_pylist() for c in ("bucket", "text", "hash", "row", "copies", "id")]
            for bucket, text, hashed, row, copies, key in zip(*columns):
                if bucket != current:
                    if members:
                        yield _answers(table, members)
                    current, table, members = bucket, TextTable(), []
                members.append((table.find(text or "", hashed)[0], row, copies, key))
        if members:
            yield _answers(table, members)

    def _answers(table, members) -> pa.RecordBatch:
        keep: list = [None] * len(table.texts)
        sizes = [0] * len(table.texts)
        for entry, row, copies, key in members:
            sizes[entry] += copies
            if keep[entry] is None or _larger(key, keep[entry][1]):
                keep[entry] = (row, key)
        digests = [sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in table.texts]
        arrays = [
            pa.array([row for _, row, _, _ in members], pa.int64()),
            pa.array([keep[entry][0] for entry, *_ in members], pa.int64()),
            pa.array([keep[entry][1] for entry, *_ in members], id_type),
            pa.array([sizes[entry] for entry, *_ in members], pa.int64()),
            pa.array([digests[entry] for entry, *_ in members], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["first", "keep_row", "keep_id", "group_size", "text_sha256"])

    id_type = to_arrow_type(firsts.schema["id"].dataType)
    return rows.mapInArrow(run, f"first long, keep_row long, keep_id {kind}, group_size long, text_sha256 string")
