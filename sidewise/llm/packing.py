"""Packing documents into as few token sequences as possible: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so the whole instance is a table of counts per size, with at most ``capacity``
rows whatever the corpus holds. The packing is worked out on these counts: a *pattern* says which sizes share a sequence
and how many sequences look like that. Documents then find their place by their rank among the documents of their size,
which Spark computes with one count per partition and size.

1. Reduction (Martello and Toth): for the largest size left, find at most two partners such that this set dominates every
   other set that could share a sequence with it, and fix the set. Some optimal packing contains it, so nothing is lost.
2. Best fit of what is left, largest first, each into the fullest sequence that has room.

Each step of either ends at least one size or one group of equal sequences, so there are at most a few patterns per size.

Defined results: a null text is an empty one; only documents longer than the capacity are cut, the first piece takes the
remainder; rows of the same id are packed each for itself; an empty table yields no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sidewise.llm.common import only, slices, texts_of
from sidewise.llm.encoding import encoder
from sidewise.plans.storage import cut

BATCH_BYTES = 8 << 20


class Pattern(NamedTuple):
    """``bins`` sequences that each hold the given ``(size, how many)`` one after another."""

    content: tuple[tuple[int, int], ...]
    bins: int


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[size]`` items of every size between 1 and ``capacity``."""
    left = Counter({size: count for size, count in counts.items() if count})
    return [*_reduce(left, capacity), *_best_fit(left, capacity)]


def _reduce(left: Counter, capacity: int) -> list[Pattern]:
    """Fix dominating sets and take them out of ``left``."""
    fixed = []
    for size in sorted(left, reverse=True):
        while left[size]:
            chosen = _dominating(left, size, capacity - size)
            if chosen is None:
                break
            content = Counter([size, *chosen])
            # The same argument holds again while all its sizes last: taking items away only shrinks the alternatives.
            bins = min(left[s] // n for s, n in content.items())
            left.subtract({s: n * bins for s, n in content.items()})
            fixed.append(Pattern(tuple(content.items()), bins))
        left += Counter()  # drops what is used up
    return fixed


def _dominating(left: Counter, size: int, room: int) -> list[int] | None:
    """At most two partners of an item of ``size`` that dominate all others which fit into ``room``; None if not known."""
    others = left.copy()
    others[size] -= 1
    sizes = sorted(s for s in others if others[s] > 0 and s <= room)
    if not sizes:
        return []
    largest = sizes[-1]
    smallest = _smallest(others, sizes, 3)
    # A partner that fills the sequence can be exchanged for any set of partners; so can the largest, if one must do.
    if largest == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [largest]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # Two partners at most.
    if _best_pair(others, sizes, room) <= largest:
        return [largest]
    others[largest] -= 1
    second = max((s for s in sizes if others[s] > 0 and s <= room - largest), default=0)
    others[largest] += 1
    if not second:
        return None
    above = _smallest(others, [s for s in sizes if s > second], 2)
    # Every pair has one at most as large as the second, so the largest and the second replace it one for one.
    return [largest, second] if len(above) < 2 or sum(above) > room else None


def _smallest(counts: Counter, sizes: list[int], n: int) -> list[int]:
    found: list[int] = []
    for size in sizes:
        found += [size] * min(counts[size], n - len(found))
        if len(found) == n:
            break
    return found


def _best_pair(counts: Counter, sizes: list[int], room: int) -> int:
    best = 0
    for size in sizes:
        i = bisect_right(sizes, min(room - size, size)) - 1
        if i >= 0 and sizes[i] == size and counts[size] < 2:
            i -= 1
        if i >= 0:
            best = max(best, size + sizes[i])
    return best


def _best_fit(left: Counter, capacity: int) -> list[Pattern]:
    """Best fit, largest first, over groups of equal sequences."""
    groups: dict[int, list[Pattern]] = {}  # by the room left
    rooms: list[int] = []  # those with groups, sorted

    def put(room: int, pattern: Pattern) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append(pattern)

    def take(room: int) -> Pattern:
        pattern = groups[room].pop()
        if not groups[room]:
            del groups[room]
            rooms.remove(room)
        return pattern

    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            i = bisect_left(rooms, size)
            room = rooms[i] if i < len(rooms) else capacity
            each = room // size  # the fullest sequence stays the fullest until nothing of this size fits into it
            content, bins = take(room) if i < len(rooms) else ((), -(-count // each))
            full = min(bins, count // each)
            if full:
                put(room - each * size, Pattern((*content, (size, each)), full))
            count -= full * each
            rest = bins - full
            if rest and count:
                put(room - count * size, Pattern((*content, (size, count)), 1))
                count, rest = 0, rest - 1
            if rest:
                put(room, Pattern(content, rest))
    return [pattern for same in groups.values() for pattern in same]


def encoded_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32[, ids]`` and the place of each piece among those of its length and partition."""
    columns = {
        "id": docs.schema[id_column].dataType.simpleString(), "piece": "int", "start": "long", "length": "int",
        "ids_crc32": "long", "part": "long", "rank": "long",
    } | ({"ids": "array<int>"} if keep_ids else {})
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(tokenizer).ids
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in slices(batches, "text", BATCH_BYTES):
            rows: dict[str, list] = {name: [] for name in columns}
            source, bodies = [], []
            for i, text in enumerate(texts_of(batch, "text")):
                ids = encode(text) + end
                total = len(ids) // 4
                start, length = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    body = ids[4 * start : 4 * (start + length)]
                    source.append(i)
                    bodies.append(body)
                    values = (piece, start, length, zlib.crc32(body), part, seen[length])
                    for name, value in zip(("piece", "start", "length", "ids_crc32", "part", "rank"), values):
                        rows[name].append(value)
                    seen[length] += 1
                    start, length = start + length, capacity
            arrays = {
                "id": batch.column("id").take(pa.array(source, pa.int64())),
                **{name: pa.array(rows[name], pa.int64()) for name in ("start", "ids_crc32", "part", "rank")},
                **{name: pa.array(rows[name], pa.int32()) for name in ("piece", "length")},
            }
            if keep_ids:
                flat = np.frombuffer(b"".join(bodies), "<i4")
                ends = np.cumsum([0, *rows["length"]])
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([arrays[name] for name in columns], list(columns))

    return only(docs, id=id_column, text=text_column).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    ``id, piece, start, length, ids_crc32[, ids], sequence_id, offset``. Sequences are filled gapless from 0. The texts
    are read and encoded once and nothing but the (small) pieces is shuffled; with ``keep_ids`` the ids travel along.
    """
    spark = docs.sparkSession
    pieces = cut(encoded_pieces(docs, tokenizer, end_id, capacity, id_column, text_column, keep_ids), "pieces")
    local = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {row["length"]: row["n"] for row in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(plan(counts, capacity)),
        "slot_length int, low long, high long, first long, each long, before long, size long",
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.select(
        F.col("part").alias("base_part"),
        F.col("length").alias("base_length"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
    )
    ranked = pieces.join(
        bases, (F.col("part") == F.col("base_part")) & (F.col("length") == F.col("base_length"))
    ).withColumn("place", F.col("base") + F.col("rank"))
    # At most a few slots per size up to the capacity, however many documents there are.
    return ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")),
    ).select(
        *["id", "piece", "start", "length", "ids_crc32"],
        *(["ids"] if keep_ids else []),
        (F.col("first") + F.floor((F.col("place") - F.col("low")) / F.col("each"))).alias("sequence_id"),
        (F.col("before") + (F.col("place") - F.col("low")) % F.col("each") * F.col("size")).alias("offset"),
    )


def _slots(patterns: list[Pattern]) -> list[tuple]:
    """Ranks of each size, dealt to the patterns in turn: ``size, low, high, first sequence, items each, tokens before``."""
    used: Counter = Counter()
    rows, first = [], 0
    for content, bins in patterns:
        before = 0
        for size, each in content:
            rows.append((size, used[size], used[size] + each * bins, first, each, before, size))
            used[size] += each * bins
            before += each * size
        first += bins
    return rows
