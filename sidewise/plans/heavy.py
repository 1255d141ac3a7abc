"""The most frequent values of many columns, exactly, without shuffling all values.

1. One scan finds candidates: frequent-items counters (a Misra-Gries summary) of a fixed size for each column.
2. One scan counts the candidates exactly. Every other value is counted with its bucket only (``BUCKETS`` hashes a column), so a task
   sends at most ``columns * (candidates + BUCKETS)`` rows, whatever the table holds.
3. The kth best candidate sets a mark. A value cannot occur more often than its bucket, so buckets below the mark hold no value of the
   answer. Values of the buckets that reach it are counted one by one; there are none where few values are frequent, and most of
   a column is counted so where no value is (keys). ``Heavy.opened`` says how many rows that was.

Only short texts become candidates, so that the broadcast list is bounded by ``columns * TRACKED * SHORT`` characters; longer values
are found through their buckets. Candidates and buckets affect the cost alone, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sidewise.plans.storage import cut

BUCKETS, SHORT = 4096, 64
# Counters of the summary for each value asked for, and the least and most of them.
COUNTERS, FEWEST, MOST = 8, 256, 10_000


@dataclass(frozen=True)
class Heavy:
    """``values``: ``column, category, base_count, curr_count, place``; ``totals``: ``column`` and rows and non-NULL rows of each side.

    ``opened`` rows of buckets were counted value by value, of ``cells`` rows of all columns.
    """

    values: DataFrame
    totals: DataFrame
    opened: int
    cells: int


def heavy_values(rows: DataFrame, columns: Sequence[str], in_base: Column, k: int, buckets: int = BUCKETS) -> Heavy:
    """The ``k`` values of each column (as text) most frequent where ``in_base`` is false, then where it is true, then by name.

    NULLs are left out of the values. An empty table has neither values nor totals.
    """
    numbers = {i: name for i, name in enumerate(columns)}
    sided = rows.select(in_base.alias("b"), *[F.col(f"`{name.replace('`', '``')}`").cast("string").alias(f"v{i}") for i, name in numbers.items()])
    counters = min(max(COUNTERS * k, FEWEST), MOST)
    candidates = cut(_candidates(sided, len(columns), min(4 * k, counters), counters), "candidates")

    def cells(wanted: Sequence[int]) -> DataFrame:
        """``b, c, category, hash, bucket`` of the columns ``wanted``; NULLs have neither hash nor bucket."""
        parts = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("category")) for i in wanted]))
        hashed = F.when(F.col("category").isNotNull(), _hash())
        return sided.select("b", parts).select("b", "c", "category", hashed.alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))

    counts = [F.count_if("b").alias("base_count"), F.count_if(~F.col("b")).alias("curr_count")]
    # Candidates are looked up by one number, and cells are counted by two: a candidate's place follows the buckets.
    known = candidates.select(_hash().alias("hash"), F.col("category").alias("candidate"), "slot").dropDuplicates(["hash"])
    place = F.when(F.col("candidate") == F.col("category"), F.col("slot") + buckets).otherwise(F.col("bucket"))
    placed = cells(list(numbers)).join(F.broadcast(known), "hash", "left").select("b", "c", place.alias("place"))
    counted = cut(placed.groupBy("c", "place").agg(*counts), "buckets")
    found = (
        counted.withColumn("slot", F.col("place") - buckets)
        .join(F.broadcast(candidates), ["c", "slot"])
        .select("c", "category", "base_count", "curr_count")
    )
    mark = F.coalesce(F.get(F.sort_array(F.collect_list("curr_count"), asc=False), F.lit(k - 1)), F.lit(0))
    marks = counted.filter(F.col("place") >= buckets).groupBy("c").agg(mark.alias("mark"))
    # A column without candidates opens all its buckets.
    others = counted.filter(F.col("place") < buckets).join(F.broadcast(marks), "c", "left")
    opened = others.filter(F.col("curr_count") >= F.coalesce("mark", F.lit(0)))
    # One row per column.
    rows_of = {r["c"]: r["n"] for r in opened.groupBy("c").agg(F.sum(F.col("base_count") + F.col("curr_count")).alias("n")).collect()}
    size = sum(rows_of.values())
    if size:
        # Only the columns that have such buckets; at most columns * BUCKETS rows of two numbers.
        few = F.broadcast(opened.select("c", F.col("place").alias("bucket")))
        inside = cells(sorted(rows_of)).join(few, ["c", "bucket"]).groupBy("c", "category").agg(*counts)
        # Candidates of these buckets are counted already.
        found = found.unionByName(inside.join(F.broadcast(found.select("c", "category")), ["c", "category"], "left_anti"))
    best = Window.partitionBy("c").orderBy(F.desc("curr_count"), F.desc("base_count"), "category")
    ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    # NULLs have no place.
    filled = F.col("place").isNotNull()
    totals = counted.groupBy("c").agg(
        *[
            F.coalesce(F.sum(F.when(condition, F.col(f"{side}_count"))), F.lit(0)).alias(f"{side}_{kind}")
            for side in ("base", "curr")
            for kind, condition in (("total", F.lit(True)), ("valids", filled))
        ]
    )
    label = F.element_at(F.create_map(*[F.lit(x) for i, name in numbers.items() for x in (i, name)]), F.col("c")).alias("column")
    values = ranked.select(label, "category", "base_count", "curr_count", "place")
    totals = totals.select(label, "base_total", "base_valids", "curr_total", "curr_valids")
    all_cells = counted.agg(F.coalesce(F.sum(F.col("base_count") + F.col("curr_count")), F.lit(0))).first()[0]
    return Heavy(values, totals, size, all_cells)


def _hash() -> Column:
    """Of a column's number and a value."""
    return F.xxhash64("c", "category")


def _candidates(sided: DataFrame, columns: int, wanted: int, counters: int) -> DataFrame:
    """``c, slot, category``: the most frequent short values of each column where ``b`` is false, as far as the summaries know."""
    short = [F.when(F.char_length(f"v{i}") <= SHORT, F.col(f"v{i}")) for i in range(columns)]
    tops = [F.call_function("approx_top_k", v, F.lit(wanted), F.lit(counters)).alias(f"t{i}") for i, v in enumerate(short)]
    found = sided.filter(~F.col("b")).agg(*tops)
    lists = [F.struct(F.lit(i).alias("c"), F.col(f"t{i}").alias("items")) for i in range(columns)]
    items = found.select(F.inline(F.array(*lists))).select("c", F.posexplode("items").alias("slot", "found"))
    return items.select("c", "slot", F.col("found.item").alias("category")).filter("category is not null")
