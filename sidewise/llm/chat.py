"""Chat rendering of logged conversations, without the snapshots that longer logs already contain.

A chat that goes on is often logged again and again, each time from its start. Rolling hashes of the turn prefixes tell
which logged conversation is the beginning of a longer one; anti-joins drop those, and what is left is rendered.

The prefix hash of position p combines the hashes of ``(position, role, text)`` of the turns up to p by exclusive or, in
two independent 64-bit hashes. Turns are numbered and hashed by chunks of their conversation and the chunks are carried
over, so a conversation that holds a third of all turns is not one task's work. All steps are DataFrame operations.

Defined results: turns are ordered by number, then role, then text (nulls first); equal rows of a conversation count once;
a null role or text is kept apart from an empty one when turns are compared and rendered as empty; rows without conversation
id form one conversation of their own; of equal conversations the smallest id stays (a null id last); an empty table
yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sidewise.llm.common import only
from sidewise.plans.storage import cut

CHUNK_TURNS = 64
# The markers of the rendered form.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def maximal_conversations(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, n_turns, copies, rendered``: conversations that begin no longer one, one of equal ones.

    ``copies`` counts the logged conversations that are equal to it, itself included.
    """
    rows = only(turns, conv=id_column, turn=turn_column, role=role_column, text=text_column).distinct()
    chunked = cut(_chunked(rows), "chat-turns")
    prefixes = cut(_prefixes(chunked), "chat-prefixes")
    last = prefixes.filter("last").drop("last")
    whole = ["position", "hash_a", "hash_b"]
    kept = last.groupBy(*whole).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"), F.count("conv").alias("named")
    )
    longer = prefixes.filter(~F.col("last")).select(*whole).distinct()
    maximal = kept.join(longer, whole, "left_anti").select(
        F.when(F.col("named") > 0, F.col("conv")).alias("kept_conv"), F.col("position").alias("n_turns"), "copies"
    )
    parts = chunked.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # Chunks are rendered one by one; a conversation only gathers its finished chunks.
    rendered = (
        parts.select("conv", "chunk", F.array_join(F.transform("t", _render), "").alias("body"))
        .join(maximal, F.col("conv").eqNullSafe(F.col("kept_conv")))
        .groupBy("conv", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "body"))).alias("bodies"))
    )
    return rendered.select(
        F.col("conv").alias("conv_id"), "n_turns", "copies", F.array_join("bodies.body", "").alias("rendered")
    )


def _render(turn: Column) -> Column:
    before, between, after = (F.lit(part) for part in TURN.replace("{role}", "\0").replace("{text}", "\0").split("\0"))
    return F.concat(
        before, F.coalesce(turn["role"], F.lit("")), between, F.coalesce(turn["text"], F.lit("")), after
    )


def _chunked(rows: DataFrame) -> DataFrame:
    """``chunk``: turns of a conversation by number, so that chunks follow each other in the order of turns."""
    return rows.withColumn("chunk", F.floor(F.col("turn") / F.lit(CHUNK_TURNS)))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv, position, hash_a, hash_b, last`` of every turn prefix."""
    chunk = ["conv", "chunk"]
    inside = Window.partitionBy(*chunk).orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    numbered = turns.withColumn("within", F.row_number().over(inside))
    sizes = turns.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(
        F.col("conv").alias("c"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv")).alias("total"),
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))
    hashed = (
        numbered.join(starts, same)
        .withColumn("position", F.col("before") + F.col("within"))
        .select(
            *chunk, "position", "total",
            *[
                F.xxhash64(F.lit(seed), "position", F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(h)
                for h, seed in (("a", 1), ("b", 2))
            ],
        )
    )
    # The hashes are stored: both the prefix inside a chunk and the carry over chunks are taken from them.
    hashed = cut(hashed, "chat-hashes")
    carried = hashed.groupBy(*chunk).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carries = carried.select(
        F.col("conv").alias("c"), F.col("chunk").alias("k"),
        *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"carry_{h}") for h in ("a", "b")],
    )
    up_to = Window.partitionBy(*chunk).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hashed.select("*", *[F.bit_xor(h).over(up_to).alias(f"own_{h}") for h in ("a", "b")])
        .join(carries, same)
        .select(
            "conv", "position",
            *[F.col(f"own_{h}").bitwiseXOR(F.col(f"carry_{h}")).alias(f"hash_{h}") for h in ("a", "b")],
            (F.col("position") == F.col("total")).alias("last"),
        )
    )
