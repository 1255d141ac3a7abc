"""Near duplicates by Order MinHash: sketches of shingles in text order, verified by banded alignment.

Texts are sequences of shingles of five words (lower case, letters and digits). Their similarity is that of an alignment:
aligned shingles over all different ones, ``aligned / (n + m - aligned)``. It is at most the Jaccard similarity and, unlike
it, falls when passages change places. Documents with a similarity of 0.8 or more are linked; classes are the connected
components of the links.

1. Texts with the same words are one class from the start; one of them stands for all.
2. A sketch takes the four smallest of the shingles under one random order, each shingle labelled with its occurrence, and
   keeps them in text order (Marçais et al., 2019). Two texts of similarity 0.8 share a given sketch with probability of
   about 0.41, so that 24 sketches miss three such pairs in a million. Texts with few shingles, for which drawing
   without replacement makes this worse, have 24 more sketches of two.
3. In every bucket of equal sketches all texts meet one leader, the same one across buckets where possible, and the few
   others of a random part of the bucket. Links make components. Then every pair of a bucket that is still in different
   components meets as well. So no candidate pair is left out, and a bucket of one large group costs a few
   comparisons per member.
4. Pairs that meet are first compared by the parities of their shingles: 1024 bits, of which every shingle that only one of
   the two has flips one. More different bits than a similarity of 0.8 allows different shingles rule a pair out for certain.
5. The alignment of what is left is the longest common subsequence inside the band that a similarity of 0.8 allows, computed
   bit-parallel.

Defined results: texts without words are equal if the whole texts are; a null text is an empty one; texts with one to four
words have one shingle; rows of the same id keep their own entry; the class is named by its smallest id (null ids last), and
the row that stays is one with that id. An empty table yields no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sidewise.llm.common import held_by, only, slices
from sidewise.llm.components import components
from sidewise.plans.storage import cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SKETCHES, SKETCH_SIZE = 24, 4
# Texts with up to this many shingles have sketches of two as well; a partner of one with 16 has 20 at most.
FEW_SHINGLES, FEW_SIZE = 20, 2
PARITY_BITS = 1024
# Members of a random part of a bucket, about.
PART = 3
BATCH_BYTES = 8 << 20
_CACHED_WORDS = 150_000
_CACHED_SEQUENCES = 16

_find_words = re.compile(r"[^\W_]+").findall
_STREAM = np.random.Generator(np.random.PCG64(20190714))
_WEIGHTS = _STREAM.integers(1, 1 << 63, max(SHINGLE_WORDS, SKETCH_SIZE), dtype=np.uint64) | np.uint64(1)
_FACTORS = _STREAM.integers(1, 1 << 63, (SKETCHES, 1), dtype=np.uint64) | np.uint64(1)
_SHIFTS = _STREAM.integers(1, 1 << 63, (SKETCHES, 1), dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found




def words_of(text: str) -> list[str]:
    return _find_words(text.lower())


def shingles(words: list[str]) -> np.ndarray:
    """64-bit hashes of the shingles in text order; one shingle if there are fewer words than a shingle has."""
    known = held_by("word hashes", _WordHashes)
    values = np.array([known[word] for word in words], np.uint64)
    if len(values) < SHINGLE_WORDS:
        values = np.concatenate([values, np.zeros(SHINGLE_WORDS - len(values), np.uint64)])
    n = len(values) - SHINGLE_WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE_WORDS):
        total += values[i : i + n] * _WEIGHTS[i]
    return _mixed(total)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labelled_shingles(values: np.ndarray) -> np.ndarray:
    """Shingle hashes, those of repetitions combined with how often the shingle has occurred before.

    First occurrences keep their hash, so that a text shares them with a copy whether or not either repeats anything.
    """
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return values
    places = np.arange(len(values))
    seen = places - np.maximum.accumulate(np.where(new, places, 0))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = seen
    return np.where(occurrence > 0, _mixed(values + occurrence * np.uint64(0xD1B54A32D192ED03)), values)


def parities(labelled: np.ndarray) -> list[int]:
    """For each of the bits, whether an odd number of labelled shingles falls on it, as 64-bit numbers."""
    odd = np.bincount((labelled >> np.uint64(11)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sketches(labelled: np.ndarray) -> list[int]:
    """One 64-bit hash per sketch of labelled shingles, different for different sketches."""
    values = labelled
    drawn = _mixed(labelled[None, :] * _FACTORS + _SHIFTS)
    found = []
    for size, tag in ((SKETCH_SIZE, 0), (FEW_SIZE, SKETCHES)):
        if tag and len(values) > FEW_SHINGLES:
            break
        size = min(size, len(values))
        places = np.argpartition(drawn, size - 1, axis=1)[:, :size] if size < len(values) else (
            np.broadcast_to(np.arange(size), (SKETCHES, size))
        )
        chosen = labelled[np.sort(places, axis=1)]
        total = (chosen * _WEIGHTS[:size]).sum(axis=1, dtype=np.uint64)
        found.append(_mixed(total + np.arange(tag, tag + SKETCHES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return np.concatenate(found).view(np.int64).tolist()


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of which no pair is more than ``band`` places apart."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    common = first + last
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return common
    places: dict[int, int] = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | 1 << j
    # Bit j is 0 where the common length grows at place j of b.
    full = state = (1 << len(b)) - 1
    window = (1 << (2 * band + 1)) - 1
    for i, value in enumerate(a):
        match = places.get(value)
        if match is None:
            continue
        match &= window << (i - band) if i >= band else window >> (band - i)
        if match:
            hit = state & match
            state = ((state + hit) | (state - hit)) & full
    return common + len(b) - state.bit_count()


def similar(a: list[int], b: list[int], least: float = SIMILARITY) -> bool:
    """Whether two shingle sequences have at least the similarity."""
    n, m = len(a), len(b)
    # aligned / (n + m - aligned) >= least
    needed = least * (n + m) / (1 + least)
    if min(n, m) < needed - 1e-9:
        return False
    band = int(n + m - 2 * needed + 1e-9)
    return aligned(a, b, band) >= needed - 1e-9


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row, doc_id, class_id, class_size, kept`` for every row; ``row`` numbers the rows of ``docs`` as they are read."""
    return _classes(_sketched(docs, id_column, text_column, []))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    rows = _sketched(docs, id_column, text_column, docs.columns)
    kept = _classes(rows).filter("kept").select(F.col("row").alias("kept_row"))
    return rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi").select(
        *[F.col("text" if name == text_column else f"c{i}").alias(name) for i, name in enumerate(docs.columns)]
    )


def _sketched(docs: DataFrame, id_column: str, text_column: str, carry: list[str]) -> DataFrame:
    """``row, id, text, words_key, n, sketches, odd[, c0, ...]``, stored."""
    others = {f"c{i}": name for i, name in enumerate(carry) if name != text_column}
    rows = only(docs, id=id_column, text=text_column, **others).withColumn("row", F.monotonically_increasing_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            keys, counts, drawn, odd = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                key = "\n".join(words) if words else "\0" + (text or "")
                keys.append(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                values = labelled_shingles(shingles(words)) if words else ()
                counts.append(len(values))
                drawn.append(sketches(values) if words else [])
                odd.append(parities(values) if words else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(drawn, pa.list_(pa.int64())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                [*batch.schema.names, "words_key", "n", "sketches", "odd"],
            )

    return cut(rows.mapInArrow(run, f"{fields}, words_key binary, n long, sketches array<long>, odd array<long>"), "sketched")


def _classes(rows: DataFrame) -> DataFrame:
    same = rows.groupBy("words_key").agg(F.min("row").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    same = cut(same, "same-words")
    texts = rows.select("row", "sketches").join(same.select("text_id"), F.col("row") == F.col("text_id"))
    members = cut(_shared_buckets(texts), "buckets")
    needed = members.select(F.col("text_id").alias("needed")).distinct()
    bodies = cut(
        rows.select(F.col("row").alias("body_id"), "text", "odd", F.col("n").alias("body_n"))
        .join(needed, F.col("body_id") == F.col("needed"))
        .drop("needed"),
        "bodies",
    )
    stars = members.filter("text_id != leader").select(F.col("leader").alias("a"), F.col("text_id").alias("b")).distinct()
    first = cut(_verified(stars.unionByName(_parts(members, bodies)).distinct(), bodies), "links")
    second = cut(_verified(_across(members, components(first), bodies), bodies), "links")
    found = components(first.unionByName(second))
    named = (
        same.join(found, F.col("text_id") == F.col("node"), "left")
        .select("words_key", F.coalesce("component", "text_id").alias("component"))
    )
    placed = cut(
        rows.select("row", F.col("id").alias("doc_id"), F.col("words_key").alias("key"))
        .join(named, F.col("key") == F.col("words_key"))
        .select("row", "doc_id", "component"),
        "classes",
    )
    classes = placed.groupBy(F.col("component").alias("c")).agg(
        F.min("doc_id").alias("class_id"),
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("stays"),
    )
    return placed.join(classes, F.col("component") == F.col("c")).select(
        "row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("stays.row")).alias("kept")
    )


def _shared_buckets(texts: DataFrame) -> DataFrame:
    """``bucket, text_id, texts, leader`` of all buckets with several texts."""
    drawn = texts.select("text_id", F.explode("sketches").alias("bucket"))
    # The same random order everywhere: a group has mostly the same leader in all its buckets.
    lead = F.min(F.struct(F.xxhash64("text_id").alias("order"), F.col("text_id").alias("leader")))
    shared = (
        drawn.groupBy(F.col("bucket").alias("shared")).agg(F.count(F.lit(1)).alias("texts"), lead.alias("lead"))
        .filter("texts > 1")
        .select("shared", "texts", "lead.leader")
    )
    return drawn.join(shared, F.col("bucket") == F.col("shared")).drop("shared")


def _may_be_similar(n: str, m: str, odd: str, other: str) -> Column:
    """False only for texts that cannot be similar: by their lengths, or by the parities of their shingles."""
    lengths = F.least(n, m) >= F.greatest(n, m) * SIMILARITY - 1e-9
    different = sum(
        (F.bit_count(F.col(odd)[i].bitwiseXOR(F.col(other)[i])) for i in range(1, PARITY_BITS // 64)),
        F.bit_count(F.col(odd)[0].bitwiseXOR(F.col(other)[0])),
    )
    return lengths & (different <= (F.col(n) + F.col(m)) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)


def _with_parities(members: DataFrame, bodies: DataFrame) -> DataFrame:
    known = bodies.select("body_id", "odd", F.col("body_n").alias("n"))
    return members.join(known, F.col("text_id") == F.col("body_id")).drop("body_id")


def _renamed(members: DataFrame, *names: str) -> DataFrame:
    return members.select(*[F.col(name).alias(f"other_{name}") for name in names])


def _parts(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: pairs that fall into the same random part of a bucket and may be similar. Small buckets are one part."""
    part = F.pmod(F.xxhash64("text_id", "bucket"), F.ceil(F.col("texts") / F.lit(PART)))
    dealt = _with_parities(members, bodies).select("bucket", part.alias("part"), "text_id", "n", "odd")
    others = _renamed(dealt, *dealt.columns)
    pairs = dealt.join(
        others,
        (F.col("bucket") == F.col("other_bucket"))
        & (F.col("part") == F.col("other_part"))
        & (F.col("text_id") < F.col("other_text_id"))
        & _may_be_similar("n", "other_n", "odd", "other_odd"),
    )
    return pairs.select(F.col("text_id").alias("a"), F.col("other_text_id").alias("b")).distinct()


def _across(members: DataFrame, found: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: pairs of a bucket that are in different components and may be similar.

    The members outside a bucket's largest component meet all its members; two of them meet once.
    """
    labelled = cut(
        members.join(found, F.col("text_id") == F.col("node"), "left").select(
            "bucket", "text_id", F.coalesce("component", "text_id").alias("label")
        ),
        "labelled",
    )
    parts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        parts.groupBy(F.col("bucket").alias("mixed")).agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", "size").alias("main"))
        .filter("labels > 1")
        .drop("labels")
    )
    inside = _with_parities(labelled.join(mixed, F.col("bucket") == F.col("mixed")).drop("mixed"), bodies)
    others = _renamed(inside.filter("label != main"), "bucket", "text_id", "n", "odd", "label")
    pairs = inside.join(
        others,
        (F.col("bucket") == F.col("other_bucket"))
        & (F.col("label") != F.col("other_label"))
        & ((F.col("label") == F.col("main")) | (F.col("text_id") < F.col("other_text_id")))
        & _may_be_similar("n", "other_n", "odd", "other_odd"),
    )
    return pairs.select(
        F.least("text_id", "other_text_id").alias("a"), F.greatest("text_id", "other_text_id").alias("b")
    ).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose texts are similar."""
    left, right = (
        bodies.select(*[F.col(c).alias(f"{name}_{side}") for c, name in (("body_id", "id"), ("text", "text"), ("body_n", "n"), ("odd", "odd"))])
        for side in ("a", "b")
    )
    short = left.select("id_a", "n_a", "odd_a"), right.select("id_b", "n_b", "odd_b")
    # First without the texts, which only go with the pairs that may be similar.
    possible = (
        pairs.join(short[0], F.col("a") == F.col("id_a")).join(short[1], F.col("b") == F.col("id_b"))
        .filter(_may_be_similar("n_a", "n_b", "odd_a", "odd_b"))
        .select("a", "b")
    )
    possible = cut(possible, "possible")
    both = (
        possible.join(right.select("id_b", "text_b"), F.col("b") == F.col("id_b"))
        .join(left.select("id_a", "text_a"), F.col("a") == F.col("id_a"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=_CACHED_SEQUENCES)
        def sequence(text: str) -> list[int]:
            return shingles(words_of(text)).tolist()

        pairs = (pair for batch in slices(batches, "text_a", BATCH_BYTES) for pair in slices([batch], "text_b", BATCH_BYTES))
        for batch in pairs:
            keep = [
                similar(sequence(a or ""), sequence(b or ""))
                for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name).filter(pa.array(keep, pa.bool_())) for name in ("a", "b")], ["a", "b"]
            )

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
