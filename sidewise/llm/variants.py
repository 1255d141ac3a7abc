"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Comparing all words with each other would be quadratic. Instead every word generates its own neighbourhood: the words that
come from it by deleting a code point or by replacing one with a larger one of the corpus's alphabet (insertions and the other
replacements are the same links seen from the other word). Few of them are words of the corpus, so they are probed first:

1. The words are hashed by position and letter, so that the hash of an edited word follows from the word's own in a few steps.
   They fill blocked Bloom filters, one per word length, built in parallel by ranges of blocks.
2. The filters are broadcast and every neighbourhood is probed against the filter of its length. Only positives become rows.
3. Positives meet the vocabulary in an exact join, which removes the false ones.

The broadcast never exceeds ``FILTER_BYTES``: a larger vocabulary is dealt into parts by hash, each with filters and a probing
pass of its own, and the links of all parts are united.

A word's *form* is its near word of largest count if that is ``ratio`` times the word's own; forms are followed to the *root*
by pointer doubling (counts grow by ``ratio`` at each step, so the number of rounds is known beforehand).

Defined results: null texts have no words; null ids count as empty in the planted deletions; words are told apart by code
points; ties between forms go to the smallest word in code-point order; words without near words have ``n_near`` 0 and are their
own root; repeated words of a word table are added up, null and empty words and words without count are left out; long texts are
read in pieces cut between words and very long words probed in pieces, so that memory stays bounded; an empty table yields no
rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sidewise.llm.common import only, slices
from sidewise.plans.storage import cut

# Letters as the word pattern has them, A to Z lower-cased before.
_LETTERS = "a-zÀ-ÿ"
BATCH_BYTES, PIECE = 6 << 20, 1 << 20
HELD_WORDS, READ_CHARS = 200_000, 64 << 20
FILTER_BYTES = 32 << 20
# A block is a cache line: eight words of 64 bits, in each of which a key sets one bit.
BLOCK_WORDS, BITS_PER_KEY = 8, 24
RANGE_BLOCKS = 1 << 14
# Edited words hashed at once.
PROBES = 1 << 19
_EXACT_LENGTHS = 64


def corpus_words(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = 7,
    least_count: int = 2,
    typo_every: int | None = None,
) -> DataFrame:
    """``word, n``: the words of all texts, by length in code points and number of occurrences.

    With ``typo_every`` misspellings are planted: where it divides the crc32 of ``<id>:<word>``, the word loses a code point.
    """
    rows = only(docs, id=id_column, text=text_column).filter("text is not null")
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    find = re.compile(f"[{_LETTERS}]{{{least_length},}}").findall
    gap = re.compile(f"[^{_LETTERS}]")

    def table_of(total: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        read = 0
        for batch in slices(batches, "text", BATCH_BYTES):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                # On bytes, lower-casing leaves everything but A to Z alone.
                lower = text.encode().lower().decode()
                begun = zlib.crc32(f"{key}:".encode())
                for piece in _between_words(lower, gap):
                    own = Counter(find(piece))
                    if typo_every:
                        own = _misspelt(own, begun, typo_every, least_length)
                    total.update(own)
                    read += len(piece)
                    # What is held is no longer than what was read.
                    if len(total) > HELD_WORDS or read > READ_CHARS:
                        yield table_of(total)
                        total, read = Counter(), 0
        if total:
            yield table_of(total)

    # Tasks have counted already, so words are dealt once. A number of partitions of its own keeps the small table spread.
    ways = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.mapInArrow(run, "word string, n long").repartition(ways, "word").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _between_words(text: str, gap: re.Pattern) -> Iterator[str]:
    """A text in pieces that end where no word does."""
    start = 0
    while len(text) - start > PIECE:
        found = gap.search(text, start + PIECE)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _misspelt(words: Counter[str], begun: int, every: int, least_length: int) -> Counter[str]:
    changed: Counter[str] = Counter()
    for word, count in words.items():
        drawn = zlib.crc32(word.encode(), begun)
        if drawn % every == 0:
            at = drawn % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least_length:
                continue
        changed[word] += count
    return changed


def spelling_variants(words: DataFrame, ratio: int = 10, word_column: str = "word", count_column: str = "n") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of a word table."""
    if ratio < 2:
        raise ValueError("Counts must grow along forms: the ratio is 2 or more")
    rows = only(words, word=word_column, n=count_column).filter("word != ''")
    return _variants(rows.groupBy("word").agg(F.sum("n").cast("long").alias("n")).filter("n > 0"), ratio)


def variants_of_corpus(docs: DataFrame, ratio: int = 10, **how) -> DataFrame:
    """Spelling variants of the words of all texts; ``how`` goes to ``corpus_words``."""
    return _variants(corpus_words(docs, **how), ratio)


def _variants(words: DataFrame, ratio: int) -> DataFrame:
    words = cut(words.select("word", "n"), "words")
    # Both directions of a link in one row each, without a second join.
    end = lambda w, n, other, m: F.struct(F.col(w).alias("word"), F.col(other).alias("near"), F.col(m).alias("m"))
    links = near_words(words).select(
        F.explode(F.array(end("word", "n", "near", "near_n"), end("near", "near_n", "word", "n"))).alias("link")
    )
    # The smallest pair of negated count and word: largest count first, then code-point order.
    best = F.min(F.struct((-F.col("link.m")).alias("m"), F.col("link.near").alias("near")))
    nearest = links.groupBy(F.col("link.word").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(nearest, "word", "left")
    usual = -F.col("best.m") >= ratio * F.col("n")
    formed = cut(
        joined.select(
            "word",
            F.when(usual, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(usual, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed, ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` of all words with a form. Few words share a form: a neighbourhood is bounded by its word's length."""
    steps = formed.filter("form is not null")
    bounds = steps.agg(F.min("n").alias("least"), F.max("form_n").alias("most")).first()
    reached = cut(steps.select("word", F.col("form").alias("root")), "roots")
    longest, count = 0, bounds["least"] or 1
    while count * ratio <= (bounds["most"] or 0):
        longest, count = longest + 1, count * ratio
    covered = 1
    while covered < longest:
        onward = reached.select(F.col("word").alias("via"), F.col("root").alias("onward"))
        reached = cut(
            reached.join(onward, F.col("root") == F.col("via"), "left").select(
                "word", F.coalesce("onward", "root").alias("root")
            ),
            "roots",
        )
        covered *= 2
    return reached


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of words one edit apart, once. ``words`` holds distinct ``word`` with ``n``."""
    spark = words.sparkSession
    # One row per length class and one per letter; their number does not grow with the table.
    sizes = {
        row["shard"]: row["count"]
        for row in words.groupBy(_shard_column(F.char_length("word")).alias("shard")).count().collect()
    }
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''").distinct().collect()
    alphabet = np.sort(np.array([ord(row["letter"]) for row in letters], np.uint32))
    parts = max(1, -(-sum(sizes.values()) * BITS_PER_KEY // (8 * FILTER_BYTES)))
    blocks = {shard: max(1, -(-count * BITS_PER_KEY // (64 * BLOCK_WORDS * parts))) for shard, count in sizes.items()}
    stored = cut(_filters(words, blocks, parts), "filters")
    positives = None
    for part in range(parts):
        filters = {shard: np.zeros((count, BLOCK_WORDS), np.uint64) for shard, count in blocks.items()}
        # As large as FILTER_BYTES and a block per length class at most.
        for row in stored.filter(F.col("part") == part).toLocalIterator():
            bits = np.frombuffer(row["bits"], "<u8").reshape(-1, BLOCK_WORDS)
            start = row["range"] * RANGE_BLOCKS
            filters[row["shard"]][start : start + len(bits)] = bits
        sent = spark.sparkContext.broadcast(filters)
        found = words.mapInArrow(_probing(sent, alphabet, part, parts), "word string, n long, near string")
        positives = found if positives is None else positives.unionByName(found)
    known = words.select(F.col("word").alias("known"), F.col("n").alias("near_n"))
    return positives.join(known, F.col("near") == F.col("known")).select("word", "n", "near", "near_n")


def _shard_column(length):
    """Word lengths have filters of their own up to a bound; longer ones share one per power of two."""
    return F.when(length <= _EXACT_LENGTHS, length).otherwise(_EXACT_LENGTHS + F.length(F.bin(length))).cast("int")


def _shard(length: int) -> int:
    return length if length <= _EXACT_LENGTHS else _EXACT_LENGTHS + length.bit_length()


# The constants of the splitmix64 finaliser.
_STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in _STEPS:
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def _letter_hashes(positions: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A random value for every letter at every position; a word's hash is the exclusive or over its letters."""
    return _mixed((positions.astype(np.uint64) << np.uint64(21)) | codes.astype(np.uint64))


def _places(hashes: np.ndarray, count: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, bits within the block (six per word) and part of hashes."""
    block = ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    bits = _mixed(hashes)
    part = (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts) if parts > 1 else np.zeros(len(hashes), np.uint64)
    return block, bits, part


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points (one row per word) of the words of each length."""
    lengths = pc.utf8_length(words).to_numpy()
    for length in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == length)
        joined = "".join(words.take(pa.array(where)).to_pylist())
        yield where, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(-1, length)


def _filters(words: DataFrame, blocks: dict[int, int], parts: int) -> DataFrame:
    """``part, shard, range, bits``: the filters in ranges of blocks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", BATCH_BYTES):
            for _, codes in _by_length(batch.column("word")):
                shard = _shard(codes.shape[1])
                whole = np.bitwise_xor.reduce(_letter_hashes(np.arange(codes.shape[1]), codes), axis=1)
                block, bits, part = _places(whole, blocks[shard], parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.astype(np.int32)), pa.array(np.full(len(whole), shard, np.int32)),
                        pa.array((block // np.uint64(RANGE_BLOCKS)).astype(np.int32)),
                        pa.array((block % np.uint64(RANGE_BLOCKS)).astype(np.int32)), pa.array(bits.view(np.int64)),
                    ],
                    ["part", "shard", "range", "block", "bits"],
                )

    def filled(key: tuple, rows: pa.Table) -> pa.Table:
        part, shard, at = (x.as_py() for x in key)
        bits = np.zeros((min(RANGE_BLOCKS, blocks[shard] - at * RANGE_BLOCKS), BLOCK_WORDS), np.uint64)
        block, drawn = rows.column("block").to_numpy(), rows.column("bits").to_numpy().view(np.uint64)
        for i in range(BLOCK_WORDS):
            np.bitwise_or.at(bits[:, i], block, _bit(drawn, i))
        return pa.table(
            {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "range": pa.array([at], pa.int32()),
             "bits": pa.array([bits.astype("<u8").tobytes()], pa.binary())}
        )

    rows = words.select("word").mapInArrow(hashed, "part int, shard int, range int, block int, bits long")
    return rows.groupBy("part", "shard", "range").applyInArrow(filled, "part int, shard int, range int, bits binary")


def _bit(bits: np.ndarray, word: int) -> np.ndarray:
    return np.uint64(1) << ((bits >> np.uint64(6 * word)) & np.uint64(63))


def _hits(filters: np.ndarray, hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Places of the hashes that a filter may hold."""
    block, bits, own = _places(hashes, len(filters), parts)
    alive = np.flatnonzero(own == part) if parts > 1 else np.arange(len(hashes))
    for i in range(BLOCK_WORDS):
        alive = alive[(filters[block[alive], i] & _bit(bits[alive], i)) != 0]
    return alive


def _probing(sent, alphabet: np.ndarray, part: int, parts: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in slices(batches, "word", BATCH_BYTES):
            texts, counts = batch.column("word"), batch.column("n").to_numpy()
            for where, codes in _by_length(texts):
                rows = max(1, PROBES // (codes.shape[1] * len(alphabet)))
                for start in range(0, len(codes), rows):
                    some = where[start : start + rows]
                    words = texts.take(pa.array(some)).to_pylist()
                    owners, near = _neighbours(words, codes[start : start + rows], alphabet, filters, part, parts)
                    if near:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[i] for i in owners], pa.string()), pa.array(counts[some[owners]]), pa.array(near, pa.string())],
                            schema=schema,
                        )

    return run


def _neighbours(
    words: list[str], codes: np.ndarray, alphabet: np.ndarray, filters: dict[int, np.ndarray], part: int, parts: int
) -> tuple[list[int], list[str]]:
    """Edited words that the filters may hold: places of their words, and the edited words.

    The words are of one length. Of equal letters side by side only the first is deleted, so every edited word comes up once.
    """
    length = codes.shape[1]
    positions = np.arange(length)
    own = _letter_hashes(positions, codes)
    whole = np.bitwise_xor.reduce(own, axis=1)
    owners: list[int] = []
    near: list[str] = []
    shorter = filters.get(_shard(length - 1)) if length > 1 else None
    if shorter is not None:
        shifted = _letter_hashes(np.maximum(positions - 1, 0), codes)
        before = np.bitwise_xor.accumulate(own, axis=1) ^ own
        after = np.bitwise_xor.accumulate(shifted[:, ::-1], axis=1)[:, ::-1] ^ shifted
        distinct = np.ones(codes.shape, bool)
        distinct[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(distinct)
        for hit in _hits(shorter, (before ^ after)[row, at], part, parts).tolist():
            word, i = words[row[hit]], int(at[hit])
            owners.append(int(row[hit]))
            near.append(word[:i] + word[i + 1 :])
    same = filters.get(_shard(length))
    if same is not None:
        without = whole[:, None] ^ own
        width = max(1, PROBES // (len(words) * len(alphabet)))
        for start in range(0, length, width):
            here = positions[start : start + width]
            new = _letter_hashes(here[:, None], alphabet[None, :])
            row, at, letter = np.nonzero(alphabet[None, None, :] > codes[:, start : start + width, None])
            for hit in _hits(same, without[row, start + at] ^ new[at, letter], part, parts).tolist():
                word, i = words[row[hit]], start + int(at[hit])
                owners.append(int(row[hit]))
                near.append(word[:i] + chr(alphabet[letter[hit]]) + word[i + 1 :])
    return owners, near
