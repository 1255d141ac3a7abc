"""Encoding and decoding with a word-based vocabulary through a table of distinct words.

Words are what white space separates; a vocabulary of this kind drops white space, so the ids of a text are the ids of its
words one after another. Every distinct word of the corpus is encoded once, in a table partitioned by word; the ids then
come back to the texts by position.

Carrying every occurrence of every word through a shuffle would multiply the corpus. So texts are taken in *blocks* of a few
megabytes, each with its own list of distinct words:

1. First pass: every block sends its words to the word table, packed by word bucket.
2. A bucket holds all blocks' lists of its words. Its distinct words are encoded once, and each list gets its ids back in
   the same order.
3. Second pass: every block sends its texts as places in its word list (compressed), and meets its ids.
4. Ids are decoded through the table of id and piece, which is as large as the vocabulary.

Both passes must see the same blocks. Blocks carry a hash of their words, and a block that meets ids of other words raises
an error instead of giving wrong ids.

Defined results: a null text is an empty one and has no ids; rows of the same id keep their own entry; texts with special
strings or unusual white space give what the library gives, as both are handled inside a word; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sidewise.llm.common import only, slices

BLOCK_BYTES = 8 << 20
_SEQ_BITS = 20


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def pieces(tokenizer: str) -> list[str]:
    """The piece of every id of a vocabulary."""
    names = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    found = [""] * (max(names.values(), default=-1) + 1)
    for piece, i in names.items():
        found[i] = piece
    return found


class _Block:
    """Texts of one block as places in the list of its distinct words."""

    def __init__(self, texts: pa.Array):
        # Splits at ASCII white space, which no word of the vocabulary's pattern crosses.
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words, lengths = split.flatten(), pc.list_value_length(split).to_numpy()
        kept = pc.not_equal(pc.binary_length(words), 0)
        if pc.all(kept).as_py() is False:
            owner = np.repeat(np.arange(len(lengths)), lengths)[kept.to_numpy(zero_copy_only=False)]
            words, lengths = words.filter(kept), np.bincount(owner, minlength=len(lengths))
        coded = words.dictionary_encode()
        self.places = coded.indices.to_numpy().astype(np.int32)
        self.words = coded.dictionary
        self.lengths = np.asarray(lengths, np.int64)

    def buckets(self, count: int) -> tuple[list[np.ndarray], list[list[str]]]:
        """Places and words of the block by word bucket. A word has the same bucket everywhere."""
        words = self.words.to_pylist()
        raw = [word.encode("utf-8", "surrogatepass") for word in words]
        bucket = np.array([int.from_bytes(blake2b(r, digest_size=4).digest(), "little") for r in raw], np.int64) % count
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(count + 1))
        places = [order[cuts[i] : cuts[i + 1]] for i in range(count)]
        return places, [[words[p] for p in own] for own in places]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Blocks of a task: their number and batches."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    size = number = 0
    for batch in slices(batches, "text", BLOCK_BYTES):
        own = batch.column("text").nbytes
        if held and size + own > BLOCK_BYTES:
            yield part << _SEQ_BITS | number, held
            held, size, number = [], 0, number + 1
        held.append(batch)
        size += own
    if held:
        yield part << _SEQ_BITS | number, held


def _texts(held: list[pa.RecordBatch]) -> pa.Array:
    return pa.concat_arrays([batch.column("text") for batch in held])


def _packed(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode("utf-8", "surrogatepass"), 1)


def _check(packed: bytes) -> int:
    return int.from_bytes(blake2b(packed, digest_size=7).digest(), "little")


def encode_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids, decoded`` as digests: ``id, n_tokens, ids_sha256, decoded_sha256`` for every row."""
    return _assembled(docs, tokenizer, id_column, text_column, digests=True)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids, decoded``: the ids (decimal, joined by a space) and the decoded text of every row."""
    return _assembled(docs, tokenizer, id_column, text_column, digests=False)


def _assembled(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = only(docs, id=id_column, text=text_column)
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both passes read the same columns, so that the same plan deals the same rows.
    lists = rows.mapInArrow(_word_lists(ways), "block long, bucket int, words binary")
    answers = lists.repartition(ways, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _encoded(tokenizer), "answer_block long, bucket int, checked long, ids binary"
    )
    by_block = answers.groupBy("answer_block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "checked", "ids"))).alias("answers")
    )
    id_kind = rows.schema["id"].dataType
    bundles = rows.mapInArrow(_bundles(ways), "block long, keys binary, texts binary, checks array<long>")
    both = bundles.join(by_block, F.col("block") == F.col("answer_block"), "left")
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string"
    # As large as the vocabulary, which is fixed with the tokenizer.
    table = spark.sparkContext.broadcast(pieces(tokenizer))
    return both.select("block", "keys", "texts", "checks", "answers").mapInArrow(
        _joined(table, to_arrow_type(id_kind), digests), f"id {id_kind.simpleString()}, {result}"
    )


def _word_lists(ways: int):
    def run(batches):
        for number, held in _blocks(batches):
            _, words = _Block(_texts(held)).buckets(ways)
            filled = [(i, _packed(own)) for i, own in enumerate(words) if own]
            if filled:
                yield pa.RecordBatch.from_pydict(
                    {"block": [number] * len(filled), "bucket": [i for i, _ in filled], "words": [p for _, p in filled]},
                    pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())]),
                )

    return run


def _encoded(tokenizer: str):
    """Encode each distinct word of a bucket once and answer every list of it.

    A list's answer holds the number of its words, then how many ids each has, then all ids.
    """

    def run(batches):
        library = _tokenizer(tokenizer)
        known: dict[str, bytes] = {}
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current:
                    known, current = {}, row["bucket"]
                words = zstandard.decompress(row["words"]).decode("utf-8", "surrogatepass").split("\n")
                new = [word for word in dict.fromkeys(words) if word not in known]
                for start in range(0, len(new), 4096):
                    part = new[start : start + 4096]
                    for word, coded in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
                        known[word] = np.array(coded.ids, "<u4").tobytes()
                own = [known[word] for word in words]
                counts = np.array([len(own), *[len(ids) // 4 for ids in own]], "<u4")
                ids = zstandard.compress(counts.tobytes() + b"".join(own), 1)
                yield pa.RecordBatch.from_pydict(
                    {"answer_block": [row["block"]], "bucket": [row["bucket"]], "checked": [_check(row["words"])], "ids": [ids]},
                    pa.schema(
                        [("answer_block", pa.int64()), ("bucket", pa.int32()), ("checked", pa.int64()), ("ids", pa.binary())]
                    ),
                )

    return run


def _bundles(ways: int):
    def run(batches):
        for number, held in _blocks(batches):
            block = _Block(_texts(held))
            places, words = block.buckets(ways)
            # Places are renumbered in the order in which the answers will come.
            order = np.concatenate(places) if len(block.words) else np.empty(0, np.int64)
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            coded = rank[block.places].astype("<u4")
            # Bytes of equal weight side by side compress better.
            body = coded.view(np.uint8).reshape(-1, 4).T.tobytes()
            keys = pa.table({"id": pa.chunked_array([b.column("id") for b in held])})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as writer:
                writer.write_table(keys)
            texts = zstandard.compress(block.lengths.astype("<i8").tobytes() + body, 1)
            checks = [_check(_packed(own)) if own else 0 for own in words]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([texts], pa.binary()), pa.array([checks], pa.list_(pa.int64())),
                ],
                ["block", "keys", "texts", "checks"],
            )

    return run


def _joined(table, id_type: pa.DataType, digests: bool):
    def run(batches):
        names = table.value
        numbers = [str(i) for i in range(len(names))]
        for batch in batches:
            for i in range(batch.num_rows):
                yield _answer({name: batch.column(name)[i] for name in batch.schema.names}, names, numbers)

    def _answer(row: dict, names: list[str], numbers: list[str]) -> pa.RecordBatch:
        answers = {a["bucket"]: a for a in row["answers"].as_py() or []}
        ids_of: list[str] = []
        text_of: list[str] = []
        size_of: list[np.ndarray] = []
        for bucket, check in enumerate(row["checks"].as_py()):
            if not check:
                continue
            answer = answers.get(bucket)
            if answer is None or answer["checked"] != check:
                raise RuntimeError("The input changed between two passes: a block meets the ids of other words")
            ids, counts = _unpacked(zstandard.decompress(answer["ids"]))
            size_of.append(counts)
            ends = np.cumsum(counts).tolist()
            start = 0
            for end in ends:
                own = ids[start:end]
                ids_of.append(" ".join([numbers[x] for x in own]))
                text_of.append(" ".join([names[x] for x in own]))
                start = end
        keys = pa.ipc.open_stream(row["keys"].as_py()).read_all().column("id").combine_chunks()
        if isinstance(keys, pa.ChunkedArray):
            keys = pa.concat_arrays(keys.chunks)
        raw = zstandard.decompress(row["texts"].as_py())
        lengths = np.frombuffer(raw, "<i8", len(keys))
        body = np.frombuffer(raw, np.uint8, offset=8 * len(keys)).reshape(4, -1).T
        coded = np.ascontiguousarray(body).view("<u4").reshape(-1)
        sizes = np.concatenate(size_of) if size_of else np.empty(0, np.int64)
        totals, first, second = [], [], []
        start = 0
        for length in lengths.tolist():
            own = coded[start : start + length]
            start += length
            places = own.tolist()
            # Words without ids (marks that the vocabulary drops) leave no gap.
            ids = " ".join([x for x in map(ids_of.__getitem__, places) if x])
            text = " ".join([x for x in map(text_of.__getitem__, places) if x])
            totals.append(int(sizes[own].sum()))
            first.append(sha256(ids.encode()).hexdigest() if digests else ids)
            second.append(sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digests else text)
        if digests:
            return pa.RecordBatch.from_arrays(
                [keys.cast(id_type), pa.array(totals, pa.int64()), pa.array(first), pa.array(second)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        return pa.RecordBatch.from_arrays([keys.cast(id_type), pa.array(first), pa.array(second)], ["id", "ids", "decoded"])

    return run


def _unpacked(raw: bytes) -> tuple[list[int], np.ndarray]:
    """All ids of an answer, and how many each word has."""
    values = np.frombuffer(raw, "<u4")
    first = 1 + int(values[0])
    return values[first:].tolist(), values[1:first].astype(np.int64)
