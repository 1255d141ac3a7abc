"""Token ids in flat binary files: unsigned ids, 64-bit document offsets, read through memory maps.

Documents are sorted by id over range partitions. Each partition writes ``<part>.bin`` (ids, little-endian; 16 bits wide if
the whole vocabulary fits, else 32, as ``dataset.json`` says), ``<part>.idx`` (n + 1 offsets within the file, little-endian unsigned 64-bit) and ``<part>.doc`` (document ids, an Arrow file). The place
of a partition in the whole corpus, its base, is the sum of the token counts before it; ``dataset.json`` keeps the bases.

A retried task writes files under new names, and only the files named by the task that Spark committed are in
``dataset.json``; files of lost attempts are never read.

Defined results: a null text is an empty one and yields the end id alone; null ids come first; rows of the same id stand
side by side, each with its own entry; an empty table yields no files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.llm.common import only, open_folder, slices, texts_of
from sidewise.llm.encoding import encoder
from sidewise.plans.storage import cut

BATCH_BYTES = 8 << 20
_PARTS = "part long, name string, documents long, tokens long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode ``docs`` and write their ids to ``folder`` in ascending order of id; each document ends with ``end_id``."""
    rows = only(docs, id=id_column, text=text_column).withColumn("tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    dtype = "<u2" if max(encoder(tokenizer).largest_id, end_id) < 1 << 16 else "<u4"
    parts = cut(ordered.mapInArrow(_writer(folder, tokenizer, end_id, dtype), _PARTS), "token-parts")
    # One row per partition of the sorted table.
    found = parts.orderBy("part").collect()
    bases = [0, *accumulate(row["tokens"] for row in found)]
    entries = [row.asDict() | {"base": base} for row, base in zip(found, bases)]
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dataset.json") as out:
        out.write(json.dumps({"tokens": bases[-1], "ids": dtype, "parts": entries}).encode())


def _writer(folder: str, tokenizer: str, end_id: int, dtype: str):
    end = end_id.to_bytes(4, "little")

    def write(batches):
        encode = encoder(tokenizer).ids
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:07d}-{uuid.uuid4().hex}"
        lengths, keys, out = [0], [], None
        for batch in slices(batches, "text", BATCH_BYTES):
            out = out or system.open_output_stream(f"{path}/{name}.bin")
            keys.append(batch.column("id"))
            for text in texts_of(batch, "text"):
                ids = encode(text) + end
                lengths.append(len(ids) // 4)
                out.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes())
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.array(lengths, "<u8"), dtype="<u8")
        with system.open_output_stream(f"{path}/{name}.idx") as file:
            file.write(offsets.tobytes())
        table = pa.table({"id": pa.chunked_array(keys)})
        with system.open_output_stream(f"{path}/{name}.doc") as file, pa.ipc.new_file(file, table.schema) as writer:
            writer.write_table(table)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "documents": [len(lengths) - 1], "tokens": [int(offsets[-1])]},
            pa.schema([("part", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]),
        )

    return write


class TokenPart:
    """One partition's files, memory-mapped where the folder is local, else read."""

    def __init__(self, folder: str, name: str, dtype: str):
        system, path = open_folder(folder)
        self.ids = _mapped(system, f"{path}/{name}.bin", dtype)
        self.offsets = _mapped(system, f"{path}/{name}.idx", "<u8")
        with system.open_input_file(f"{path}/{name}.doc") as file:
            self.keys = pa.ipc.open_file(file).read_all().column("id").combine_chunks()

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def _mapped(system, path: str, dtype: str) -> np.ndarray:
    if system.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if system.type_name == "local":
        return np.memmap(path, dtype, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; one task reads one partition's files."""
    system, path = open_folder(folder)
    with system.open_input_stream(f"{path}/dataset.json") as file:
        dataset = json.loads(file.read())
    parts = dataset["parts"]
    files = spark.createDataFrame([(p["name"], p["base"]) for p in parts], "name string, base long")
    if parts:
        files = files.repartition(len(parts))
    return files.mapInArrow(_reader(folder, dataset["ids"]), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _reader(folder: str, dtype: str):
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(folder, row["name"], dtype)
                offsets = np.asarray(part.offsets).astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.keys,
                        pa.array(offsets[:-1] + row["base"]),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(part[i].astype("<u4")) for i in range(len(part))], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read
