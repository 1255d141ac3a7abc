"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame


def fresh(prefix: str, taken: Sequence[str]) -> str:
    """A column name that clashes with none of ``taken`` (names differ in more than case)."""
    lower = {name.lower() for name in taken}
    name = prefix
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: ``only(df, id="doc_id")``."""
    return df.select(*[df[quoted(source)].alias(target) for target, source in columns.items()])


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if not urlparse(uri).scheme:
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def slices(batches, column: str, most_bytes: int):
    """Arrow batches cut so that the strings of ``column`` stay below ``most_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.column(column).nbytes <= most_bytes:
            if batch.num_rows:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if first < batch.num_rows:
            yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column, nulls as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


_held: dict[str, Any] = {}


def held_by(owner: str, build: Callable[[], Any]) -> Any:
    """What an operator keeps between the tasks of a Python worker, such as results by word.

    A worker holds the things of one operator only: those of the operator before are dropped, so that the caches of many
    operators never add up.
    """
    if owner not in _held:
        _held.clear()
        _held[owner] = build()
    return _held[owner]
