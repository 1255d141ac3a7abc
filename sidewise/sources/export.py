"""Writing results as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col

# The separator of each format.
SEPARATORS = {"csv": ",", "tsv": "\t"}


def export_rows(df: DataFrame, path: str, fmt: str = "csv", max_rows: int | None = None) -> str:
    """Write all rows, or the first ``max_rows``, with a header to the folder ``path``; nested values are written as JSON."""
    if fmt not in SEPARATORS:
        raise ComparisonError(f"Unknown export format {fmt!r}; one of {sorted(SEPARATORS)}")
    if max_rows is not None and max_rows < 1:
        raise ComparisonError("An export holds at least one row")
    flat = [
        F.to_json(col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else col(f.name)
        for f in df.schema.fields
    ]
    chosen = df if max_rows is None else df.limit(max_rows)
    writer = chosen.select(*flat).write.mode("errorifexists")
    writer.option("header", True).option("sep", SEPARATORS[fmt]).option("escape", '"').csv(path)
    return path
