"""Tables that grow by small imports, stored by hash of their key: an import rewrites only the buckets that it touches.

Files lie below ``data/version/bucket``. A manifest, one small table per version, says which version holds each bucket, and is written
last: a job that dies leaves the former version in force, files of untouched buckets stay as they are, and readers of an older version
keep their files. The driver handles one manifest row per bucket and no other rows.

Defined results: rows with a NULL key have a bucket like others; a log without rows has its columns; incoming columns that the log
lacks are dropped by the merge given. One writer at a time: a second one that writes the same version gets an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sidewise.errors import ComparisonError
from sidewise.functions.columns import col, key_columns
from sidewise.operators.results import content_hash, merge_runs, upsert_latest
from sidewise.plans.storage import cut, shared_path

BUCKETS = 256
_BUCKET = "__bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Change:
    """What an import did: the new version, the buckets it rewrote and the buckets there are."""

    version: int
    rewritten: list[int]
    buckets: int


@dataclass(frozen=True)
class BucketLog:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, rows: DataFrame, key: str, buckets: int = BUCKETS, path: str | None = None) -> BucketLog:
        """Store ``rows`` in as many buckets by ``key``; the path must not exist, by default it goes with the session."""
        if buckets < 1:
            raise ComparisonError("A log needs at least one bucket")
        (key,) = key_columns(rows, key)
        log = cls(rows.sparkSession, path or shared_path(rows.sparkSession, "log"))
        facts = [(key, buckets, rows.schema.json())]
        log.spark.createDataFrame(facts, "key string, buckets int, schema string").coalesce(1).write.parquet(f"{log.path}/facts")
        log._write(rows, {}, 0)
        return log

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, which are the only files read."""
        held = self._manifest(self.version())
        paths = [self._folder(version, b) for b, version in sorted(held.items()) if buckets is None or b in set(buckets)]
        schema = self._facts()[2]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The newest version whose manifest is complete."""
        return max(_number(p.getParent()) for p in self._found(f"{self.path}/manifest/version=*/_SUCCESS"))

    def apply(self, incoming: DataFrame, merge: Merge, also: DataFrame | None = None) -> Change:
        """Replace the buckets that the keys of ``incoming`` (and of ``also``, a frame of keys) fall into by ``merge(rows, incoming)``.

        ``merge`` must keep every row it does not mean to change; rows that leave those buckets are an error.
        """
        key, buckets, _ = self._facts()
        incoming = cut(incoming, "incoming")
        keys = incoming.select(col(key))
        touched = self._buckets_of(keys if also is None else keys.unionByName(also.select(col(key))))
        version = self.version()
        held = self._manifest(version)
        if not touched:
            return Change(version, [], buckets)
        merged = cut(merge(self.rows(touched), incoming), "merged")
        strays = set(self._buckets_of(merged.select(col(key)))) - set(touched)
        if strays:
            raise ComparisonError(f"The merge made rows of buckets that it was not given: {sorted(strays)[:10]}")
        self._write(merged, {b: v for b, v in held.items() if b not in set(touched)}, version + 1)
        return Change(version + 1, touched, buckets)

    def _write(self, rows: DataFrame, untouched: dict[int, int], version: int) -> None:
        key, _, schema = self._facts()
        placed = rows.select(*[col(c) for c in schema.names], self._bucket(key).alias(_BUCKET))
        data = f"{self.path}/data/version={version}"
        # What a job that died left of this version is not in any manifest.
        # Rows meet by bucket; a bucket of very many rows, such as that of NULL keys, is split over tasks and files.
        placed.hint("rebalance", F.col(_BUCKET)).write.mode("overwrite").partitionBy(_BUCKET).parquet(data)
        held = [*untouched.items(), *[(_number(p), version) for p in self._found(f"{data}/{_BUCKET}=*")]]
        manifest = self.spark.createDataFrame(held, "bucket int, version int")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    def _facts(self) -> tuple[str, int, T.StructType]:
        row = self.spark.read.parquet(f"{self.path}/facts").first()
        return row["key"], row["buckets"], T.StructType.fromJson(json.loads(row["schema"]))

    def _manifest(self, version: int) -> dict[int, int]:
        stored = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest/version={version}")
        return {r["bucket"]: r["version"] for r in stored.collect()}

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(col(key)), F.lit(self._facts()[1])).cast("int")

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        (key,) = keys.columns
        return sorted(r[0] for r in keys.select(self._bucket(key)).distinct().collect())

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/version={version}/{_BUCKET}={bucket}"

    def _found(self, pattern: str) -> list:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [status.getPath() for status in system.globStatus(path)]


def _number(path) -> int:
    """The number at the end of a folder's name."""
    return int(path.getName().partition("=")[2])


def import_checks(log: BucketLog, incoming: DataFrame) -> Change:
    """``results.upsert_latest`` on a log of checks by ``check_id``.

    A preset may replace one of another id, so the ids of existing presets with the content of incoming ones are looked up first, from the
    columns that make up a content.
    """
    wanted = incoming.filter("is_preset").select(content_hash().alias("h")).distinct()
    presets = log.rows().filter("is_preset").select("check_id", content_hash().alias("h"))
    return log.apply(incoming, upsert_latest, presets.join(wanted, "h", "left_semi").select("check_id"))


def import_runs(log: BucketLog, incoming: DataFrame) -> Change:
    """``results.merge_runs`` on a log of runs by ``run_id``."""
    return log.apply(incoming, merge_runs)
