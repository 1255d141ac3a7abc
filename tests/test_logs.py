"""Logs stored by bucket: the answers of whole merges, files of untouched buckets left alone, and jobs that die midway."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sidewise.errors import ComparisonError
from sidewise.operators.results import merge_runs, upsert_latest
from sidewise.sources.logs import BucketLog, import_checks, import_runs

CHECKS = "check_id string, name string, type string, params string, view_options string, is_checked boolean, is_preset boolean, updated_at timestamp, created_by string"
RUNS = "run_id string, run_at timestamp, value long, bucket string"


def checks(spark, seed, count, prefix=""):
    generator = random.Random(seed)
    rows = []
    for i in generator.sample(range(120), count):
        when = datetime(2026, 1, 1) + timedelta(days=generator.randrange(20))
        preset = generator.random() < 0.5
        # Contents of presets are shared between ids; no two incoming presets have the same one.
        rows.append((f"{prefix}{i}", f"{seed}-{i}", "query", f"p{i}" if prefix else f"p{i % 40}", None, False, preset, when, generator.choice(["me", "you"])))
    return spark.createDataFrame(rows, CHECKS)


def runs(spark, ids):
    return spark.createDataFrame([(i, datetime(2026, 1, 1) + timedelta(hours=n), n, "x") for n, i in enumerate(ids)], RUNS)


def plain(df):
    return sorted(str(r) for r in df.collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_imports_equal_whole_merges(spark, tmp_path):
    existing = checks(spark, 1, 80)
    log = BucketLog.create(existing, "CHECK_ID", 16, f"{tmp_path}/log")
    assert plain(log.rows()) == plain(existing)
    for seed, prefix in ((2, ""), (3, "n"), (4, "")):
        incoming = checks(spark, seed, 12, prefix)
        expected = spark.createDataFrame(upsert_latest(existing, incoming).collect(), CHECKS)
        import_checks(log, incoming)
        assert plain(log.rows()) == plain(expected)
        existing = expected
    assert log.version() == 3


def test_untouched_files_stay(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = BucketLog.create(runs(spark, [f"r{i}" for i in range(2000)]), "run_id", 64, path)
    before, older = files(f"{path}/data"), plain(log.rows())
    incoming = runs(spark, ["r5", "new1", "new2", "new2"])
    change = import_runs(log, incoming)
    assert 1 <= len(change.rewritten) <= 3 and change.buckets == 64
    after = files(f"{path}/data")
    assert before.items() <= after.items()
    added = [f for f in after if f not in before]
    assert {int(Path(f).parent.name.partition("=")[2]) for f in added} == set(change.rewritten)
    assert plain(log.rows()) == plain(merge_runs(runs(spark, [f"r{i}" for i in range(2000)]), incoming))
    # Only the files in force are read, and an older version can still be read.
    assert not {f"version=0/__bucket={b}/" for b in change.rewritten} & {"/".join(f.split("/")[-3:-1]) + "/" for f in log.rows().inputFiles()}
    assert sorted(str(r) for r in spark.read.schema(RUNS).parquet(f"{path}/data/version=0").drop("__bucket").collect()) == older
    one = log.rows(change.rewritten[:1])
    assert 0 < one.count() < 2000 and len(one.inputFiles()) < len(log.rows().inputFiles())


def test_a_job_that_dies_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = BucketLog.create(runs(spark, ["a", "b", "c"]), "run_id", 4, path)
    before = plain(log.rows())

    def dies(rows, incoming):
        return rows.withColumn("value", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        log.apply(runs(spark, ["a", "d"]), dies)
    # Data of a version whose manifest was never written.
    runs(spark, ["z"]).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{path}/data/version=1")
    assert (log.version(), plain(log.rows())) == (0, before)
    import_runs(log, runs(spark, ["d"]))
    assert {r["run_id"] for r in BucketLog(spark, path).rows().collect()} == {"a", "b", "c", "d"}


def test_defined_results(spark, tmp_path):
    empty = runs(spark, [])
    log = BucketLog.create(empty, "run_id", 8, f"{tmp_path}/empty")
    assert log.rows().columns == empty.columns and log.rows().count() == 0
    assert import_runs(log, empty).rewritten == [] and log.version() == 0
    import_runs(log, runs(spark, ["a"]))
    assert log.rows().count() == 1
    # A bucket whose rows all go leaves the manifest.
    log.apply(runs(spark, ["a"]), lambda rows, incoming: rows.limit(0))
    assert log.rows().count() == 0
    # One third of the keys NULL.
    ids = [None if i % 3 == 0 else f"r{i}" for i in range(300)]
    log = BucketLog.create(runs(spark, ids), "run_id", 8, f"{tmp_path}/nulls")
    import_runs(log, runs(spark, [None, "r1", "new"]))
    expected = merge_runs(runs(spark, ids), runs(spark, [None, "r1", "new"]))
    assert plain(log.rows()) == plain(expected)
    with pytest.raises(ComparisonError, match="buckets that it was not given"):
        log.apply(runs(spark, ["r1"]), lambda rows, incoming: runs(spark, [f"other{i}" for i in range(50)]))
    with pytest.raises(ComparisonError):
        BucketLog.create(empty, "no_such", 8, f"{tmp_path}/x")
    with pytest.raises(ComparisonError):
        BucketLog.create(empty, "run_id", 0, f"{tmp_path}/y")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        BucketLog.create(empty, "run_id", 8, f"{tmp_path}/empty")
