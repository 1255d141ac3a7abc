"""Logs stored by bucket: the same answers as from merging whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidewise.sources.logs import BucketLog, import_checks, import_runs
from workload import lineage_queries  # noqa: F401  registers the plain-SQL texts that are shared here
from workload.queries import ORACLE, query
from workload.tables import derived

BUCKETS = 32


@query(ORACLE["upsert_latest_checks"])
def log_import_checks(spark, folder):
    existing, incoming = derived(spark, folder, "checks_t", "new_checks_t")
    log = BucketLog.create(existing, "check_id", BUCKETS)
    import_checks(log, incoming.withColumn("params", F.concat("params", F.lit("-own"))))
    return log.rows().select("check_id", "name", "params", "updated_at", "created_by")


@query(ORACLE["upsert_latest_presets"])
def log_import_presets(spark, folder):
    existing, incoming = derived(spark, folder, "checks_t", "new_checks_t")
    log = BucketLog.create(existing, "check_id", BUCKETS)
    import_checks(log, incoming.withColumn("check_id", F.concat(F.lit("new_"), "check_id")))
    return log.rows().select("check_id", "name", "updated_at")


@query(ORACLE["merge_runs_rows"])
def log_import_runs(spark, folder):
    existing, incoming = derived(spark, folder, "runs_t", "new_runs_t")
    log = BucketLog.create(existing, "run_id", BUCKETS)
    import_runs(log, incoming)
    return log.rows().select("run_id", "check_id", "type", "run_at", "value")
