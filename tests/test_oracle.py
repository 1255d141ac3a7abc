"""Every query against DuckDB running its plain-SQL counterpart on the same files."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from workload.tables import NAMES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)) and not isinstance(value, bool):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.12g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_queries_without_oracle():
    """Only the timed sketch queries, whose errors have entries of their own, and what SQL cannot express (tested elsewhere)."""
    without = {name for name in entry.queries() if name not in entry.oracle_sql()}
    ours = {"profile_approx_lineitem", "distribution_diff_approx"}
    assert {name for name in without if not name.startswith(("op", "pipeline"))} == ours


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, FOLDER)
    ours = table(df.columns, df.collect())
    result = oracle.execute(entry.oracle_sql()[name])
    theirs = table([d[0] for d in result.description], result.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    assert not different, (len(different), different[:2])
