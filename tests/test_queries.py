"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
LLM = re.compile(r"op\d+_|pipeline$")  # these have their own tests in tests/llm
QUERIES = {name: query for name, query in entry.queries().items() if not LLM.match(name)}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if not LLM.match(name)}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cur = db.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    got = df.collect()
    assert sorted(df.columns) == sorted(columns)
    assert got and rows_of(df.columns, got) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["engine_findings", "severity_map", "engine_to_findings"])
def test_rules_run_once_and_text_is_not_shuffled_for_them(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("AKIA[0-9A-Z]") == 1
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 1  # spread() of the small test table
    assert "size(" not in plan.split("FileScan")[0].split("Filter")[-1]


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["engine_findings"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
