"""Every registered query against its SQL on the smallest tables."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from oracle import DATA, assert_same

import __spark_entry__
from meterglass import export
from meterglass.plans import adapter, queries

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, str(DATA)), queries.ORACLES[name])


def test_review_tokens_of_many_parts(spark, tmp_path):
    """Keys as large as those of 60 times the largest tables, with halves of both marks; their counts pass a billion."""
    keys = "SELECT 1199000 + i AS p_partkey, CAST(1 + i % 50 AS INTEGER) AS p_size FROM range(1000) t(i) UNION ALL SELECT 125000 * i, 1 + i % 50 FROM range(1000) t(i) UNION ALL SELECT 10 * i, 25 FROM range(1000) t(i)"
    duckdb.sql(f"COPY ({keys}) TO '{tmp_path}/part.parquet'")
    rows = queries.QUERIES["review_tokens"](spark, str(tmp_path))
    assert rows.agg({"n": "max"}).first()[0] >= 10**9
    assert_same(rows, queries.ORACLES["review_tokens"], tmp_path)


def test_number_formats_of_halves(spark, tmp_path):
    """Every price whose thousands or cents are a half or next to one, none, less than one and below zero."""
    prices = "SELECT 125.0 * i FROM range(4000) t(i) UNION ALL SELECT 125.0 * i - 0.01 FROM range(1, 4000) t(i) UNION ALL SELECT i / 8 FROM range(-100, 9000) t(i) UNION ALL SELECT i / 1000 FROM range(5, 3000, 10) t(i) UNION ALL SELECT NULL"
    orders = f"SELECT row_number() OVER () AS o_orderkey, CAST(p AS DOUBLE) AS o_totalprice, TIMESTAMP '1997-12-30' + to_days(CAST(row_number() OVER () % 900 AS INTEGER)) AS o_orderdate FROM ({prices}) t(p)"
    duckdb.sql(f"COPY ({orders}) TO '{tmp_path}/orders.parquet'")
    assert_same(queries.QUERIES["number_and_date_formats"](spark, str(tmp_path)), queries.ORACLES["number_and_date_formats"], tmp_path)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_folder(tmp_path):
    """The other queries are there when the subpackage and the pipeline are not."""
    import shutil

    shutil.copytree(REPO / "meterglass", tmp_path / "meterglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'usage_daily' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_llm_folder():
    for p in (REPO / "meterglass").rglob("*.py"):
        if "llm" not in p.parts:
            assert "meterglass.llm" not in p.read_text()


def test_facts_are_not_shuffled_to_be_priced(spark):
    """Messages meet their prices by a broadcast; the one shuffle of the report is by its key."""
    report = queries.QUERIES["cost_by_source_policy"](spark, str(DATA))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz" not in plan or "user_id" in plan


def test_graph_document(spark):
    document = export.graph_document(queries.costed(spark, str(DATA)), "now")
    assert json.loads(json.dumps(document)) == document
    days = document["contributions"]
    assert [d["date"] for d in days] == sorted(d["date"] for d in days)
    assert sum(d["totals"]["tokens"] for d in days) == document["summary"]["totalTokens"] == sum(y["totalTokens"] for y in document["years"])
    assert all(sum(s["cost"] for s in d["sources"]) == d["totals"]["cost"] and 0 <= d["intensity"] <= 4 for d in days)
    assert document["meta"]["dateRange"] == {"start": days[0]["date"], "end": days[-1]["date"]}
    empty = export.graph_document(queries.costed(spark, str(DATA)).filter("false"), "now")
    assert empty["contributions"] == [] and empty["summary"]["totalTokens"] == 0 and empty["meta"]["dateRange"]["start"] is None


def test_every_validation_rule_is_broken_and_returned(spark):
    rows = queries.QUERIES["validation_rules"](spark, str(DATA)).collect()
    assert {r["rule"] for r in rows} == {f"V{n}" for n in range(1, 11)}
    assert {r["subject"] for r in rows if r["rule"] == "V7"} & {r["subject"] for r in rows if r["rule"] == "V2"}, "last days after the end"


def test_adapter_sources(spark):
    assert {r["source"] for r in adapter.usage(spark, str(DATA)).select("source").distinct().collect()} <= set(adapter.SOURCES)
