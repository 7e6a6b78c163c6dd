"""Submitted documents: the form of every field, and what a good document leaves in the store."""

import json

import pytest
from pyspark.sql import functions as F

from meterglass.operators.payloads import faults, submit_documents
from meterglass.operators.submissions import submission_store


def document():
    kinds = {"input": 10, "output": 5, "cacheRead": 3, "cacheWrite": 1, "reasoning": 1}
    part = {"source": "claude", "modelId": "sonnet", "providerId": "anthropic", "tokens": kinds, "cost": 0.5, "messages": 2}
    day = {"date": "2025-01-02", "totals": {"tokens": 20, "cost": 0.5, "messages": 2}, "intensity": 4, "tokenBreakdown": kinds, "sources": [part]}
    days = {"start": "2025-01-02", "end": "2025-01-02"}
    summary = {"totalTokens": 20, "totalCost": 0.5, "totalDays": 1, "activeDays": 1, "averagePerDay": 0.5, "maxCostInSingleDay": 0.5, "sources": ["claude"], "models": ["sonnet"]}
    return {"meta": {"generatedAt": "now", "version": "1", "dateRange": days}, "summary": summary, "years": [{"year": "2025", "totalTokens": 20, "totalCost": 0.5, "range": days}], "contributions": [day]}


def changed(path, value):
    """The document with one field set, or without it where the value is ``...``."""
    out = json.loads(json.dumps(document()))
    *above, last = path
    at = out
    for k in above:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


PART = ("contributions", 0, "sources", 0)
CASES = [
    (("meta", "version"), ..., "meta.version"), (("meta", "dateRange", "end"), "2025-1-2", "meta.dateRange.end"), (("summary", "totalTokens"), -1, "summary.totalTokens"),
    (("summary", "totalTokens"), 1.5, "summary.totalTokens"), (("summary", "activeDays"), "1", "summary.activeDays"), (("summary", "sources"), ["claude", "droid"], "summary.sources"),
    (("summary", "sources"), "claude", "summary.sources"), (("summary", "models"), [1], "summary.models"), (("years",), {}, "years"), (("contributions",), None, "contributions"),
    (("years", 0, "year"), 2025, "years[0].year"), (("years", 0, "range", "start"), "x", "years[0].range.start"), (("years", 0, "totalCost"), None, "years[0].totalCost"),
    (("contributions", 0, "date"), "2025/01/02", "contributions[0].date"), (("contributions", 0, "intensity"), 5, "contributions[0].intensity"), (("contributions", 0, "intensity"), 2.5, "contributions[0].intensity"),
    (("contributions", 0, "totals", "messages"), -2, "contributions[0].totals.messages"), (("contributions", 0, "tokenBreakdown", "reasoning"), ..., "contributions[0].tokenBreakdown.reasoning"),
    (("contributions", 0, "sources"), 3, "contributions[0].sources"), ((*PART, "source"), "droid", "contributions[0].sources[0].source"), ((*PART, "modelId"), "", "contributions[0].sources[0].modelId"),
    ((*PART, "providerId"), 4, "contributions[0].sources[0].providerId"), ((*PART, "tokens", "cacheRead"), True, "contributions[0].sources[0].tokens.cacheRead"), ((*PART, "cost"), "free", "contributions[0].sources[0].cost"),
]
FINE = [document(), changed((*PART, "providerId"), ...), changed(("summary", "totalTokens"), 20.0), changed(("contributions",), []), changed(("contributions", 0, "extra"), 1), changed(("summary", "totalCost"), 3)]


def test_each_field_has_its_form(spark):
    texts = [json.dumps(changed(path, value)) for path, value, _ in CASES] + [json.dumps(d) for d in FINE] + ["{", "[]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "user_id bigint, document string")
    got = sorted((r["user_id"], r["place"]) for r in faults(df).collect())
    want = [(n, place) for n, (_, _, place) in enumerate(CASES)] + [(len(texts) - k, "$") for k in (1, 2, 3)]
    assert got == sorted(want)
    assert faults(df.filter("false")).count() == 0


def test_documents_go_into_the_store_or_are_refused(spark, tmp_path):
    store = submission_store(spark, str(tmp_path / "store"), buckets=4)
    again = changed((*PART, "tokens", "input"), 1000)
    again["summary"]["sources"].append("amp")
    texts = [(1, document()), (2, changed((*PART, "modelId"), "")), (3, changed(("contributions", 0, "date"), "2031-01-01"))]
    df = spark.createDataFrame([(u, json.dumps(d)) for u, d in texts], "user_id bigint, document string")
    done = submit_documents(store, df, "2025-06-30", batch=("api", 0))
    assert {(r["submission_id"], r["rule"]) for r in done.found.filter("severity = 'error'").collect()} == {(2, "V1"), (3, "V2")}
    (row,) = store.read("days").collect()
    assert (row["user_id"], str(row["date"]), row["tokens"], row["cost"], row["messages"]) == (1, "2025-01-02", 20, 0.5, 2)
    submit_documents(store, spark.createDataFrame([(1, json.dumps(again))], "user_id bigint, document string"), "2025-06-30", batch=("api", 1))
    assert store.read("days").select(F.sum("tokens")).first()[0] == 1010 and store.read("submissions").first()["submit_count"] == 2


@pytest.mark.parametrize("value", [[], [{}]])
def test_empty_lists(spark, value):
    df = spark.createDataFrame([(1, json.dumps(changed(("years",), value)))], "user_id bigint, document string")
    assert faults(df).count() == (5 if value else 0)
