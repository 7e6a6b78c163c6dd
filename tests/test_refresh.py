"""Refreshing kept sums reads the files that changed, and gives what a full run gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from meterglass import refresh
from meterglass.operators import pricing, reports
from meterglass.schema import PRICES
from meterglass.sources import sessions

PRICED = [("gpt-4o", 0.001, 0.002, 0.0, 0.0), ("o3", 0.01, 0.0, 0.0, 0.0)]


def opencode(n, tokens, model="gpt-4o"):
    return json.dumps({
        "id": str(n), "sessionID": "s", "role": "assistant", "modelID": model, "providerID": "openai",
        "tokens": {"input": tokens, "output": 1, "cache": {"read": 0, "write": 0}}, "time": {"created": 1733011200000.0 + n * 86_400_000},
    })


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    monkeypatch.delenv("CODEX_HOME", raising=False)
    (tmp_path / ".local/share/opencode/storage/message").mkdir(parents=True)
    for n in range(40):
        (tmp_path / f".local/share/opencode/storage/message/m [{n}] +%20.json").write_text(opencode(n, n + 1))
    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    line = {"type": "assistant", "timestamp": "2024-12-02T00:00:00Z", "message": {"model": "o3", "usage": {"input_tokens": 10}}}
    (tmp_path / ".claude/projects/p/s1.jsonl").write_text((json.dumps(line) + "\n") * 3)
    count = {"type": "event_msg", "timestamp": "2024-12-03T00:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5, "output_tokens": 1}}}}
    (tmp_path / ".codex/sessions").mkdir(parents=True)
    (tmp_path / ".codex/sessions/r.jsonl").write_text(json.dumps(count) + "\n")
    (tmp_path / ".factory/sessions").mkdir(parents=True)
    used = {"tokenUsage": {"inputTokens": 7}, "providerLock": "openai", "providerLockTimestamp": "2024-12-04T00:00:00Z"}
    (tmp_path / ".factory/sessions/d.settings.json").write_text(json.dumps(used))
    (tmp_path / ".factory/sessions/d.jsonl").write_text('"Model: O3 [x]"\n')
    return tmp_path


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_a_full_run(spark, store, home):
    prices = spark.createDataFrame(PRICED, PRICES)
    kept, whole = refresh.kept_usage(store, prices), pricing.priced_usage(sessions.load_usage(spark, str(home)), prices)
    for report in (reports.model_report, reports.monthly_report, reports.daily_contributions, reports.day_totals):
        got, want = report(kept), report(whole)
        rounded = lambda df: df.withColumn("cost", F.round("cost", 9)) if "cost" in df.columns else df
        assert rows(rounded(got.drop("sources"))) == rows(rounded(want.drop("sources")))
    return kept


def test_only_what_changed_is_read(spark, home, monkeypatch):
    seen, plain = [], sessions.texts

    def texts(spark, root, pattern, whole=True):
        found = plain(spark, root, pattern, whole)
        if isinstance(root, list):
            seen.extend(found.inputFiles())
        return found

    monkeypatch.setattr(sessions, "texts", texts)
    store = refresh.usage_store(spark, str(home / "kept"), buckets=8)
    first = refresh.refresh(store, str(home))
    assert len(first.read) == 43 and len(seen) == 44 and first.gone == []
    same_as_a_full_run(spark, store, home)
    assert refresh.refresh(store, str(home)) == refresh.Refreshed(first.version, [], [])

    seen.clear()
    folder = home / ".local/share/opencode/storage/message"
    (folder / "m [7] +%20.json").write_text(opencode(7, 5000, "o3"))
    done = refresh.refresh(store, str(home))
    assert len(done.read) == len(seen) == 1 and done.read[0].endswith("m [7] +%20.json")
    same_as_a_full_run(spark, store, home)

    seen.clear()
    (folder / "m [8] +%20.json").unlink()
    (folder / "new.json").write_text(opencode(3, 1))
    with (home / ".codex/sessions/r.jsonl").open("a") as f:
        f.write((home / ".codex/sessions/r.jsonl").read_text())
    (home / ".factory/sessions/d.jsonl").write_text('"Model: GPT-4o [x]"\n')
    os.utime(home / ".claude/projects/p/s1.jsonl", (1, 1))
    done = refresh.refresh(store, str(home))
    assert sorted(p.rsplit("/", 1)[1] for p in done.read) == ["d.settings.json", "new.json", "r.jsonl", "s1.jsonl"]
    assert [p.rsplit("/", 1)[1] for p in done.gone] == ["m [8] +%20.json"]
    kept = same_as_a_full_run(spark, store, home)
    assert {r["model_id"] for r in kept.filter("source = 'droid'").collect()} == {"gpt-4o"}


def test_sources_that_are_not_named_stay(spark, home):
    store = refresh.usage_store(spark, str(home / "kept"), buckets=4)
    refresh.refresh(store, str(home), ["claude", "codex"])
    refresh.refresh(store, str(home), ["claude"])
    assert {r["source"] for r in store.read("files").collect()} == {"claude", "codex"}
    assert refresh.refresh(store, str(home / "nowhere"), ["codex"]).gone and store.read("sums").filter("source = 'codex'").count() == 0
