"""The store: merges of touched buckets, crashes before the switch, merges that came first, batches that come again."""

import datetime
import json
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterglass.operators import community
from meterglass.operators.submissions import DAYS, submission_store, submit, submit_stream
from meterglass.store import Store

AS_OF = "2025-06-30"


def day(n):
    return datetime.date(2025, 1, n)


def row(user, n, source, model, tokens, cost=1.0):
    return (user, day(n), source, model, tokens, cost, tokens, 0, 0, 0, 0, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, DAYS)


def days_of(store, *users):
    rows = store.read("days").collect()
    return sorted((r["user_id"], r["date"].day, r["source"], r["model_id"], r["tokens"]) for r in rows if not users or r["user_id"] in users)


def files_of(store):
    """Every data file that the live version refers to, with its time."""
    return {f: Path(f.removeprefix("file:")).stat().st_mtime_ns for f in store.read("days").inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    return submission_store(spark, str(tmp_path / "store"), buckets=8)


def test_first_submission_and_the_next(spark, store):
    """A source that is sent again replaces its days; other sources and days stay; sums are made anew."""
    assert store.read("days").count() == 0 and store.live()["version"] == 0
    done = submit(store, frame(spark, [row(1, 1, "claude", "sonnet", 100, 0.12345), row(1, 1, "codex", " ", 5), row(1, 2, "claude", "sonnet", 7), row(1, 2, "claude", "sonnet", 3)]), AS_OF, cli_version="1")
    assert done.version == 1 and done.found.count() == 0
    assert days_of(store) == [(1, 1, "claude", "sonnet", 100), (1, 1, "codex", "unknown", 5), (1, 2, "claude", "sonnet", 10)]
    submit(store, frame(spark, [row(1, 1, "claude", "opus", 50), row(1, 3, "claude", "opus", 1)]), AS_OF, cli_version="2")
    assert days_of(store) == [(1, 1, "claude", "opus", 50), (1, 1, "codex", "unknown", 5), (1, 2, "claude", "sonnet", 10), (1, 3, "claude", "opus", 1)]
    (s,) = store.read("submissions").collect()
    assert (s["total_tokens"], s["total_cost"], s["active_days"], s["row_count"], s["submit_count"], s["cli_version"]) == (66, Decimal("5.0000"), 3, 3, 2, "2")
    assert s["sources_used"] == ["claude", "codex"] and s["models_used"] == ["opus", "sonnet", "unknown"] and (s["date_start"], s["date_end"]) == (day(1), day(3))
    want = spark.createDataFrame([(["claude"], "2025-01-01", "2025-01-03", ["2025-01-03", "2025-01-01"])], "sources array<string>, start string, end string, days array<string>")
    assert s["submission_hash"] == community.submission_hash(want).first()["submission_hash"]


def test_a_listed_source_without_rows_loses_its_days(spark, store):
    submit(store, frame(spark, [row(1, 1, "claude", "a", 10), row(1, 1, "amp", "b", 5), row(1, 2, "amp", "b", 6)]), AS_OF)
    listed = spark.createDataFrame([(1, "claude"), (1, "amp")], "user_id bigint, source string")
    submit(store, frame(spark, [row(1, 1, "claude", "a", 11)]), AS_OF, submitted=listed)
    assert days_of(store) == [(1, 1, "claude", "a", 11), (1, 2, "amp", "b", 6)]


def test_other_users_buckets_stay_as_they_are(spark, store):
    """A merge writes the buckets of its users only: all other files are the same, unread and unwritten."""
    submit(store, frame(spark, [row(u, 1, "claude", "m", u + 1) for u in range(40)]), AS_OF)
    before, held = files_of(store), store.live()["tables"]["days"]
    submit(store, frame(spark, [row(7, 1, "claude", "m", 1000)]), AS_OF)
    after, now = files_of(store), store.live()["tables"]["days"]
    changed = {b for b in now if now[b] != held.get(b)}
    own = spark.createDataFrame([(7,)], "user_id bigint").select(store.bucket()).first()[0]
    assert changed == {str(own)} and len(held) > 4
    assert {f: t for f, t in before.items() if f"bucket={own}/" not in f} == {f: t for f, t in after.items() if f"bucket={own}/" not in f}
    assert days_of(store, 7) == [(7, 1, "claude", "m", 1000)] and store.read("days").count() == 40
    touched = store.read("days", buckets=[own])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in touched


def test_a_crash_before_the_switch_changes_nothing(spark, store, monkeypatch):
    submit(store, frame(spark, [row(1, 1, "claude", "a", 10)]), AS_OF)

    def crash(self, new):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", crash)
        with pytest.raises(OSError, match="lost"):
            submit(store, frame(spark, [row(1, 1, "claude", "a", 99)]), AS_OF, batch=("s", 0))
    assert days_of(store) == [(1, 1, "claude", "a", 10)] and store.live()["version"] == 1
    submit(store, frame(spark, [row(1, 1, "claude", "a", 99)]), AS_OF, batch=("s", 0))
    assert days_of(store) == [(1, 1, "claude", "a", 99)] and store.live()["version"] == 2
    assert len(store.sweep(keep=1)) == 2, "what the crash and the first version left"
    assert days_of(store) == [(1, 1, "claude", "a", 99)]


def test_a_batch_that_comes_again_changes_nothing(spark, store):
    rows = frame(spark, [row(1, 1, "claude", "a", 10)])
    assert submit(store, rows, AS_OF, batch=("s", 3)).version == 1
    assert submit(store, rows, AS_OF, batch=("s", 3)).version == submit(store, rows, AS_OF, batch=("s", 2)).version == 1
    assert store.read("submissions").first()["submit_count"] == 1
    assert submit(store, rows, AS_OF, batch=("t", 0)).version == 2 and store.live()["batches"] == {"s": 3, "t": 0}


def test_merges_that_came_first_are_kept(spark, store, monkeypatch):
    """Two merges begin from one version: the later one is done again on what the first left."""
    plain, seen = Store._switch, []

    def late(self, new):
        if not seen:
            seen.append(1)
            submit(store, frame(spark, [row(1, 1, "codex", "b", 7), row(2, 1, "claude", "c", 8)]), AS_OF)
        return plain(self, new)

    monkeypatch.setattr(Store, "_switch", late)
    done = submit(store, frame(spark, [row(1, 1, "claude", "a", 10)]), AS_OF)
    assert done.version == 2
    assert days_of(store) == [(1, 1, "claude", "a", 10), (1, 1, "codex", "b", 7), (2, 1, "claude", "c", 8)]
    assert {r["user_id"]: r["submit_count"] for r in store.read("submissions").collect()} == {1: 2, 2: 1}


def test_users_whose_rows_break_a_rule_are_refused_whole(spark, store):
    later = (3, datetime.date(2031, 1, 1), "claude", "m", 5, 1.0, 5, 0, 0, 0, 0, 1)
    done = submit(store, frame(spark, [row(1, 1, "claude", "a", 10), row(2, 1, "droid", "a", 10), row(2, 1, "amp", "a", 10), row(3, 1, "amp", "a", 10), later, row(4, 1, "amp", "a", -1)]), AS_OF)
    assert {r["submission_id"] for r in done.found.filter("severity = 'error'").collect()} == {2, 3, 4}
    assert days_of(store) == [(1, 1, "claude", "a", 10)]
    assert submit(store, frame(spark, []), AS_OF).version == 2 and days_of(store) == [(1, 1, "claude", "a", 10)]


def test_a_stream_of_submissions(spark, store, tmp_path):
    for rows in ([row(1, 1, "claude", "a", 10)], [row(1, 1, "claude", "a", 20), row(5, 2, "amp", "b", 1)]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = submit_stream(spark.readStream.schema(DAYS).parquet(str(tmp_path / "in")), store, AS_OF, "web", str(tmp_path / "state"))
        q.awaitTermination()
        assert q.exception() is None
    assert days_of(store) == [(1, 1, "claude", "a", 20), (5, 2, "amp", "b", 1)] and store.live()["batches"] == {"web": 1}


def test_buckets_of_a_store_stay_as_they_were_made(spark, store, tmp_path):
    submit(store, frame(spark, [row(1, 1, "claude", "a", 10)]), AS_OF)
    with pytest.raises(ValueError, match="8 buckets"):
        submission_store(spark, str(tmp_path / "store"), buckets=9).live()
    with pytest.raises(ValueError, match="don't touch"):
        store.merge(spark.createDataFrame([(1,)], "user_id bigint"), lambda old: {"days": frame(spark, [row(u, 1, "amp", "m", 1) for u in range(50)]), "submissions": old["submissions"]})
    assert days_of(store) == [(1, 1, "claude", "a", 10)]


def test_submit_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from meterglass.__main__ import main

    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    line = {"type": "assistant", "timestamp": "2024-12-02T00:00:00Z", "message": {"model": "o3", "usage": {"input_tokens": 10}}}
    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    (tmp_path / ".claude/projects/p/s1.jsonl").write_text(json.dumps(line))
    (tmp_path / "prices.json").write_text(json.dumps({"o3": {"input_cost_per_token": 0.01}}))
    args = ["submit", "--home", str(tmp_path), "--prices", str(tmp_path / "prices.json"), "--store", str(tmp_path / "s"), "--user", "9", "--as-of"]
    main([*args, "2025-01-01"])
    out = json.loads(capsys.readouterr().out)
    assert out["accepted"] and out["version"] == 1 and out["submission"][0]["total_tokens"] == 10 and float(out["submission"][0]["total_cost"]) == 0.1
    main([*args, "2024-01-01"])
    assert not json.loads(capsys.readouterr().out)["accepted"]
    with pytest.raises(SystemExit):
        main(["submit", "--home", str(tmp_path)])
    kept = submission_store(spark, str(tmp_path / "s"))
    assert kept.live()["version"] >= 1 and kept.read("submissions").select(F.sum("total_tokens")).first()[0] == 10
