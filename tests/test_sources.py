"""Session files of every tool: what becomes a message and what is dropped."""

import json

import pytest
from pyspark.sql import functions as F

from meterglass.operators import reports
from meterglass.operators.pricing import with_cost
from meterglass.sources import sessions
from meterglass.sources.files import is_graph_document, roots, scan_stats, tagged_listing
from meterglass.sources.prices import is_fresh, read_prices

CREATED = 1733011200000


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def opencode(**change):
    record = {
        "id": "1", "sessionID": "s", "role": "assistant", "modelID": "gpt-4o", "mode": "omo", "cost": 0.5,
        "tokens": {"input": 1000, "output": 500, "reasoning": 100, "cache": {"read": 200, "write": 50}}, "time": {"created": CREATED + 0.7},
    }
    return {k: v for k, v in {**record, **change}.items() if v is not None}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_opencode_keeps_complete_assistant_messages(spark, tmp_path):
    put(tmp_path, "a.json", opencode())
    put(tmp_path, "deep/er/b.json", opencode(role="user"))
    put(tmp_path, "c.json", opencode(modelID=None))
    put(tmp_path, "d.json", opencode(tokens={"input": "many"}))
    put(tmp_path, "e.json", "{broken")
    put(tmp_path, "f.txt", opencode())
    found = sessions.opencode(spark, str(tmp_path))
    assert rows(found, "model_id", "provider_id", "session_id", "timestamp_ms", "input", "reasoning", "cache_write", "cost", "agent") == [
        ("gpt-4o", "unknown", "s", CREATED, 1000, 100, 50, 0.5, "Sisyphus")
    ]
    assert str(found.first()["date"]) == "2024-12-01"


def test_claude_skips_bad_lines_and_keeps_repeats(spark, tmp_path):
    good = json.dumps({"type": "assistant", "timestamp": "2024-12-01T00:00:00.000Z", "message": {"model": "m", "usage": {"input_tokens": 1}}})
    lines = [good, "junk", good[:-9], good, "", good.replace("assistant", "user"), good.replace("2024-12-01T00:00:00.000Z", "yesterday")]
    put(tmp_path, "p/session-1.jsonl", "\n".join(lines))
    found = sessions.claude(spark, str(tmp_path))
    assert rows(found, "session_id", "provider_id", "input", "output") == [("session-1", "anthropic", 1, 0)] * 2


def codex_line(kind, **payload):
    return json.dumps({"type": kind, "timestamp": "2024-12-01T00:00:00Z", "payload": payload})


def usage(i, o, c=0):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c}


def test_codex_uses_last_usage_then_growth_of_totals(spark, tmp_path):
    count = {"type": "token_count"}
    put(
        tmp_path,
        "2024/a.jsonl",
        "\n".join(
            [
                codex_line("turn_context", model="gpt-5"),
                codex_line("event_msg", **count, info={"total_token_usage": usage(5, 5)}),  # nothing known yet
                codex_line("event_msg", **count, info={"last_token_usage": usage(10, 1), "total_token_usage": usage(10, 1)}),
                codex_line("event_msg", **count, info={"total_token_usage": usage(30, 4, 2)}),
                codex_line("event_msg", **count, info={"total_token_usage": usage(30, 4, 2)}),  # no growth
                codex_line("turn_context"),  # names no model
                codex_line("event_msg", **count, info={"last_token_usage": usage(7, 0)}),
            ]
        ),
    )
    put(tmp_path, "2024/b.jsonl", codex_line("event_msg", **count, info={"total_token_usage": usage(5, 5)}))
    found = sessions.codex(spark, str(tmp_path))
    assert rows(found, "model_id", "input", "output", "cache_read") == [("gpt-5", 10, 1, 0), ("gpt-5", 20, 3, 2), ("unknown", 7, 0, 0)]


def gemini(**message):
    entry = {"id": "1", "type": "gemini", "timestamp": "2024-12-01T00:00:00Z", "content": "hi", "model": "gemini-2.5-pro", "tokens": {"input": 3, "cached": 2, "thoughts": 1}}
    return {"sessionId": "g", "projectHash": "h", "startTime": "x", "lastUpdated": "y", "messages": [{**entry, **message}]}


def test_gemini_drops_documents_with_strange_content(spark, tmp_path):
    put(tmp_path, "session-1.json", gemini())
    put(tmp_path, "session-2.json", gemini(content={"parts": []}))
    put(tmp_path, "session-3.json", gemini(type="user"))
    put(tmp_path, "session-4.json", {**gemini(), "startTime": None})
    put(tmp_path, "other.json", gemini())
    assert rows(sessions.gemini(spark, str(tmp_path)), "session_id", "input", "cache_read", "reasoning") == [("g", 3, 2, 1)]


def test_amp_prefers_a_usable_ledger(spark, tmp_path):
    said = [{"role": "assistant", "messageId": 2, "usage": {"model": "claude-x", "inputTokens": 5, "credits": 0.25}}]
    event = {"timestamp": "2024-12-01T00:00:00Z", "model": "o3", "credits": 1.5, "tokens": {"input": 9}}
    put(tmp_path, "T-1.json", {"id": "t1", "created": CREATED, "usageLedger": {"events": [event]}, "messages": said})
    put(tmp_path, "T-2.json", {"created": CREATED, "usageLedger": {"events": [{**event, "timestamp": "?"}]}, "messages": said})
    found = sessions.amp(spark, str(tmp_path))
    assert rows(found, "session_id", "provider_id", "timestamp_ms", "input", "cost") == [
        ("T-2", "anthropic", CREATED + 2000, 5, 0.25),
        ("t1", "openai", CREATED, 9, 1.5),
    ]


def test_droid_finds_a_model_for_settings_without_one(spark, tmp_path):
    used = {"inputTokens": 1, "thinkingTokens": 2}
    put(tmp_path, "a.settings.json", {"model": "custom:Claude-Opus-4.5-Thinking-[Anthropic]-0", "tokenUsage": used, "providerLockTimestamp": "2024-12-01T00:00:00Z"})
    put(tmp_path, "b.settings.json", {"providerLock": "openai", "tokenUsage": used})
    put(tmp_path, "b.jsonl", '{"x": 1}\n{"text": "Model: GPT 5.1 [OpenAI]"}\n{"text": "Model: later"}')
    put(tmp_path, "c.settings.json", {"providerLock": "xai", "tokenUsage": used})
    put(tmp_path, "d.settings.json", {"model": "x", "tokenUsage": {"inputTokens": 0}})
    found = sessions.droid(spark, str(tmp_path))
    assert rows(found, "session_id", "model_id", "provider_id", "reasoning") == [
        ("a", "claude-opus-4-5-thinking-0", "anthropic", 2),
        ("b", "gpt 5-1", "openai", 2),
        ("c", "grok-unknown", "xai", 2),
    ]
    assert found.filter("timestamp_ms <= 0").count() == 0


def test_cursor_reads_both_layouts(spark, tmp_path):
    put(tmp_path, "old.csv", "Date,Model,A,B,C,D,E,Cost,You\n2025-02-05,gpt-4o,10,5,0,15,30,$0.10,$0\nshort,row\n2025-02-05,,1,1,1,1,1,$1,$1\n")
    put(
        tmp_path,
        "new.csv",
        "Date,Kind,Model,Max Mode,A,B,C,D,Total,Cost\n"
        '"2025-11-01T10:00:00.000Z","Included","auto","No","28342","775","105891","21282","156290","1,234.56"\n'
        '"when","Included","auto","No","1","1","1","1","4","1"\n',
    )
    put(tmp_path, "no.csv", "A,B\n1,2\n")
    found = sessions.cursor(spark, str(tmp_path))
    assert rows(found, "model_id", "provider_id", "input", "output", "cache_read", "cache_write", "cost") == [
        ("auto", "cursor", 775, 21282, 105891, 27567, 1234.56),
        ("gpt-4o", "openai", 5, 15, 0, 5, 0.10),
    ]
    assert rows(found.filter("model_id = 'gpt-4o'"), F.hour(F.timestamp_millis("timestamp_ms")).alias("h")) == [(12,)]


def test_loading_and_scanning_a_home_folder(spark, tmp_path):
    where = roots(str(tmp_path), environ={})
    put(tmp_path, f"{where['opencode'][len(str(tmp_path)) + 1:]}/x.json", opencode())
    stats = dict(rows(scan_stats(spark, where), "source", "files"))
    assert stats == {"opencode": 1, "claude": 0, "codex": 0, "gemini": 0, "cursor": 0, "amp": 0, "droid": 0}
    usage = sessions.load_usage(spark, str(tmp_path), environ={})
    assert usage.count() == 1
    assert sessions.load_usage(spark, str(tmp_path), []).count() == 0
    assert roots("/h", ["codex"], {"CODEX_HOME": "/c"}) == {"codex": "/c/sessions"}


def test_prices_from_json(spark, tmp_path):
    put(tmp_path, "p.json", {"anthropic/claude-3-5-sonnet-20241022": {"input_cost_per_token": 3e-6, "output_cost_per_token": 15e-6, "cache_read_input_token_cost": 3e-7, "cache_creation_input_token_cost": 3.75e-6, "mode": "chat"}, "free": {}})
    prices = read_prices(spark, str(tmp_path / "p.json"))
    assert prices.count() == 2
    message = [("claude", "claude-3-5-sonnet-20241022", 1000, 500, 2000, 100, 0, 0.0), ("claude", None, 1, 1, 1, 1, 1, 9.0)]
    df = spark.createDataFrame(message, "source string, model_id string, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, cost double")
    costs = sorted(r["cost"] for r in with_cost(df, prices).collect())
    assert costs == pytest.approx([0, 0.011475], abs=1e-6)
    assert is_fresh(1000, 2000) and not is_fresh(0, 3_600_000)


def test_cursor_by_name(spark, tmp_path):
    """Columns in any order and number; what was paid goes before what it would cost; a bad date stays with time 0."""
    put(tmp_path, "a.csv", "\n".join([
        'Model,Date,Cost,Cost to you,"Input (w/ Cache Write)",Input (w/o Cache Write),Cache Read,Output Tokens,Extra',
        'gpt-4o,2025-06-01,"$1,000.50",$0.25,10,4,3,2', "o3,2025-06-01T10:00:00Z,$0.40,$0.00,1,5,x,7abc,more,fields",
        "claude-3,2025-06-40 late,0.5,,,,,", ",2025-06-01,1,1,1,1,1,1", "", "o3,,1,1,1,1,1,1",
    ]))
    put(tmp_path, "deep/b.csv", "Date,Model,API Cost\n2025-06-02,auto,$3")
    put(tmp_path, "c.csv", "When,Model\n2025-06-02,auto")
    got = sessions.cursor_by_name(spark, str(tmp_path))
    assert rows(got, "model_id", "provider_id", "session_id", "timestamp_ms", "input", "output", "cache_read", "cache_write", "cost") == [
        ("auto", "cursor", "cursor-2025-06-02-auto", 1748822400000, 0, 0, 0, 0, 3.0),
        ("claude-3", "anthropic", "cursor-2025-06-40-claude-3", 0, 0, 0, 0, 0, 0.5),
        ("gpt-4o", "openai", "cursor-2025-06-01-gpt-4o", 1748736000000, 4, 2, 3, 6, 0.25),
        ("o3", "openai", "cursor-2025-06-01-o3", 1748772000000, 5, 7, 0, 0, 0.4),
    ]
    by_model = reports.cursor_by_model(got).collect()
    assert [(r["model_id"], r["messages"], r["cost"]) for r in by_model][:2] == [("auto", 1, 3.0), ("claude-3", 1, 0.5)]


def test_logs_are_read_by_line_in_their_order(spark, tmp_path):
    """A log of many blocks gives the same as one of a single block."""
    lines, total = [], 0
    for n in range(3000):
        total += n % 7
        use = {"input_tokens": total, "output_tokens": 0}
        lines.append(json.dumps({"type": "turn_context", "payload": {"model": f"m{n // 100}"}} if n % 100 == 0 else {"type": "event_msg", "timestamp": "2025-06-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": use} | ({"last_token_usage": use} if n == 1 else {})}}))
        lines.append('{"type": "other"}')
    put(tmp_path, "log.jsonl", "\n".join(lines))
    whole = rows(sessions.codex(spark, str(tmp_path)).groupBy("model_id").agg(F.sum("input").alias("n")), "model_id", "n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        blocks = rows(sessions.codex(spark, str(tmp_path)).groupBy("model_id").agg(F.sum("input").alias("n")), "model_id", "n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == blocks and len(whole) == 30 and sum(n for _, n in whole) > 0


def test_tagged_listing_and_graph_documents(spark, tmp_path):
    put(tmp_path, "x/.claude/projects/a.jsonl", "{}")
    where = roots(str(tmp_path / "x"), ["claude", "amp"], {})
    assert [(s, p.rsplit("/", 1)[1]) for s, p in rows(tagged_listing(spark, where), "source", "path")] == [("claude", "a.jsonl")]
    good = {"meta": {}, "summary": {}, "years": [], "contributions": [{}]}
    cases = [(good, True), ({**good, "meta": None}, True), ({**good, "years": {}}, False), ({k: v for k, v in good.items() if k != "summary"}, False), ({**good, "meta": "x"}, False), ([], False)]
    texts_ = [json.dumps(c) for c, _ in cases] + ["no json", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string")
    got = [r["ok"] for r in frame.select("i", is_graph_document(F.col("t")).alias("ok")).orderBy("i").collect()]
    assert got == [ok for _, ok in cases] + [False, False]


def test_scans_list_hidden_folders_and_count_unreadable_ones(spark, tmp_path):
    """Folders at any depth, hidden ones too; links are not followed; a root that is no folder can't be read, a missing one is empty."""
    root = tmp_path / "home"
    for folder in (".x", "_y/deep/er", "plain", "with space"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a.jsonl").write_text("x" * 5)
        (root / folder / "b.txt").write_text("")
    (root / "plain" / "link").symlink_to(root)
    (root / "A.JSONL").write_text("")
    (tmp_path / "file").write_text("")
    where = {"claude": str(root), "codex": f"file://{root}/_y", "amp": str(tmp_path / "missing"), "cursor": str(tmp_path / "file")}
    assert sorted(rows(scan_stats(spark, where), "source", "files", "unreadable")) == [("amp", 0, 0), ("claude", 4, 0), ("codex", 1, 0), ("cursor", 0, 1)]
    found = rows(tagged_listing(spark, where), "source", "path")
    assert sorted(p.removeprefix(f"file://{root}/") for s, p in found if s == "claude") == [".x/a.jsonl", "_y/deep/er/a.jsonl", "plain/a.jsonl", "with space/a.jsonl"]
    assert [p for s, p in found if s == "codex"] == [f"file://{root}/_y/deep/er/a.jsonl"]
    assert scan_stats(spark, {}).count() == 0
