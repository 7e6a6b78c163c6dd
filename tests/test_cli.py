"""The command line over a home folder with files of two tools."""

import json

import pytest

from meterglass.__main__ import arguments, main


@pytest.fixture
def home(tmp_path):
    message = {
        "id": "1", "sessionID": "s", "role": "assistant", "modelID": "gpt-4o", "providerID": "openai",
        "tokens": {"input": 1000, "output": 500, "cache": {"read": 0, "write": 0}}, "time": {"created": 1733011200000.0},
    }
    folder = tmp_path / ".local/share/opencode/storage/message"
    folder.mkdir(parents=True)
    (folder / "m.json").write_text(json.dumps(message))
    line = {"type": "assistant", "timestamp": "2024-12-02T00:00:00Z", "message": {"model": "o3", "usage": {"input_tokens": 10}}}
    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    (tmp_path / ".claude/projects/p/s1.jsonl").write_text(json.dumps(line))
    (tmp_path / "prices.json").write_text(json.dumps({"openai/gpt-4o": {"input_cost_per_token": 0.001}, "o3": {"input_cost_per_token": 0.01}}))
    return tmp_path


def run(capsys, home, *args):
    main([*args, "--home", str(home), "--prices", str(home / "prices.json")])
    return json.loads(capsys.readouterr().out)


def test_reports(spark, home, capsys, monkeypatch):
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    models = run(capsys, home, "models")["entries"]
    assert [(m["model_id"], m["cost"]) for m in models] == [("gpt-4o", 1.0), ("o3", 0.1)]
    assert [m["model_id"] for m in run(capsys, home, "models", "--claude")["entries"]] == ["o3"]
    months = run(capsys, home, "monthly", "--since", "2024-12-02")["entries"]
    assert [(m["month"], m["models"], m["input"]) for m in months] == [("2024-12", ["o3"], 10)]
    graph = run(capsys, home, "graph")
    assert [(d["date"], d["intensity"]) for d in graph["contributions"]] == [("2024-12-01", 4), ("2024-12-02", 1)]
    scan = {s["source"]: s["files"] for s in run(capsys, home, "scan")["sources"]}
    assert scan["opencode"] == scan["claude"] == 1 and sum(scan.values()) == 2
    review = run(capsys, home, "review")
    assert review["favouriteModel"] == [{"favourite_model": "gpt-4o"}] and review["topModels"][0]["model_id"] == "gpt-4o"
    assert review["longestStreak"] == [{"longest_streak": 2}] and review["topAgents"] == [] and len(review["grid"]) > 364
    assert run(capsys, home, "models", "--today")["entries"] == []
    out = run(capsys, home, "export")
    assert (out["modelCount"], out["totalCost"], out["stats"]["longest_streak"]) == (2, 1.1, 2)
    assert [d["date"] for d in out["daily"]] == ["2024-12-02", "2024-12-01"]


def test_tables(spark, home, capsys, monkeypatch):
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    lines = lambda *args: (main([*args, "--home", str(home), "--prices", str(home / "prices.json")]), capsys.readouterr().out.splitlines())[1]
    wide, narrow = lines("monthly", "--table", "120"), lines("monthly", "--table", "80")
    assert wide[0].split() == ["Month", "Models", "Input", "Output", "Cache", "Write", "Cache", "Read", "Total", "Cost"]
    assert wide[1].split() == ["2024-12", "-", "gpt-4o", "1,010", "500", "0", "0", "1,510", "$1.10"] and wide[2].split() == ["-", "o3"]
    assert wide[3].split() == ["Total", "1,010", "500", "0", "0", "1,510", "$1.10"]
    assert narrow[0].split() == ["Month", "Models", "Input", "Output", "Cost"] and narrow[-1].split() == ["Total", "1,010", "500", "$1.10"]


def test_arguments():
    with pytest.raises(SystemExit):
        arguments().parse_args(["models"])
