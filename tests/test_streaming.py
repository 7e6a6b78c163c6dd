"""Logs that grow: lines once and whole, restarts, deltas as in batch, state that ends."""

import io
import json
import random
import time

from pyspark.sql import functions as F

from meterglass.sources import logs, sessions
from meterglass.streaming import codex as running


def lines_of(data, start, end):
    return list(logs.finished_lines(io.BytesIO(data), start, end))


def test_every_line_lies_in_one_block(monkeypatch):
    """Cut anywhere and read in pieces of any size, blocks have each finished line once, with its place."""
    rng = random.Random(7)
    for piece in (1, 3, 1 << 20):
        monkeypatch.setattr(logs, "PIECE", piece)
        for _ in range(60):
            data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\xc3\xbc"]) for _ in range(rng.randint(0, 80)))
            cuts = sorted({0, len(data), *[rng.randint(0, len(data)) for _ in range(rng.randint(0, 5))]})
            want, pos = [], 0
            for line in data.split(b"\n")[:-1]:
                want.append((pos, line))
                pos += len(line) + 1
            assert [x for i, j in zip(cuts, cuts[1:]) for x in lines_of(data, i, j)] == want


def run_once(frame, tmp_path, name="out"):
    q = frame.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_appended_lines_arrive_once_over_restarts(spark, tmp_path):
    """Half lines wait for their end; files in hidden folders count; one that is shorter than before is read anew."""
    root = tmp_path / "logs"
    (root / ".hidden" / "deep").mkdir(parents=True)
    (root / "_y").mkdir()
    files = [root / "a.jsonl", root / ".hidden" / "deep" / "b.jsonl", root / "_y" / "c.jsonl"]
    for f in files:
        f.write_bytes(b"one\ntwo\nth")
    (root / "other.txt").write_bytes(b"no\n")

    def batch():
        run_once(logs.log_stream(spark, str(root), block=5), tmp_path)
        return sorted((r["path"].rsplit("/", 1)[1], r["pos"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [(n, p, v) for n in ("a.jsonl", "b.jsonl", "c.jsonl") for p, v in ((0, "one"), (4, "two"))]
    assert batch() == first
    assert batch() == first, "nothing was appended"
    with files[0].open("ab") as f:
        f.write("ree\r\nfünf\n".encode())
    assert batch() == sorted([*first, ("a.jsonl", 8, "three"), ("a.jsonl", 15, "fünf")])
    files[1].write_bytes(b"new\n")
    files[2].unlink()
    assert batch() == sorted([*first, ("a.jsonl", 8, "three"), ("a.jsonl", 15, "fünf"), ("b.jsonl", 0, "new")])


def test_a_batch_that_is_run_again_has_the_same_lines(tmp_path):
    """What lies between two offsets does not depend on what the file has become."""
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"a\nbb\nccc")
    reader = logs.LogReader({"path": str(tmp_path), "block": "2"})
    start = reader.latestOffset()
    path.write_bytes(b"a\nbb\nccc\ndd\ne")
    end = reader.latestOffset()
    read = lambda: [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert read() == ["ccc", "dd"]
    with path.open("ab") as f:
        f.write(b"e\nmore\n")
    assert read() == ["ccc", "dd"]
    assert logs.LogReader({"path": str(tmp_path / "missing")}).latestOffset() == {}
    path.unlink()
    assert read() == []


def codex_line(rng, total):
    kind = rng.random()
    if kind < 0.2:
        return {"type": "turn_context", "payload": {"model": rng.choice(["gpt-5", "o3", ""])}}
    if kind < 0.3:
        return {"type": "response_item", "payload": {"text": "event_msg x"}}
    usage = lambda n: {"input_tokens": n[0], "output_tokens": n[1], "cached_input_tokens": n[2]}
    own = [rng.randint(0, 9) for _ in range(3)]
    total[:] = [t + n for t, n in zip(total, own)]
    info = {"total_token_usage": usage(total)}
    if rng.random() < 0.4:
        info["last_token_usage"] = usage(own)
    return {"type": "event_msg", "timestamp": f"2025-01-01T00:00:{rng.randint(10, 59)}Z", "payload": {"type": "token_count", "info": info}}


def test_streamed_messages_are_those_of_a_batch_over_the_whole_logs(spark, tmp_path):
    rng, root = random.Random(5), tmp_path / "sessions"
    (root / "2025").mkdir(parents=True)
    texts = {}
    for name in ("2025/a", "b"):
        total = [0, 0, 0]
        texts[root / f"{name}.jsonl"] = "".join(json.dumps(codex_line(rng, total)) + "\n" for _ in range(120)).encode()
    for share in (0.13, 0.5, 0.51, 1.0):
        for path, data in texts.items():
            path.write_bytes(data[: int(len(data) * share)])
        run_once(running.codex_stream(spark, str(root), block=700), tmp_path)
    whole = sessions.codex(spark, str(root))
    got = spark.read.parquet(str(tmp_path / "out")).select(whole.columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(whole) and whole.count() > 60


def test_blocks_of_a_log_give_what_the_whole_log_gives(spark):
    """Parts without anything to leave behind, of one event, and logs of one part; no window over a whole log's events."""
    rng, rows = random.Random(12), []
    number = lambda: (rng.randint(0, 9), rng.randint(0, 3), rng.randint(0, 2))
    for path in ("a", "b", "c", None):
        total = [0, 0, 0]
        for pos in range(90):
            total = [t + n for t, n in zip(total, number())] if rng.random() < 0.9 else [0, 0, 0]
            sets, usage = rng.random() < 0.1, rng.random() < 0.7
            rows.append((path, pos, sets, rng.choice(["m1", "m2", None]) if sets else None, usage, number() if usage and rng.random() < 0.2 else None, tuple(total) if rng.random() < 0.5 else None))
    use = "struct<input: bigint, output: bigint, cached: bigint>"
    events = spark.createDataFrame(rows, f"path string, pos bigint, sets_model boolean, model string, is_usage boolean, last {use}, total {use}").repartition(4)
    plain = sorted(map(str, sessions.usage_deltas(events).collect()))
    for size in (1, 7, 1000):
        got = sessions.usage_deltas(events, block=F.floor(F.col("pos") / size))
        assert sorted(map(str, got.select(sessions.usage_deltas(events).columns).collect())) == plain
    plan = got._jdf.queryExecution().executedPlan().toString()
    events_windows = [x for x in plan.splitlines() if "Window" in x and "lag" not in x and "is_usage" in x]
    assert all("part#" in x for x in events_windows)


def test_a_log_in_blocks_is_read_by_many_tasks(spark, tmp_path):
    """One log of many blocks has no task with more than a block's events."""
    rng, total = random.Random(1), [0, 0, 0]
    (tmp_path / "big.jsonl").write_text("".join(json.dumps(codex_line(rng, total)) + "\n" for _ in range(3000)))
    whole = sorted(map(str, sessions.codex(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        cut = sessions.codex(spark, str(tmp_path))
        kept = sessions.lines(spark, str(tmp_path), "*.jsonl")
        assert kept.select("pos.block").distinct().count() > 20
        assert kept.filter("split").count() == 3000
        assert sorted(map(str, cut.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_state_ends_with_its_time_to_live(spark, tmp_path):
    """A log that is silent for longer than its state is kept begins anew; one that goes on keeps its state."""
    usage = lambda n: {"input_tokens": n, "output_tokens": 0, "cached_input_tokens": 0}
    line = lambda n, own=None: json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(n)} | ({"last_token_usage": usage(own)} if own else {})}}) + "\n"
    spark.conf.set(*running.STORE)
    try:
        for keep, name in ((2_000, "short"), (3_600_000, "long")):
            root = tmp_path / name
            root.mkdir()
            log = root / "a.jsonl"
            log.write_text(line(10, 10) + line(25))
            run_once(running.codex_stream(spark, str(root), keep), tmp_path, f"out-{name}")
            if name == "short":
                time.sleep(3)
            with log.open("a") as f:
                f.write(line(40))
            run_once(running.codex_stream(spark, str(root), keep), tmp_path, f"out-{name}")
            got = [r["input"] for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()]
            # Fresh state has seen no event with both numbers: a total alone says nothing there.
            assert sorted(got) == ([10, 15] if name == "short" else [10, 15, 15])
    finally:
        spark.conf.unset(running.STORE[0])
