"""What the events of running logs used, as they are appended: ``usage_deltas`` with its state between batches.

Per log the state is the model set last, the latest total and whether an event with both kinds of
numbers has been seen: five values, however long the log is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterglass.session import ship_package
from meterglass.sources.files import PLACES
from meterglass.sources.logs import BLOCK, log_stream
from meterglass.sources.sessions import codex_events, codex_messages

#: The session's setting and its value that state which ends needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KINDS = ("input", "output", "cached")
STATE = "model string, seen boolean, armed boolean, " + ", ".join(f"{k} bigint" for k in KINDS)
OUT = "path string, pos bigint, timestamp string, model_id string, " + ", ".join(f"{k} bigint" for k in KINDS)


def _latest(mine: np.ndarray, before: bool) -> np.ndarray:
    """For each row the place of the last marked row up to it, or before it; -1 without one."""
    at = np.maximum.accumulate(np.where(mine, np.arange(len(mine)), -1))
    return np.r_[-1, at[:-1]] if before else at


def _step(path: str, frames, before):
    """A log's new events in their order: uses of something, and the state after them."""
    rows = pd.concat(list(frames)).sort_values("pos", kind="stable").reset_index(drop=True)
    model, seen, armed, *total = before or (None, False, False, 0, 0, 0)
    usage = rows["is_usage"].to_numpy(bool)
    sets = rows["sets_model"].to_numpy(bool)
    totals = rows[[f"total_{k}" for k in KINDS]]
    own = rows[[f"last_{k}" for k in KINDS]]
    has_total, has_last = usage & totals.notna().all(axis=1).to_numpy(), usage & own.notna().all(axis=1).to_numpy()
    # The state stands before the first row.
    known = np.vstack([np.array(total, np.int64), totals.fillna(0).to_numpy(np.int64)])
    at = _latest(has_total, before=True)
    both = np.logical_or.accumulate(np.r_[armed, has_total & has_last])
    grows = ~has_last & has_total & both[:-1] & ((at >= 0) | seen)
    used = np.where(has_last[:, None], own.fillna(0).to_numpy(np.int64), np.maximum(known[1:] - known[at + 1], 0))
    names = np.array([model, *rows["model"]], object)
    set_at = _latest(sets, before=False)
    kept = (has_last | grows) & (used != 0).any(axis=1)
    after = before
    if len(rows):
        last = _latest(has_total, before=False)[-1]
        now = names[set_at[-1] + 1]
        after = (None if pd.isna(now) else now, bool(seen or last >= 0), bool(both[-1]), *(int(x) for x in known[last + 1]))
    named = [("unknown" if pd.isna(m) else m) for m in names[set_at + 1]]
    out = pd.DataFrame({"path": path, "pos": rows["pos"], "timestamp": rows["timestamp"], "model_id": named})
    for n, k in enumerate(KINDS):
        out[k] = used[:, n]
    return out[kept], after


def _kept_for_ever(key, frames, state: GroupState):
    out, after = _step(key[0], frames, state.get if state.exists else None)
    if after is not None:
        state.update(after)
    yield out


class _Log(StatefulProcessor):
    """The state of a log, which is forgotten once it has not changed for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log", STATE, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        out, after = _step(key[0], rows, self.state.get() if self.state.exists() else None)
        if after is not None:
            self.state.update(after)
        yield out

    def close(self) -> None:
        pass


def delta_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """path, pos, timestamp, model_id, input, output, cached of a stream of events, in append mode.

    ``events`` has path, pos (bigint), sets_model, model, is_usage and last and total, structs of
    KINDS, as ``usage_deltas`` takes them, and may have a timestamp. A log's events come in order over
    the batches, as lines appended to it do; within a batch they may come in any.

    State is kept for ever, or for ``keep_ms`` of a log's silence: what is appended later is taken as a
    new log, so its first total only says where it stands. That needs RocksDB as the session's store of
    states (STORE).
    """
    ship_package(events.sparkSession)
    stamp = "timestamp" if "timestamp" in events.columns else "cast(null AS string) AS timestamp"
    flat = events.selectExpr(
        "path", "pos", stamp, "coalesce(sets_model, false) AS sets_model", "model", "coalesce(is_usage, false) AS is_usage",
        *[f"{side}.{k} AS {side}_{k}" for side in ("last", "total") for k in KINDS],
    ).groupBy("path")
    if keep_ms is None:
        return flat.applyInPandasWithState(_kept_for_ever, OUT, STATE, "append", "NoTimeout")
    return flat.transformWithStateInPandas(_Log(keep_ms), OUT, "append", "ProcessingTime")


def codex_stream(spark: SparkSession, root: str, keep_ms: int | None = None, block: int = BLOCK) -> DataFrame:
    """The messages of the running logs below ``root`` as lines are appended to them: ``codex`` as a stream."""
    deltas = delta_stream(codex_events(log_stream(spark, root, PLACES["codex"].pattern, block)), keep_ms)
    return codex_messages(deltas.withColumn("used", F.struct(*KINDS))).drop("path")
