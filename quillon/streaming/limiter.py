"""The sliding-window limiter as a stateful stream: the accepted times of each key are its state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts double, seq long, accepted boolean, used int, retry_after int"


def decide(held: list[float], now: float, limit: int, window: float, keep_edge: bool) -> tuple[list[float], bool, int | None]:
    """The times still held, whether this attempt is accepted, and the seconds to wait if not."""
    held = [t for t in held if (now - t <= window if keep_edge else now - t < window)]
    if len(held) < limit:
        return [*held, now], True, None
    return held, False, max(1, math.ceil(window - (now - held[0])))


def limited(attempts: DataFrame, limit: int, window: float = 60.0, keep_edge: bool = False) -> DataFrame:
    """attempts: key, ts (seconds), seq, event_time with a watermark -> decisions.  A key's state holds `limit` times
    at most and goes once the watermark has passed its last one by a window."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows, last = [], 0
        whole = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for ts, seq, at in zip(whole["ts"], whole["seq"], whole["event_time"], strict=True):
            held, ok, wait = decide(held, float(ts), limit, window, keep_edge)
            rows.append((key[0], float(ts), int(seq), ok, len(held), wait))
            last = max(last, int(at.timestamp() * 1000))
        state.update((held,))
        state.setTimeoutTimestamp(max(last + int(window * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(rows, columns=["key", "ts", "seq", "accepted", "used", "retry_after"])
        yield out.astype({"retry_after": "Int32"})

    return attempts.groupBy("key").applyInPandasWithState(run, OUT, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
