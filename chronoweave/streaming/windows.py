"""The same windows over a stream or a table; a watermark bounds the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def metric_windows(events: DataFrame, late: str = LATE) -> DataFrame:
    """Sliding minute means of each metric, every ten seconds."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "event_type")
    return g.agg(F.avg("value").alias("avg_value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "avg_value", "n")


def task_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def without_repeats(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def consecutive_changes(events: DataFrame, key: str = "user_id", value: str = "event_type", late: str = LATE, idle_seconds: int = 86_400) -> DataFrame:
    """Rows whose value differs from the one before of their key: a detector with the last value as its state.

    A key without rows for ``idle_seconds`` of event time is forgotten, so state doesn't grow with all keys ever seen;
    its next row counts as a change.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        before = rows[value].shift(1, fill_value=state.get[0] if state.exists else None)
        changed = rows[rows[value].ne(before)]
        state.update((rows[value].iloc[-1],))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame({key: k[0], "ts": changed["ts"], value: changed[value]})

    kind = dict(events.dtypes)[key]
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, {value} string", "last string", "append", GroupStateTimeout.EventTimeTimeout)
