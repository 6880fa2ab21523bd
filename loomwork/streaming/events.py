"""Windows, deduplication and rate limits over streams (or tables) of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of tumbling or sliding windows; events later than late are dropped once their windows are out."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, length, slide or length), *by).count().select(F.col("window.start").alias("window_start"), *by, "count")


def session_counts(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end gap after their last event."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap), *by).count().select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "count")


def once(events: DataFrame, ts: str, key: list[str], ttl: str) -> DataFrame:
    """The first event of each key within ttl: single-use nonces, tasks scheduled once."""
    if not events.isStreaming:
        raise ValueError("a table has no arrival order; keep the first of each key by min_by")
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def rate_limited(events: DataFrame, key: str, ts: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, ts, accepted) of a stream: an event is accepted if fewer than limit accepted ones lie in the seconds before it.

    Rejected events take no room in the window. State of a key: the times of at most limit accepted events.
    """
    kind = events.schema[key].dataType.simpleString()

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        times = sorted(t for b in batches for t in b[ts])
        accepted = []
        for t in times:
            now = t.value // 1_000_000
            taken = [x for x in taken if x > now - seconds * 1000]
            accepted.append(len(taken) < limit)
            if accepted[-1]:
                taken.append(now)
        state.update((taken,))
        yield pd.DataFrame({key: [k[0]] * len(times), ts: times, "accepted": accepted})

    return events.select(key, F.col(ts).cast("timestamp").alias(ts)).groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, {ts} timestamp, accepted boolean", "taken array<long>", "append", GroupStateTimeout.NoTimeout)


def failure_locks(events: DataFrame, key: str, ts: str, length: int = 900_000, most: int = 10, late: str = "10 minutes") -> DataFrame:
    """(key, window_start, failures, locked_at, locked_until) of a stream of failures, in milliseconds: a row for each window once the watermark has passed its end.

    State of a key: its open windows' times that are not yet certain, which a timer on the watermark bounds. A window begins with the first
    failure that is in none; rows are those that locks.failure_windows gives for the same failures as a table. Failures later
    than late are dropped.
    """
    kind = events.schema[key].dataType.simpleString()

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted((list(state.get[0]) if state.exists else []) + [t.value // 1_000_000 for b in batches for t in b[ts]])
        now, rows = state.getCurrentWatermarkMs(), []
        while times and times[0] + length <= now:
            own = [t for t in times if t < times[0] + length]
            at = own[most - 1] if len(own) >= most else None
            rows.append((k[0], own[0], len(own), at, None if at is None else own[-1] + length))
            times = times[len(own) :]
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max(times[0] + length, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, "window_start", "failures", "locked_at", "locked_until"]).astype({"locked_at": "Int64", "locked_until": "Int64"})

    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts)).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    schema = f"{key} {kind}, window_start long, failures long, locked_at long, locked_until long"
    return rows.groupBy(key).applyInPandasWithState(judge, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
