"""Query histories as state of a stream: each user's newest queries, kept while the user comes back.

The batch operator (operators.client.history) numbers all queries of a table. Here they come in micro-batches, in any
order of files; a user's state is their newest KEPT queries, so it stays bounded, and is dropped when the watermark
has passed it by IDLE. What changed goes out as the user's whole new history, so the last row of a user says it all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Queries of a user that are kept, and milliseconds without one after which a user is forgotten.
KEPT, IDLE = 50, 30 * 24 * 3600 * 1000
HISTORY = "user long, version long, entries array<struct<ts:long,seq:long,query:string>>"
_STATE = "version long, ts array<long>, seq array<long>, query array<string>"


def newest(entries: list[tuple[int, int, str]], kept: int = KEPT) -> list[tuple[int, int, str]]:
    """The newest entries (ts, seq, query), each (ts, seq) once: a file that is read again adds nothing."""
    return sorted({(ts, seq): (ts, seq, query) for ts, seq, query in entries}.values(), key=lambda e: e[:2], reverse=True)[:kept]


def histories(asked: DataFrame, kept: int = KEPT, idle: int = IDLE, late: str = "30 days") -> DataFrame:
    """A stream of (user, version, entries), entries newest first, of a stream of (user, ts, seq, query), ts in
    milliseconds. Rows older than the watermark are late and left out, as for any stream's state."""

    def update(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, *columns = state.get if state.exists else (0, [], [], [])
        entries = list(zip(*columns, strict=True))
        for frame in frames:  # a user's rows of a batch, in pieces
            entries = newest([*entries, *zip(frame["ts"].tolist(), frame["seq"].tolist(), frame["query"].tolist(), strict=True)], kept)
        ts, seq, query = (list(c) for c in zip(*entries, strict=True))
        state.update((version + 1, ts, seq, query))
        state.setTimeoutTimestamp(max(ts[0], state.getCurrentWatermarkMs()) + idle)
        rows = [{"ts": a, "seq": b, "query": c} for a, b, c in entries]
        yield pd.DataFrame({"user": [key[0]], "version": [version + 1], "entries": [rows]})

    timed = asked.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy("user").applyInPandasWithState(update, HISTORY, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
