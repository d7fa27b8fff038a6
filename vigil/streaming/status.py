"""State of places as a stream: activations and deactivations by key, with expiry by event-time timers; events with locations."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "place_id long, status_code string, change string, at timestamp"
_STATE = "event_at timestamp, event_id long, action string"


def _ms(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


def status_changes(history: DataFrame, ttl: timedelta, delay: str = "1 hour") -> DataFrame:
    """(place_id, status_code, change, at): active, inactive or expired, whenever a key's state changes.

    history: place_id, status_code, event_id, event_at (timestamp), action. Rows of a batch are taken in order of event_at and
    event_id; one that is older than what its key has seen is late and changes nothing, one older than the watermark is gone
    before. An activation expires when the event time passes event_at + ttl, whether by a later row of its key or by the
    watermark; being activated again earlier moves that on. A key is kept while it is active, else until the watermark is past
    its last row, so state follows the keys in use.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            if last[2] == "activate":
                out.append(("expired", pd.Timestamp(last[0]) + ttl))
            state.remove()
        else:
            rows = sorted((r for b in batches for r in zip(b["event_at"], b["event_id"], b["action"], strict=True)), key=lambda r: (r[0], r[1]))
            for at, number, action in rows:
                if last is not None and (at, number) <= (pd.Timestamp(last[0]), last[1]):
                    continue
                was = last is not None and last[2] == "activate"
                if was and pd.Timestamp(last[0]) + ttl <= at:
                    out.append(("expired", pd.Timestamp(last[0]) + ttl))
                    was = False
                if was != (action == "activate"):
                    out.append(("inactive" if was else "active", at))
                last = (at, number, action)
            state.update((pd.Timestamp(last[0]).to_pydatetime(), int(last[1]), last[2]))
            due = _ms(pd.Timestamp(last[0]) + (ttl if last[2] == "activate" else timedelta(milliseconds=1)))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"place_id": key[0], "status_code": key[1], "change": [c for c, _ in out], "at": [t for _, t in out]})

    named = history.select("place_id", "status_code", "event_id", "event_at", "action").where("place_id is not null and event_at is not null")
    return named.withWatermark("event_at", delay).groupBy("place_id", "status_code").applyInPandasWithState(run, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def with_locations(events: DataFrame, locations: DataFrame, within: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """events with the locations that come within an interval after them, those without any once, with nulls.

    events: event_id, event_at and more; locations: event_id, located_at and more. On streams both sides have a watermark of
    `delay`, which with the interval bounds what is kept; a row without a partner is given out once none can come any more.
    The same on batches.
    """
    left, right = events.withWatermark("event_at", delay).alias("e"), locations.withWatermark("located_at", delay).alias("l")
    due = F.col("l.located_at").between(F.col("e.event_at"), F.col("e.event_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("e.event_id") == F.col("l.event_id")) & due, "left_outer").drop(F.col("l.event_id"))
