"""Stage states from a stream of the event log, with timers for runs that died.

The batch form is :func:`weftline.operators.state.settled_states`; after the
last event, once event time has passed the timers, both say the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "stage string, unit_id string, status string, ts timestamp"


def live_states(events: DataFrame, patience_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of states (stage, unit_id, status, ts): one row whenever the state of a unit changes.

    ``events``: stage, unit_id, status, ts. The newest event counts, also when
    events come late; at equal times the greatest status. A ``running`` unit
    sets a timer; without another event for ``patience_seconds`` of event time
    it is ``pending``. State is keyed by (stage, unit_id), one row each, and a
    unit that is not running has no timer.
    """
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = state.get
            state.update(("pending", at))
            yield pd.DataFrame({"stage": [key[0]], "unit_id": [key[1]], "status": ["pending"], "ts": [pd.Timestamp(at, unit="us")]})
            return
        before = state.get if state.exists else None
        newest = (before[1], before[0]) if before else None
        for batch in batches:
            for at, status in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch["status"], strict=True):
                # a unit found dead comes to life by a later event only
                if newest is None or at > newest[0] or (at == newest[0] and newest[1] != "pending" and status > newest[1]):
                    newest = (int(at), status)
        now = (newest[1], newest[0])
        state.update(now)
        if now[0] == "running":
            # a timer may not lie before the watermark: such a unit is dead at the next batch
            due = now[1] // 1000 + patience_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if now != before:
            yield pd.DataFrame({"stage": [key[0]], "unit_id": [key[1]], "status": [now[0]], "ts": [pd.Timestamp(now[1], unit="us")]})

    return events.withWatermark("ts", delay).groupBy("stage", "unit_id").applyInPandasWithState(
        follow, STATES, "status string, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
