"""Sessions that are not handed in by their deadline are closed with the answers they have."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "session_id string, answers int, closed_by string"


class Deadline(StatefulProcessor):
    """Counts a session's answers until it is handed in or its time has run out (event time)."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, answers int, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at")
        began, answers, closed = self.state.get() if self.state.exists() else (None, 0, False)
        if began is None:
            began = int(frame["at"].iloc[0].timestamp() * 1000)
            self.handle.registerTimer(began + self.limit_ms)
        if not closed:
            for at, kind in zip(frame["at"], frame["kind"]):
                if closed or at.timestamp() * 1000 > began + self.limit_ms:
                    break
                if kind == "submit":
                    closed = True
                else:
                    answers += 1
            if closed:
                yield pd.DataFrame({"session_id": [key[0]], "answers": [answers], "closed_by": ["participant"]})
        self.state.update((began, answers, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, answers, closed = self.state.get()
        if not closed:
            self.state.update((began, answers, True))
            yield pd.DataFrame({"session_id": [key[0]], "answers": [answers], "closed_by": ["deadline"]})

    def close(self) -> None:
        pass


def close_sessions(events: DataFrame, limit_ms: int, late: str) -> DataFrame:
    """events: session_id, at (timestamp), kind (answer or submit). Needs the RocksDB state store."""
    keyed = events.withWatermark("at", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(Deadline(limit_ms), SCHEMA, "append", "eventTime")
