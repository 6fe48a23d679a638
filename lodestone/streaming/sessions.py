"""Sessions that are kept as state: events of a key gather until none came for a while, and open sessions can be asked for.

`open_sessions` keeps one record a key (its session so far) and a timer on event time. Each event moves the timer; when
the watermark passes it, the session is closed and given out, and the state goes. Events that come out of order within
the bound for late rows are put where they belong: a key's events wait in its state until the watermark has passed them,
so the result is that of the closed table, whatever the order in which files arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionProcessor(StatefulProcessor):
    """Rows (key, at, kind) -> (key, start, end, n, kinds): sessions that end after `gap_ms` without an event; kinds in the order of their events, as far as they changed."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: the session so far, if n is above 0, and events that the watermark may not have passed, with n 0; one list, as each access is a message to the JVM
        self.held = handle.getListState("held", "first long, last long, n long, kinds string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            at = pdf["at"].astype("datetime64[ms]").astype("int64")
            new += [(t, t, 0, kind) for t, kind in zip(at.tolist(), pdf["kind"].fillna("").tolist(), strict=True)]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(min(e[0] for e in new) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All waiting events that the watermark has passed join the session, or close it and begin the next one."""
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.held.get()]
        events = sorted((e[0], e[3]) for e in held if not e[2])
        due, later = [e for e in events if e[0] < now], [(t, t, 0, kind) for t, kind in events if t >= now]
        open_ = next((e for e in held if e[2]), None)
        closed = []
        for at, kind in due:
            if open_ and at - open_[1] >= self.gap_ms:
                closed.append(open_)
                open_ = None
            if open_ is None:
                open_ = (at, at, 1, kind)
            else:
                same = open_[3].rsplit(">", 1)[-1] == kind
                open_ = (open_[0], max(open_[1], at), open_[2] + 1, open_[3] if same else f"{open_[3]}>{kind}")
        if open_ and now > open_[1] + self.gap_ms:
            closed.append(open_)
            open_ = None
        if later:
            self.handle.registerTimer(later[0][0] + 1)
        if open_:
            later.append(open_)
            self.handle.registerTimer(open_[1] + self.gap_ms + 1)
        if later:
            self.held.put(later)
        elif held:
            self.held.clear()
        if closed:
            moment = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
            yield pd.DataFrame({"key": [key[0]] * len(closed), "start": [moment(c[0]) for c in closed], "end": [moment(c[1]) for c in closed], "n": [c[2] for c in closed], "kinds": [c[3] for c in closed]})

    def close(self) -> None:
        pass


def open_sessions(stream: DataFrame, key: str, at: str, kind: str, gap: int, late: str) -> DataFrame:
    """Closed sessions of a stream (key, start, end, n, kinds): gap in milliseconds, late a bound as for watermarks. The session needs spark.sql.streaming.stateStore.providerClass = STORE and UTC as its time zone."""
    rows = stream.selectExpr(f"`{key}` as key", f"cast(`{at}` as timestamp) as at", f"cast(`{kind}` as string) as kind").where("key is not null and at is not null").withWatermark("at", late)
    schema = f"key {dict(rows.dtypes)['key']}, start timestamp, end timestamp, n bigint, kinds string"
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(gap), outputStructType=schema, outputMode="Append", timeMode="EventTime")
