"""State of one's own with timers and with a time to live, one small processor each.

State lies in RocksDB, so it may be larger than memory; the session needs
:data:`SETTINGS`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .event_time import LATE

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_SESSION = "user_id long, start timestamp, end timestamp, n long, types long"


class Sessions(StatefulProcessor):
    """Events of a user that no gap parts, given out when a timer says that nothing can join them any more.

    A list holds the times of events of open sessions, a map how often each
    type came at each of them. A session ends a gap after its last event; when
    the watermark passes that, the timer fires, and with the session its state
    goes. A user without open sessions has no state.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")
        self.types = handle.getMapState("types", "us long, event_type string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            self.times.appendList([(int(x),) for x in us])
            for (at, kind), n in part.groupby([us, "event_type"]).size().items():
                k = (int(at), kind)
                self.types.updateValue(k, ((self.types.getValue(k)[0] if self.types.containsKey(k) else 0) + int(n),))
        self._set_timer(sorted(x[0] for x in self.times.get()))
        yield from ()

    def _set_timer(self, times: list[int]) -> None:
        """One timer: for the end of the earliest session there is."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for a, b in zip(times, [*times[1:], None], strict=True):
            if b is None or b >= a + self.gap:
                self.handle.registerTimer((a + self.gap) // 1000 + 1)
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, times, done, session = 1000 * timerValues.getCurrentWatermarkInMs(), sorted(x[0] for x in self.times.get()), [], []
        kinds: dict[int, dict] = {}
        for (at, kind), _ in self.types.iterator():
            kinds.setdefault(at, set()).add(kind)
        left: list[int] = []
        for a, b in zip(times, [*times[1:], None], strict=True):
            session.append(a)
            if b is None or b >= a + self.gap:
                if a + self.gap <= now:
                    done.append((key[0], session[0], a + self.gap, len(session), len(set().union(*[kinds[t] for t in session]))))
                    for t in set(session):
                        for kind in kinds[t]:
                            self.types.removeKey((t, kind))
                else:
                    left += session
                session = []
        if left:
            self.times.put([(t,) for t in left])
            self._set_timer(left)
        else:
            self.times.clear()
        out = pd.DataFrame(done, columns=["user_id", "start", "end", "n", "types"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="us")
        yield out

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """``(user_id, start, end, n, types)`` of each session of a stream, once it is over.

    ``types`` is the number of kinds of events. Late events, behind the
    watermark, are dropped; a user of null is a user; equal times are one
    session. Columns: user_id, ts (an instant), event_type.
    """
    own = events.withWatermark("ts", LATE).select("user_id", "ts", "event_type")
    return own.groupBy("user_id").transformWithStateInPandas(Sessions(gap_minutes * 60_000_000), _SESSION, "Append", "EventTime")


class Recent(StatefulProcessor):
    """The first event of each type of a user, again when the type has not come for a time."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "event_type string", "event_id long", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            for event_id, kind in zip(part["event_id"], part["event_type"], strict=True):
                if not self.known.containsKey((kind,)):
                    fresh.append((key[0], kind, int(event_id)))
                self.known.updateValue((kind,), (int(event_id),))
        yield pd.DataFrame(fresh, columns=["user_id", "event_type", "event_id"])

    def close(self) -> None:
        pass


def first_of_type(events: DataFrame, keep_ms: int) -> DataFrame:
    """``(user_id, event_type, event_id)`` of events whose type the user has not had for ``keep_ms`` of processing time.

    Within a batch rows come in any order. What is not renewed leaves the state
    by itself. Processing time goes on without data, so a query with an
    ``availableNow`` trigger would not end; give it a time or stop it.
    """
    own = events.select("user_id", "event_id", "event_type")
    return own.groupBy("user_id").transformWithStateInPandas(Recent(keep_ms), "user_id long, event_type string, event_id long", "Append", "ProcessingTime")
