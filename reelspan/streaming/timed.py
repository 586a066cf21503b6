"""Folds over streams in the order of event time, with timers and a state that ends.

Rows of a key wait until the watermark has passed them, then are folded in order of time and id, so what a stream gives out does not depend on how its rows were
dealt over micro-batches; only rows that come behind the watermark are late and left out. An event-time timer wakes a key when its next row is due or
its state has no more say; then the state goes. A key that falls idle therefore leaves nothing behind, and what waits is bounded by the watermark's delay.

Needs RocksDB as the state store (with_timers() sets it for the session).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "rows binary"  # what waits, packed; beside it the fold's state (null: none), as each call for state is a round trip of its own
_PACKED = np.dtype([("at_us", "<i8"), ("event_id", "<i8"), ("value", "<f8")])  # a null value is not a number
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@dataclass(frozen=True)
class Debounce:
    """Keeps a row that comes at least so long after the last one kept. Once that time has passed the last one has no say."""

    least_us: int
    state = "last_us long"
    out = "event_id long, at_us long"

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        event_id, at, _ = row
        return (state, []) if state and at - state[0] < self.least_us else ((at,), [(event_id, at)])

    def ends(self, state: tuple) -> int:
        return state[0] + self.least_us

    def finish(self, state: tuple) -> list[tuple]:
        return []


@dataclass(frozen=True)
class CappedSessions:
    """Sessions that end after a gap, or when they hold so many rows: first and last time, rows, best value. An open one is given out when its gap has passed."""

    gap_us: int
    cap: int
    state = "first_us long, last_us long, n long, best double"
    out = "first_us long, last_us long, n long, best double"

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        _, at, value = row
        if state and at - state[1] <= self.gap_us and state[2] < self.cap:
            best = value if state[3] is None else state[3] if value is None else max(state[3], value)
            return (state[0], at, state[2] + 1, best), []
        return (at, at, 1, value), [state] if state else []

    def ends(self, state: tuple) -> int:
        return state[1] + self.gap_us + 1

    def finish(self, state: tuple) -> list[tuple]:
        return [state]


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Debounce | CappedSessions) -> None:
        self.fold = fold
        self.names = [f.split()[0] for f in fold.out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"{ROWS}, {self.fold.state}")  # one value for each micro-batch that brought rows
        self.none = (None,) * len(self.fold.state.split(", "))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        packed = [np.rec.fromarrays([frame[c].to_numpy(kind) for c, (kind, _) in _PACKED.fields.items()], dtype=_PACKED) for frame in rows]
        new = np.concatenate(packed)
        self.held.appendValue((new.tobytes(), *self.none))
        self.handle.registerTimer(int(new["at_us"].min()) // 1000 + 1)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        values = [tuple(x) for x in self.held.get()]
        rows = np.concatenate([np.frombuffer(bytes(x[0]), _PACKED) for x in values]) if values else np.empty(0, _PACKED)
        rows = rows[np.lexsort((rows["event_id"], rows["at_us"]))]
        first_later = int(np.searchsorted(rows["at_us"], passed))
        due, later = rows[:first_later].tolist(), rows[first_later:]
        state, out = next((x[1:] for x in values if x[1] is not None), None), []
        for at, event_id, value in due:
            state, found = self.fold.step(state, (event_id, at, None if value != value else value))
            out += found
        if state is not None and self.fold.ends(state) <= passed:  # any row still to come is later
            out += self.fold.finish(state)
            state = None
        if len(later) or state is not None:
            self.held.put([(later.tobytes(), *(self.none if state is None else state))])
        elif values:
            self.held.clear()
        if wake := later["at_us"][:1].tolist() + ([self.fold.ends(state)] if state else []):
            self.handle.registerTimer(min(wake) // 1000 + 1)
        yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=self.names)
        frame.insert(0, "user_id", [key[0]] * len(out))
        return frame

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Debounce | CappedSessions, late: str = "1 day") -> DataFrame:
    """What a fold gives out for each user_id of a stream (event_id, user_id, ts, value); rows of a null user_id or time are left out."""
    rows = events.where("user_id is not null and ts is not null and event_id is not null").withWatermark("ts", late)
    shaped = rows.select("user_id", "event_id", F.unix_micros("ts").alias("at_us"), F.col("value").cast("double").alias("value"), "ts")
    return shaped.groupBy("user_id").transformWithStateInPandas(_Ordered(fold), f"user_id long, {fold.out}", "append", "EventTime")
