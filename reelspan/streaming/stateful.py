"""Folds over streams with a state of their own for each key: debounce, and repetition of a kind.

A row's turn is the order of its time within a micro-batch; rows that come in a later batch than their successors
are late: debounce drops them, as what was kept can't be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHAPE = "event_id long, user_id long, at double"


def debounced(events: DataFrame, least: float) -> DataFrame:
    """Rows of each user_id (event_id, user_id, at in seconds) that come at least so long after the last one kept."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        kept = []
        for row in rows.itertuples(index=False):
            if row.at - last >= least:
                kept.append((row.event_id, row.user_id, row.at))
                last = row.at
        if kept:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["event_id", "user_id", "at"])

    return events.select("event_id", "user_id", "at").groupBy("user_id").applyInPandasWithState(step, SHAPE, "last double", "append", GroupStateTimeout.NoTimeout)


def without_repetition(events: DataFrame, window: int, keep_score: float) -> DataFrame:
    """Rows of each user_id (event_id, user_id, at, kind, score) whose kind is not among the last kept, or that score high."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        kept = []
        for row in rows.itertuples(index=False):
            if row.kind not in recent or row.score >= keep_score:
                kept.append((row.event_id, row.user_id, row.at))
                recent = [*recent, row.kind][-window:]
        state.update((recent,))
        yield pd.DataFrame(kept, columns=["event_id", "user_id", "at"])

    columns = events.select("event_id", "user_id", "at", "kind", "score")
    return columns.groupBy("user_id").applyInPandasWithState(step, SHAPE, "recent array<string>", "append", GroupStateTimeout.NoTimeout)
