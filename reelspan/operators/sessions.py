"""Gap sessionisation with a size cap, and sessions cut further to a target number."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def sessionize(rows: DataFrame, by: list[str], order: list[str], at: Column, gap: float, cap: int) -> DataFrame:
    """rows with session (from 1 within its key) and rank within it: a new one after more than gap seconds, or after cap rows.

    A cap only starts counting anew, so sessions by gap alone are cut by row number.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    opens = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
    by_gap = rows.withColumn("_opens", opens).withColumn("_by_gap", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*by, "_by_gap").orderBy(*order)
    chunked = by_gap.withColumn("_rn", F.row_number().over(inner) - 1)
    first = chunked.withColumn("_first", (F.col("_rn") % cap == 0).cast("int"))
    return (
        first.withColumn("session", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank_in_session", (F.col("_rn") % cap + 1).cast("int"))
        .drop("_opens", "_by_gap", "_rn", "_first")
    )


def cuts(at: np.ndarray, starts: list[int], target: int, cap: int, least_gap: float = 5.0) -> list[int]:
    """Where runs begin once ordered times, cut at some starts, are cut further: into `target` runs, then into runs of at most `cap`.

    The longest run (of equal ones the last) is cut at its widest gap (the last of equal ones) if that is over least_gap and within the middle half of the run, else at its
    middle. A run longer than the cap is then cut into as few nearly equal ones as there can be.
    """
    ends = [*starts[1:], len(at)]
    heap = [(lo - hi, -lo) for lo, hi in zip(starts, ends, strict=True)]
    heapify(heap)
    while 0 < len(heap) < target and heap[0][0] < -1:
        size, lo = (-x for x in heappop(heap))
        gaps = np.diff(at[lo : lo + size])
        widest = size - 1 - int(np.argmax(gaps[::-1]))
        inside = gaps[widest - 1] > least_gap and max(1, size // 4) <= widest <= min(size - 1, size * 3 // 4)
        cut = widest if inside and size > 2 else max(1, size // 2)
        heappush(heap, (-cut, -lo))
        heappush(heap, (cut - size, -lo - cut))
    out = []
    for lo, size in sorted((-lo, -size) for size, lo in heap):
        parts = -(-size // cap)
        out += [lo + round(i * size / parts) for i in range(parts)]
    return out


def split_to_target(rows: DataFrame, by: list[str], key: str, at: str, session: str, target: int | str, cap: int) -> DataFrame:
    """by, key and moment (from 1) of rows with sessions by cuts(): by, key (a long), at (seconds), session (rising with at), and target if it is a column.

    Rows stream through a task in order; of a group it holds sixteen bytes a row, as any of its runs may have to be cut anywhere. Ties of time go by key; rows of a null time come last and have the last one's.
    """
    goal = F.col(target) if isinstance(target, str) else F.lit(target)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = StructType.fromDDL(", ".join(f"`{c}` {kinds[c]}" for c in by) + f", `{key}` long, moment long")
    arrow = to_arrow_schema(fields)

    def moments(group: tuple, keys: list, times: list, sessions: list, goal: int) -> pa.RecordBatch:
        at = np.asarray(times, float)
        named = np.concatenate(sessions)
        starts = [0, *(np.flatnonzero(named[1:] != named[:-1]) + 1).tolist()]
        begins = np.zeros(len(at), np.int64)
        begins[cuts(at, starts, goal, cap)] = 1
        return pa.RecordBatch.from_arrays([*(pa.array([v] * len(at), arrow.field(b).type) for v, b in zip(group, by, strict=True)), pa.array(keys, pa.int64()), pa.array(np.cumsum(begins))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            groups = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True))
            numbers, times, names, goals = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_at", "_session", "_goal"))
            edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)] if groups else []
            for a, b in zip(edges, edges[1:], strict=False):
                if held is None or groups[a] != now:
                    if held:
                        yield moments(now, np.concatenate(held[0]), np.concatenate(held[1]), held[2], held[3])
                    now, held = groups[a], ([], [], [], int(goals[a]))
                for part, column in zip(held, (numbers, times, names), strict=False):
                    part.append(column[a:b])
        if held:
            yield moments(now, np.concatenate(held[0]), np.concatenate(held[1]), held[2], held[3])

    last = rows.groupBy(*by).agg(F.max(at).alias("_last"))
    plain = rows.join(last, by).select(*by, F.col(key).cast("long").alias("_key"), F.coalesce(F.col(at).cast("double"), F.col("_last").cast("double"), F.lit(0.0)).alias("_at"), F.col(session).cast("long").alias("_session"), goal.cast("long").alias("_goal"))
    return plain.repartition(*by).sortWithinPartitions(*by, "_at", "_key").mapInArrow(run, fields)
