"""Order-dependent selection: one kernel of ordered passes under constraints, run once for each group.

A pass orders candidates and offers them one by one; a candidate is taken if no constraint speaks against
it. The kernel is a pure function of records and of data, so all selectors share it and tests need
no session. Groups are activities or sources; a group must fit into one task, and many groups are worked off in a call.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Pass:
    """Candidates by these columns (a leading minus: descending), of which at most so many are taken."""

    order: tuple[str, ...]
    where: str | None = None  # a boolean column
    take: int | None = None
    relaxed: bool = False  # caps of values do not hold in it
    until_seconds: float | None = None


@dataclass(frozen=True)
class Limits:
    """What holds for all passes; caps: by column, the most rows of one value."""

    most: int
    seconds: float | None = None  # of durations in total
    slack: float = 0.0
    caps: dict[str, int] = field(default_factory=dict)
    source: str | None = None  # rows of one source must not overlap in time
    apart: float = 0.0
    similar: str | None = None  # a column of 64-bit hashes; those within similar_bits suppress each other
    similar_bits: int = 0


def _in_order(records: list[dict], order: tuple[str, ...], key: str) -> list[int]:
    """Indices of records by the columns of an order, then by key; what is missing comes last."""
    found = sorted(range(len(records)), key=lambda i: records[i][key])
    for column in reversed(order):
        name = column.removeprefix("-")
        there = [i for i in found if records[i][name] is not None]
        there.sort(key=lambda i: records[i][name], reverse=column.startswith("-"))  # stable, also where reversed
        found = there + [i for i in found if records[i][name] is None]
    return found


def select(records: list[dict], passes: Iterable[Pass], limits: Limits, key: str) -> list[tuple[int, int]]:
    """(index, number of the pass) of the taken records, in the order they were taken in."""
    taken: list[tuple[int, int]] = []
    used: set = set()
    counts = {c: Counter() for c in limits.caps}
    spans: dict = {}  # by source: starts and ends of taken rows, both sorted, as none overlap
    hashes: list[int] = []
    total = 0.0

    def fits(r: dict, relaxed: bool) -> bool:
        if r[key] in used or len(taken) >= limits.most:
            return False
        if limits.seconds is not None and taken and total + r["duration"] > limits.seconds + limits.slack:
            return False
        if not relaxed and any(counts[c][r[c]] >= n for c, n in limits.caps.items()):
            return False
        if limits.source and r[limits.source] in spans:
            starts, ends = spans[r[limits.source]]
            at = bisect_right(starts, r["start_s"])
            if at and r["start_s"] < ends[at - 1] + limits.apart and starts[at - 1] < r["end_s"] + limits.apart or at < len(starts) and starts[at] < r["end_s"] + limits.apart:
                return False
        return not (limits.similar and any(((r[limits.similar] ^ h) & (2**64 - 1)).bit_count() <= limits.similar_bits for h in hashes))

    for number, p in enumerate(passes):
        n = 0
        for i in _in_order(records, p.order, key):
            if p.take is not None and n >= p.take or p.until_seconds is not None and total >= p.until_seconds:
                break
            r = records[i]
            if p.where and not r[p.where] or not fits(r, p.relaxed):
                continue
            taken.append((i, number))
            used.add(r[key])
            total += r.get("duration", 0.0)
            n += 1
            for c in counts:
                counts[c][r[c]] += 1
            if limits.source:
                starts, ends = spans.setdefault(r[limits.source], ([], []))
                at = bisect_right(starts, r["start_s"])
                starts.insert(at, r["start_s"])
                ends.insert(at, max(r["end_s"], ends[at - 1]) if at else r["end_s"])
            if limits.similar:
                hashes.append(r[limits.similar])
    return taken


def by_group(rows: DataFrame, by: list[str], fold: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """fold() of the records of every group, many groups a call: rows are dealt and sorted by their key, and one group is held at a time."""
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[b] for b in by)
                if held and key != now:
                    out += fold(held)
                    held = []
                    if len(out) >= 5_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
                now = key
                held.append(r)
        if held:
            out += fold(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, fields)


def select_by(rows: DataFrame, by: list[str], passes: Iterable[Pass], limits: Limits, key: str) -> DataFrame:
    """select() for every group of rows: by, key, pick (the order they were taken in) and why (the number of the pass)."""
    passes = tuple(passes)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    used = {key, *by, *limits.caps, *(c.removeprefix("-") for p in passes for c in p.order), *(p.where for p in passes if p.where)}
    used |= {c for c in ("duration",) if c in kinds} | ({limits.source, "start_s", "end_s"} if limits.source else set()) | ({limits.similar} if limits.similar else set())

    def fold(group: list[dict]) -> Iterator[dict]:
        for pick, (i, why) in enumerate(select(group, passes, limits, key), 1):
            yield {c: group[i][c] for c in (key, *by)} | {"pick": pick, "why": why}

    return by_group(rows.select(*sorted(used)), by, fold, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *by)) + ", pick long, why long")


def water_fill(targets: dict[str, float], available: dict[str, float], weights: dict[str, float], least: float = 0.01) -> dict[str, float]:
    """Targets capped at what is available; what is cut off goes to the others by weight until all is placed."""
    now = {k: min(v, available.get(k, 0.0)) for k, v in targets.items()}
    left = sum(targets.values()) - sum(now.values())
    while left > least:
        open_keys = [k for k in now if available.get(k, 0.0) - now[k] > least and weights.get(k, 0.0) > 0]
        total = sum(weights[k] for k in open_keys)
        if not open_keys or total <= 0:
            break
        for k in open_keys:
            share = min(left * weights[k] / total, available[k] - now[k])
            now[k] += share
        left = sum(targets.values()) - sum(now.values())
    return now


def thin(records: list[dict], similar: str, score: str, keep_score: float, floor_share: float, window: int) -> list[dict]:
    """A chronological fold: a row like one of the last kept goes, unless it scores high or too little would stay."""
    total = sum(r["duration"] for r in records)
    dropped, kept = 0.0, []
    for r in records:
        repeats = any(k[similar] == r[similar] for k in kept[-window:])
        if repeats and r[score] < keep_score and total - dropped - r["duration"] >= floor_share * total:
            dropped += r["duration"]
        else:
            kept.append(r)
    return kept


def spaced(records: list[dict], at: str, least: float) -> list[dict]:
    """Rows in order of time that come at least so long after the last one kept."""
    kept: list[dict] = []
    for r in records:
        if not kept or r[at] - kept[-1][at] >= least:
            kept.append(r)
    return kept


def without_regressions(records: list[dict], stage: str, strong: str, closing: str, most_setup: int = 4, least: int = 10, share: float = 0.48) -> list[dict]:
    """A chronological fold: once a row of stage 3 has come, rows of stage 0 and 1 go unless they may close, and before that all
    but the first few, while more rows are left than a floor; a strong row never goes as one too many."""
    floor = max(least, int(len(records) * share))
    kept: list[dict] = []
    started, setup = False, 0
    for r in records:
        early = r[stage] <= 1
        setup += early and not started
        spare = len(records) - len(kept) > floor
        if spare and early and (not r[closing] if started else setup > most_setup and not r[strong]):
            continue
        kept.append(r)
        started = started or r[stage] >= 3
    return kept or records
