"""Greedy selection under rules, as a stream of offers.

A selection is a list of turns. Spark makes the offers of all turns: which rows a turn offers, and in which order. They are dealt by group, sorted by turn and order
in the shuffle, and read one by one; a row is taken if none of the rules that its turn obeys speaks against it. A task holds what has been taken, never
a group's rows, so its memory follows the size of selections and not that of groups. Rules are data: caps of values and of tags, budgets of seconds by bucket,
windows of one source that must not overlap, likeness by several hashes and time, and a share of rows that may come from elsewhere.

A null value or tag is under no cap; a null hash is like no other; null flags are false, null seconds none. Ties of an order go to the least key.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Test, Note = Callable[[dict], bool], Callable[[dict], None]


@dataclass(frozen=True)
class Rows:
    """At most so many rows in all."""

    most: int
    columns = ()

    def start(self) -> tuple[Test, Note]:
        taken = Counter()
        return lambda r: taken["n"] < self.most, lambda r: taken.update(n=1)


@dataclass(frozen=True)
class Cap:
    """At most so many rows of one value of some columns; by_value has other numbers for values of the last of them."""

    columns: tuple[str, ...]
    most: int
    by_value: Mapping[str, int] = field(default_factory=dict)

    def start(self) -> tuple[Test, Note]:
        taken: Counter = Counter()

        def allows(r: dict) -> bool:
            value = tuple(r[c] for c in self.columns)
            return value[-1] is None or taken[value] < self.by_value.get(value[-1], self.most)

        return allows, lambda r: taken.update([tuple(r[c] for c in self.columns)])


@dataclass(frozen=True)
class TagCap:
    """At most so many rows of each tag of an array column; a row counts for all of its tags."""

    tags: str
    most: int
    by_tag: Mapping[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.tags,)

    def start(self) -> tuple[Test, Note]:
        taken: Counter = Counter()
        return lambda r: all(taken[t] < self.by_tag.get(t, self.most) for t in set(r[self.tags] or ())), lambda r: taken.update(set(r[self.tags] or ()))


@dataclass(frozen=True)
class Seconds:
    """At most so many seconds in all, with some slack, once least_rows rows are taken."""

    of: str
    most: float
    slack: float = 0.0
    least_rows: int = 0

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.of,)

    def start(self) -> tuple[Test, Note]:
        now = {"s": 0.0, "n": 0}

        def took(r: dict) -> None:
            now["s"] += r[self.of] or 0.0
            now["n"] += 1

        return lambda r: now["n"] < self.least_rows or now["s"] + (r[self.of] or 0.0) <= self.most + self.slack, took


@dataclass(frozen=True)
class BucketSeconds:
    """Seconds of each bucket, with some slack; buckets without a budget have no limit."""

    bucket: str
    of: str
    budgets: Mapping[str, float]
    slack: float = 0.0

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.bucket, self.of)

    def start(self) -> tuple[Test, Note]:
        now: dict = defaultdict(float)

        def took(r: dict) -> None:
            now[r[self.bucket]] += r[self.of] or 0.0

        return lambda r: r[self.bucket] not in self.budgets or now[r[self.bucket]] + (r[self.of] or 0.0) <= self.budgets[r[self.bucket]] + self.slack, took


@dataclass(frozen=True)
class Apart:
    """Windows of one source end before others begin, with a gap."""

    source: str
    begin: str
    end: str
    gap: float = 0.0

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.source, self.begin, self.end)

    def start(self) -> tuple[Test, Note]:
        spans: dict = defaultdict(lambda: ([], []))  # begins and ends of what was taken, both sorted, as none overlap

        def allows(r: dict) -> bool:
            begins, ends = spans[r[self.source]]
            at = bisect_right(begins, r[self.begin])
            return not (at and r[self.begin] < ends[at - 1] + self.gap or at < len(begins) and begins[at] < r[self.end] + self.gap)

        def took(r: dict) -> None:
            begins, ends = spans[r[self.source]]
            at = bisect_right(begins, r[self.begin])
            begins.insert(at, r[self.begin])
            ends.insert(at, max(r[self.end], ends[at - 1]) if at else r[self.end])

        return allows, took


@dataclass(frozen=True)
class Spaced:
    """Rows stand so far apart at least in one column."""

    at: str
    least: float

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.at,)

    def start(self) -> tuple[Test, Note]:
        taken: list[float] = []  # sorted

        def allows(r: dict) -> bool:
            i = bisect_right(taken, r[self.at])
            return not (i and r[self.at] - taken[i - 1] < self.least or i < len(taken) and taken[i] - r[self.at] < self.least)

        return allows, lambda r: insort(taken, r[self.at])


@dataclass(frozen=True)
class Share:
    """At most so many rows with a flag, for example those of the album before; the number may be a column that is constant in a group."""

    flag: str
    most: int | str

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.flag, self.most) if isinstance(self.most, str) else (self.flag,)

    def start(self) -> tuple[Test, Note]:
        taken = Counter()
        most = (lambda r: r[self.most]) if isinstance(self.most, str) else lambda r: self.most
        return lambda r: not r[self.flag] or taken["n"] < most(r), lambda r: taken.update(n=bool(r[self.flag]))


@dataclass(frozen=True)
class Alike:
    """Two rows are alike if each of these hashes (column, bits) differs in so many bits at most, and, where seconds is set, their times by so much at most."""

    hashes: tuple[tuple[str, int], ...]
    seconds: float | None = None


def _bits(value) -> int:
    """A hash as a number: a long, bytes, or hex digits."""
    return value & (1 << 64) - 1 if isinstance(value, int) else int(value, 16) if isinstance(value, str) else int.from_bytes(value, "big")


@dataclass(frozen=True)
class Unlike:
    """No row is like one that was taken, in any of several ways, where they agree in the columns of `same`.

    Taken rows are found by blocks of their first hash (of which two within the radius share one), or by their time where a way asks for it.
    """

    ways: tuple[Alike, ...]
    same: tuple[str, ...] = ()
    at: str | None = None
    width: int = 64

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.same, *([self.at] if self.at else []), *(c for w in self.ways for c, _ in w.hashes)]))

    def _keys(self, way: Alike, r: dict, around: bool) -> list[tuple]:
        """Where a row stands in the index of a way; around: where rows like it may stand."""
        own = tuple(r[c] for c in self.same)
        if way.seconds is not None:
            if r[self.at] is None:
                return []
            slot = int(r[self.at] // way.seconds) if way.seconds else r[self.at]
            return [(own, slot + d) for d in ((-1, 0, 1) if around and way.seconds else (0,))]
        column, radius = way.hashes[0]
        blocks = min(radius + 1, self.width)
        edges = [self.width * i // blocks for i in range(blocks + 1)]
        h = _bits(r[column])
        return [(own, a, h >> a & (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def start(self) -> tuple[Test, Note]:
        index: list[dict] = [defaultdict(list) for _ in self.ways]

        def whole(way: Alike, r: dict) -> bool:
            return all(r[c] is not None and r[c] != "" for c, _ in way.hashes)

        def like(way: Alike, r: dict, other: dict) -> bool:
            near = way.seconds is None or abs(r[self.at] - other[self.at]) <= way.seconds
            return near and all((_bits(r[c]) ^ _bits(other[c])).bit_count() <= n for c, n in way.hashes)

        def allows(r: dict) -> bool:
            return not any(whole(w, r) and any(like(w, r, o) for k in self._keys(w, r, True) for o in found.get(k, ())) for w, found in zip(self.ways, index, strict=True))

        def took(r: dict) -> None:
            slim = {c: r[c] for c in self.columns}
            for way, found in zip(self.ways, index, strict=True):
                if whole(way, r):
                    for k in self._keys(way, r, False):
                        found[k].append(slim)

        return allows, took


Rule = Rows | Cap | TagCap | Seconds | BucketSeconds | Apart | Spaced | Share | Unlike


@dataclass(frozen=True)
class Turn:
    """What is offered, in which order, and which rules hold.

    where, order, and top with per and best (just the first so many by best of each value of some columns) are worked out by Spark; turns of one stage are offered
    mixed by their orders. take: most rows of this turn; once: one row of each value of a column in this turn. until: it ends once one of these totals has been
    reached; below: it takes place only if one of these totals is below its number then; shy: (flag, total, number): rows with the flag are passed over once
    the total is above the number. even: (position, count, most): just the rows at as many evenly spaced positions as are left of most when the turn begins.
    price: the column that rules see as `price`. Totals are rows, seconds, seconds:<bucket> and tag:<tag>.
    """

    order: Sequence[Column]
    obeys: tuple[str, ...]
    where: Column | None = None
    stage: int | None = None  # its own number otherwise
    top: int | None = None
    per: tuple[str, ...] = ()
    best: Sequence[Column] | None = None
    take: int | None = None
    once: str | None = None
    until: Mapping[str, float] = field(default_factory=dict)
    below: Mapping[str, float] = field(default_factory=dict)
    shy: tuple[str, str, float] | None = None
    even: tuple[str, str, int] | None = None
    price: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for c in (self.once, self.shy and self.shy[0], *(self.even or ())[:2], self.price) if c)


def rank(order: Sequence[Column]) -> Column:
    """Numbers as one array that sorts as they do, missing ones last."""
    return F.array(*[x for c in order for x in (c.isNull().cast("double"), F.coalesce(c.cast("double"), F.lit(0.0)))])


def offered(rows: DataFrame, by: Sequence[str], key: str, turns: Sequence[Turn], columns: Sequence[str]) -> DataFrame:
    """by, key, columns, turn, stage and rank: each row once for each turn that offers it. Turns without top are worked out in one go over the rows."""
    names = list(dict.fromkeys([*by, key, *columns]))
    given = [(F.lit(True) if t.where is None else F.coalesce(t.where, F.lit(False)), rank(t.order), rank(t.best or t.order)) for t in turns]
    kept = rows.select(*names, *(c.alias(f"_{kind}{i}") for i, cs in enumerate(given) for kind, c in zip("wrb", cs, strict=True)))
    stages = [i if t.stage is None else t.stage for i, t in enumerate(turns)]

    def offer(i: int) -> Column:
        return F.struct(F.lit(i).alias("turn"), F.lit(stages[i]).alias("stage"), F.col(f"_r{i}").alias("rank"))

    def some_of(found: DataFrame, i: int) -> DataFrame:
        return found.select(*names, offer(i).alias("o")).select(*names, "o.*")

    out = []
    if plain := [i for i, t in enumerate(turns) if t.top is None]:
        out.append(kept.select(*names, F.explode(F.array_compact(F.array(*[F.when(F.col(f"_w{i}"), offer(i)) for i in plain]))).alias("o")).select(*names, "o.*"))
    if single := [i for i, t in enumerate(turns) if t.top == 1 and not t.per]:  # the best row of a group: an aggregate, however many turns want one
        best = kept.groupBy(*by).agg(*[F.min(F.when(F.col(f"_w{i}"), F.struct(F.col(f"_b{i}"), F.col(key).alias("key"), offer(i).alias("o")))).alias(f"b{i}") for i in single])
        best = best.select(*by, F.explode(F.array_compact(F.array(*[F.when(F.col(f"b{i}").isNotNull(), F.struct(F.col(f"b{i}.key"), F.col(f"b{i}.o"))) for i in single]))).alias("b"))
        out.append(kept.select(*names).join(best.select(*by, F.col("b.key").alias(key), "b.o.*"), [*by, key]).select(*names, "turn", "stage", "rank"))
    for i, t in enumerate(turns):
        if t.top is not None and i not in single:
            w = Window.partitionBy(*by, *t.per).orderBy(f"_b{i}", key)
            out.append(some_of(kept.where(f"_w{i}").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= t.top), i))
    return reduce(DataFrame.union, out)


def evenly(count: int, wanted: int) -> set[int]:
    """So many positions, evenly spaced from the first to the last of count; one alone stands in the middle."""
    if count <= 0 or wanted <= 0:
        return set()
    return {count // 2} if wanted == 1 else {round(i * (count - 1) / (wanted - 1)) for i in range(wanted)}


class Selection:
    """What one group has taken so far."""

    def __init__(self, turns: Sequence[Turn], rules: Mapping[str, Rule], key: str, seconds: str | None, bucket: str | None, tags: str | None) -> None:
        self.turns, self.key, self.measures = turns, key, (seconds, bucket, tags)
        self.rules = {name: rule.start() for name, rule in rules.items()}
        self.totals: Counter = Counter()
        self.taken: set = set()
        self.begun: dict[int, tuple[bool, set[int], set]] = {}  # of each turn: whether it takes place, its even positions, its values of once
        self.count: Counter = Counter()

    def _begin(self, t: Turn, r: dict) -> tuple[bool, set[int], set]:
        takes_place = not t.below or any(self.totals[k] < n for k, n in t.below.items())
        return takes_place, evenly(r[t.even[1]], min(t.even[2], r[t.even[1]]) - self.totals["rows"]) if t.even else set(), set()

    def offer(self, turn: int, r: dict) -> bool:
        t = self.turns[turn]
        if turn not in self.begun:
            self.begun[turn] = self._begin(t, r)
        takes_place, positions, once = self.begun[turn]
        if not takes_place or r[self.key] in self.taken or t.take is not None and self.count[turn] >= t.take or any(self.totals[k] >= n for k, n in t.until.items()):
            return False
        if t.shy and r[t.shy[0]] and self.totals[t.shy[1]] > t.shy[2] or t.even and r[t.even[0]] not in positions or t.once and r[t.once] in once:
            return False
        if t.price:
            r["price"] = r[t.price]
        if not all(self.rules[name][0](r) for name in t.obeys):
            return False
        for _, took in self.rules.values():
            took(r)
        seconds, bucket, tags = self.measures
        self.taken.add(r[self.key])
        self.count[turn] += 1
        self.totals["rows"] += 1
        if t.once:
            once.add(r[t.once])
        if seconds:
            self.totals["seconds"] += r[seconds] or 0.0
            if bucket:
                self.totals[f"seconds:{r[bucket]}"] += r[seconds] or 0.0
        if tags:
            self.totals.update(f"tag:{t}" for t in set(r[tags] or ()))
        return True


def chosen(rows: DataFrame, by: Sequence[str], key: str, turns: Sequence[Turn], rules: Mapping[str, Rule], seconds: str | None = None, bucket: str | None = None, tags: str | None = None) -> DataFrame:
    """by, key, pick (the order that rows were taken in, from 1) and turn (from 0) of the rows that are taken in each group; keys are unique in a group."""
    measured = [c for c in (seconds, bucket, tags) if c]
    columns = [*dict.fromkeys([*measured, *(c for rule in rules.values() for c in rule.columns if c != "price"), *(c for t in turns for c in t.columns)])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = StructType.fromDDL(", ".join(f"`{c}` {kinds[c]}" for c in (*by, key)) + ", pick long, turn int")
    arrow = to_arrow_schema(fields)
    plain = [replace(t, order=(), where=None, best=None) for t in turns]  # columns stay with the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                group = tuple(r[b] for b in by)
                if held is None or group != now:
                    now, held = group, Selection(plain, rules, key, seconds, bucket, tags)
                if held.offer(r["turn"], r):
                    out.append({c: r[c] for c in (*by, key)} | {"pick": held.totals["rows"], "turn": r["turn"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    dealt = offered(rows, by, key, turns, columns).repartition(*by).sortWithinPartitions(*by, "stage", "rank", "turn", key)
    return dealt.drop("rank", "stage").mapInArrow(run, fields)
