"""Conversation structure repair: the cheapest edits of a conversation's turns after which its roles fit a grammar.

The grammar is (system? (user assistant)+)?, by the initials of roles. A turn is kept, given another role or deleted, and empty turns may be
inserted; blank and repeated turns must go, and a truncated one that stays costs extra. In the manner of Wu and Manber's approximate matching there is a
row of bitsets for each turn: the set of grammar states (start, system, user, assistant: four bits) from which the turns still to come can be repaired at
each cost, 0, 1, 2 and so on. They are filled from the last turn to the first with one bit operation for each kind of edit. The first layer at the first
turn that has the start state is the cost; then the bits are traced forwards, each time by the first edit in ASCII order from which the rest can still be paid, which gives the least
audit. What is left to do costs at most SPREAD more from one state than from another (two insertions, a deletion and a wrong turn make up for any state), so only so many layers
above a turn's first non-empty one are kept and the work grows with the turns, not with their square.

Turns are dealt by conversation and sorted by the shuffle; a task reads one conversation at a time, as its repair is one result.

Defined results: a null role or text is one space; null turns come first; turns of one number are ordered by role and text; repeated rows are repeated turns;
rows of a null conv_id are one conversation; further columns are ignored, whatever their names; an empty table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = "\t\n\v\f\r "
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ALL = 15
BEFORE = {USER: START | SYSTEM | ASSISTANT, ASSISTANT: USER, SYSTEM: START}  # the states in which a role may follow
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what may be inserted, or a turn be turned into
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = START | ASSISTANT
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Costs:
    """Keeping a turn costs nothing."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    @property
    def spread(self) -> int:
        return 3 * self.insert + self.delete


def faults_of(turns: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each turn (role, text)."""
    seen, out = set(), []
    for turn in turns:
        said = turn[1].rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if turn in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add(turn)
    return out


class Layers:
    """The states from which a suffix of turns can be repaired at a cost of at most c. initials and faults: one for each turn."""

    def __init__(self, initials: list[str], faults: list[str | None], costs: Costs) -> None:
        self.initials, self.faults, self.costs = initials, faults, costs
        self.rows: list[tuple[int, list[int]]] = []  # from the last turn to the first: the first cost with a state, and the sets from there
        self._fill(0, lambda c: ACCEPTING)
        for k in range(len(initials) - 1, -1, -1):
            self._fill(self.rows[-1][0], self._edits(initials[k], faults[k]))
        self.rows.reverse()

    def _edits(self, initial: str, fault: str | None):
        """The states at some cost before a turn, by keeping, changing or deleting it, from the row behind it."""
        base, sets = self.rows[-1]
        top = len(sets) - 1
        costs, kept = self.costs, AFTER.get(initial)
        extra = costs.truncated if fault == "truncated" else 0
        stays = fault not in ("blank", "duplicate")

        def behind(c: int) -> int:
            return 0 if c < base else sets[c - base] if c - base <= top else ALL

        def found(c: int) -> int:
            out = behind(c - costs.delete)
            if stays:
                if kept and behind(c - extra) & kept:
                    out |= BEFORE[kept]
                changed = behind(c - extra - costs.rerole)
                for role in (USER, ASSISTANT):
                    if changed & role:
                        out |= BEFORE[role]
            return out

        return found

    def _fill(self, least: int, found) -> None:
        sets: list[int] = []
        c = least
        while len(sets) <= self.costs.spread:
            states = found(c)
            if len(sets) >= self.costs.insert:
                inserted = sets[-self.costs.insert]
                for role in (USER, ASSISTANT):
                    if inserted & role:
                        states |= BEFORE[role]
            if states or sets:
                sets.append(states | (sets[-1] if sets else 0))
            c += 1
        self.rows.append((c - len(sets), sets))

    def payable(self, k: int, state: int, cost: int) -> bool:
        base, sets = self.rows[k]
        return cost >= base and (cost - base >= len(sets) or bool(sets[cost - base] & state))

    def cost(self) -> int:
        base, sets = self.rows[0]
        return base + next(i for i, states in enumerate(sets) if states & START)

    def audit(self) -> tuple[str, list[int]]:
        """The least of the cheapest edits' strings, and the state after each edit."""
        costs, n = self.costs, len(self.initials)
        k, state, left, edits, states = 0, START, self.cost(), [], []
        while k < n or left:
            edit = None
            if k < n and self.payable(k + 1, state, left - costs.delete):
                edit, k, left = "D", k + 1, left - costs.delete
            elif self.payable(k, NEXT[state], left - costs.insert):
                edit, state, left = "I", NEXT[state], left - costs.insert
            else:
                left -= costs.truncated if self.faults[k] == "truncated" else 0
                kept = AFTER.get(self.initials[k])
                if kept and BEFORE[kept] & state and self.payable(k + 1, kept, left):
                    edit, state = "K", kept
                else:
                    edit, state, left = "R", NEXT[state], left - costs.rerole
                k += 1
            edits.append(edit)
            states.append(state)
        return "".join(edits), states


def repaired(turns: list[tuple[str, str]], costs: Costs) -> tuple[dict[str, int], int, str, list[tuple[str, str]]]:
    """Counts of faults, cost, audit and the repaired turns of one conversation's turns (role, text)."""
    faults = faults_of(turns)
    initials = [role[:1] for role, _ in turns]
    layers = Layers(initials, faults, costs)
    audit, states = layers.audit()
    out, rest = [], iter(turns)
    for edit, state in zip(audit, states, strict=True):
        if edit == "I":
            out.append((NAMES[state], ""))
            continue
        role, text = next(rest)
        if edit != "D":
            out.append((role if edit == "K" else NAMES[state], text))
    counts = {f: faults.count(f) for f in FAULTS}
    counts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return counts, layers.cost(), audit, out


def repair(turns: DataFrame, costs: Costs | None = None) -> DataFrame:
    """conv_id, gaps (missing turn numbers), blank, duplicate, truncated, illegal, cost, audit and repaired (roles and texts) of each conversation.

    turns: conv_id, turn, role, text, and present, which is false for rows that only say that a conversation exists.
    """
    costs = costs or Costs()
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for group in shared.key_groups(batches, ["conv", "known"]):
            found = [r for r in zip(*(group.column(c).to_pylist() for c in ("turn", "role", "text", "present")), strict=True) if r[3]]
            numbers = {r[0] for r in found} - {None}
            counts, cost, audit, out = repaired([(r[1], r[2]) for r in found], costs)
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            conv = group.column("conv")[0].as_py() if group.column("known")[0].as_py() else None
            rows.append({"conv_id": conv, "gaps": gaps, **counts, "cost": cost, "audit": audit, "repaired": [{"role": a, "text": b} for a, b in out]})
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    text = pa.struct([("role", pa.string()), ("text", pa.string())])
    fields = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(text))])
    keyed = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "present")
    dealt = keyed.repartition("conv", "known").sortWithinPartitions("conv", "known", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations after a fixed damage by the digest of conv_id and turn: dropped (present is false), emptied, without sentence ends, repeated, or said by the user."""
    spelled = F.concat(*(F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    h = F.col("h")
    hurt = turns.withColumn("h", F.crc32(spelled.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (h != 0).alias("present"), "h"
    )
    return hurt.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1)))).drop("h", "copy")


def spelled_out(repaired_turns: str = "repaired") -> Column:
    """The repaired turns as lines role:text."""
    return F.array_join(F.transform(repaired_turns, lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
