"""Repetition by reason: a chronological fold in which a row goes if it is like the last ones kept, by its tags or by its vector.

Rows are dealt by group and sorted by time in the shuffle; a task holds the last few rows kept and nothing else of a group, so groups may be of any size. What a group has in total is counted before.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# fixed values: tags that say nothing about what a picture shows, tags of backgrounds, tags that are always kept, and layouts by tags
GENERIC = ("face_visible", "people_visible", "phone_perspective", "action_camera_pov", "group_camera_perspective", "landscape", "scenic")
BACKGROUND = (
    "architecture", "beach", "celebration", "dancing", "food", "jungle_trail", "landscape", "lit_tunnel", "mud_water_run", "nightlife", "pool", "rapids", "restaurant", "ricefield", "river_scene",
    "savaya", "clubbing", "scenic", "speed_action", "temple", "tunnel_or_shade", "water", "water_crossing", "water_speed_run", "waterfall",
)
PRESERVED = ("water_speed_run", "mud_water_run", "lit_tunnel", "pool_action", "swimming", "pool_jump", "splash", "rapids", "waterfall", "architecture", "food", "dancing", "sunset")
LAYOUT = {
    "people": ("face_visible", "people_visible", "group_reaction"), "food": ("food", "restaurant"), "architecture": ("architecture", "temple"), "water": ("beach", "water", "waterfall", "river_scene", "rapids"),
    "scenic": ("ricefield", "jungle_trail", "scenic", "landscape"), "social": ("dancing", "nightlife", "celebration"), "action": ("water_speed_run", "mud_water_run", "lit_tunnel", "speed_action", "rough_motion"),
}
FACES = ("face_visible", "people_visible")


@dataclass(frozen=True)
class Diversity:
    """A row is like another by tags if this share of them agrees, by vector from this cosine on."""

    runs: int = 2  # so many of the last kept rows may be alike by tags
    share: float = 0.72
    cosine: float = 0.91
    recent: int = 6  # the last kept rows whose vectors count
    keep_score: float = 92.0
    least_share: float = 0.45  # of a group's seconds stays
    least_seconds: float = 8.0


def _set(tags: str, of: Sequence[str]) -> Column:
    return F.array_intersect(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, of)))


def signatures(tags: str = "tags") -> dict[str, Column]:
    """What the fold compares, of an array of tags: visual, background, layout, people and preserved."""
    every = F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))
    return {
        "visual": F.array_except(every, F.array(*map(F.lit, GENERIC))),
        "background": _set(tags, BACKGROUND),
        "layout": F.concat_ws(",", *[F.when(F.size(_set(tags, some)) > 0, name) for name, some in LAYOUT.items()]),
        "people": F.size(_set(tags, FACES)) > 0,
        "preserved": F.size(_set(tags, PRESERVED)) > 0,
    }


def overlap(a: frozenset, b: frozenset) -> float:
    """The share of tags that agree; sets without tags agree with none."""
    return len(a & b) / len(a | b) if a and b else 0.0


def cosine(a: Sequence[float] | None, b: Sequence[float] | None) -> float:
    """Vectors that are missing, of other length, zero or not finite agree with none."""
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return 0.0
    norms = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / norms if norms > 0 and math.isfinite(norms) else 0.0


class Fold:
    """The last rows kept of one group, and the seconds dropped."""

    def __init__(self, total: float, plan: Diversity) -> None:
        self.total, self.plan, self.dropped = total, plan, 0.0
        self.least = max(plan.least_seconds, total * plan.least_share)
        self.kept: deque = deque(maxlen=max(1, plan.runs, plan.recent))

    def reason(self, r: dict) -> str:
        """Why a row would go: alike by tags, then by vector; or empty."""
        plan, kept = self.plan, list(self.kept)
        alike = 0
        for other in kept[-max(1, plan.runs) :]:
            visual, background = overlap(r["visual"], other["visual"]), overlap(r["background"], other["background"])
            same_layout = r["layout"] and r["layout"] == other["layout"] and max(visual, background) >= plan.share
            alike += bool(same_layout or background >= plan.share and r["people"])
        if alike >= plan.runs:
            return "similar_tags"
        return "similar_vector" if any(cosine(r["vector"], other["vector"]) >= plan.cosine for other in kept[-max(1, plan.recent) :]) else ""

    def verdict(self, r: dict) -> tuple[bool, str]:
        """Whether a row stays, and why. Preserved rows stay first, then rows of people without a face go, then too little would be left, then likeness decides, unless the score is high."""
        seconds = r["seconds"] or 0.0
        if r["preserved"]:
            kept, why = True, "preserved"
        elif r["faceless"]:
            kept, why = False, "faceless"
        elif self.total - self.dropped - seconds < self.least:
            kept, why = True, "too_little_left"
        else:
            why = self.reason(r)
            kept = not why or (r["score"] or 0.0) >= self.plan.keep_score
            why = why if not kept else "high_score" if why else "new"
        if kept:
            self.kept.append(r)
        else:
            self.dropped += seconds
        return kept, why


def judged(rows: DataFrame, by: Sequence[str], key: str, plan: Diversity | None = None) -> DataFrame:
    """by, key, kept and why of every row. rows: by, key, at, seconds, score, faceless, vector and the columns of signatures().

    Ties of time go by key; null times come first, null seconds are none, null flags false.
    """
    plan = plan or Diversity()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = StructType.fromDDL(", ".join(f"`{c}` {kinds[c]}" for c in (*by, key)) + ", kept boolean, why string")
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                group = tuple(r[b] for b in by)
                if fold is None or group != now:
                    now, fold = group, Fold(r["total"], plan)
                slim = r | {"visual": frozenset(r["visual"] or ()), "background": frozenset(r["background"] or ())}
                kept, why = fold.verdict(slim)
                out.append({c: r[c] for c in (*by, key)} | {"kept": kept, "why": why})
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    totals = rows.groupBy(*by).agg(F.sum(F.coalesce(F.col("seconds").cast("double"), F.lit(0.0))).alias("total"))
    used = rows.select(*by, key, "at", "seconds", "score", "faceless", "vector", "visual", "background", "layout", "people", "preserved").join(totals, list(by))
    return used.repartition(*by).sortWithinPartitions(*by, "at", key).drop("at").mapInArrow(run, fields)
