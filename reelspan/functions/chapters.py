"""Chapters of a documentary: which moments belong to them, and how many seconds each gets of what there is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the chapters in their order, with their share of the running time, and with the weight by which they take over what others cannot fill
CHAPTERS = {
    "intro": (0.08, 0.08), "setup": (0.10, 0.03), "adventure": (0.16, 0.24), "peak": (0.24, 0.42),
    "people": (0.14, 0.05), "breath": (0.12, 0.16), "celebration": (0.10, 0.01), "reflection": (0.06, 0.01),
}
# fixed values: the moments of each chapter; others are reflection
MOMENTS = {
    "intro": ("travel_to_activity", "arrival", "venue_view"),
    "setup": ("check_in", "setup", "safety_briefing", "gear_up", "walk_to_start", "trail", "entrance", "beach_walk", "table_moment"),
    "adventure": ("launch", "activity", "jungle", "pool", "temple_details"),
    "peak": ("rapids", "water_action", "splash", "mud_action", "speed_action", "waterfall", "dancing"),
    "people": ("food", "drinks", "group_photo", "meal", "cheers", "conversation", "portrait"),
    "breath": ("sunset", "scenic", "ocean_view", "villa", "room"),
    "celebration": ("return_trip",),
}


def chapter(moment_type: Column) -> Column:
    return F.coalesce(*[F.when(moment_type.isin(*kinds), name) for name, kinds in MOMENTS.items()], F.lit("reflection"))


def filled(target: Column, available: Column, weight: Column, least: float = 0.01) -> Column:
    """Targets (an array of numbers) cut at what is available; what is cut off goes by weight to those that have more, as often as one of them is filled.

    Each round fills a chapter or ends the matter, so there are as many rounds as numbers; a null among the available is nothing. Expressions only, whatever the number of rows.
    """
    there = F.transform(available, lambda x: F.coalesce(x, F.lit(0.0)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    now = F.zip_with(target, there, lambda a, b: F.least(a, b))
    start = F.struct(now.alias("now"), (total(target) - total(now)).alias("left"))

    def step(s: Column, _: Column) -> Column:
        room = F.zip_with(there, s["now"], lambda a, b: a - b)
        shares = F.zip_with(weight, room, lambda w, r: F.when(r > least, w).otherwise(0.0))
        whole = total(shares)
        add = F.zip_with(shares, room, lambda w, r: F.when((w > 0) & (s["left"] > least), F.least(r, s["left"] * (w / whole))).otherwise(0.0))
        return F.struct(F.zip_with(s["now"], add, lambda a, b: a + b).alias("now"), (s["left"] - total(add)).alias("left"))

    return F.aggregate(F.sequence(F.lit(1), F.size(target)), start, step, lambda s: s["now"])
