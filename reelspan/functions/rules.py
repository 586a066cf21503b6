"""Decision lists over moments, roles, names, tags and sound, as expressions.

The word lists, thresholds and weights are fixed values of the product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp

# The kinds of moments, roles and tags.
MOMENT_TYPES = "arrival safety_briefing gear_up walk_to_start launch rapids water_action splash group_photo meal return_trip transition travel_to_activity scenic_view".split()
ROLES = "hook setup action group_action reaction scenic closing".split()
TAGS = "water_speed_run mud_water_run speed_action lit_tunnel water_crossing hero_action face_visible people_visible group_reaction ground_only setup_surface weak_close_pov".split()
OPENING, ENDING = ("arrival", "safety_briefing", "gear_up", "walk_to_start"), ("group_photo", "meal", "return_trip")
STORY_ROLES = {
    "action": ("rapids", "water_action", "splash", "launch"),
    "people": ("group_photo", "meal"),
    "context": ("arrival", "travel_to_activity", "transition"),
    "setup": ("safety_briefing", "gear_up", "walk_to_start"),
    "reflection": ("return_trip",),
}
PAYOFF_BONUS = {("water_speed_run",): 28.0, ("lit_tunnel",): 18.0, ("speed_action",): 12.0, ("mud_water_run", "water_crossing"): 10.0}

HIGHLIGHT_BONUS = {
    "hero_action": 10.0,
    "water_crossing": 8.0,
    "water_speed_run": 12.0,
    "mud_water_run": 8.0,
    "lit_tunnel": 12.0,
    "speed_action": 6.0,
    "group_reaction": 10.0,
    "face_visible": 8.0,
    "people_visible": 6.0,
    "ground_only": -30.0,
    "weak_close_pov": -46.0,
}


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# The same in SQL, over columns name, moment_type and role.
CAMERA_SQL = "CASE WHEN starts_with(lower(name), 'gx') OR contains(lower(name), 'gopro') OR starts_with(lower(name), 'gopr') THEN 100.0 WHEN starts_with(lower(name), 'img_') AND ends_with(lower(name), '.mov') THEN 72.0 WHEN contains(lower(name), 'meta') THEN 70.0 ELSE 55.0 END::DOUBLE"
BUCKET_SQL = f"CASE WHEN moment_type IN {_in(OPENING)} OR role IN ('hook', 'setup') THEN 'opening' WHEN moment_type IN {_in(ENDING)} OR role = 'closing' THEN 'ending' ELSE 'middle' END"
ROLE_SQL = "CASE " + " ".join(f"WHEN moment_type IN {_in(v)} THEN '{k}'" for k, v in STORY_ROLES.items()) + " ELSE 'supporting' END"


def camera_score(name: Column) -> Column:
    """What the name of a file says about its camera."""
    low = F.lower(name)
    action = F.startswith(low, F.lit("gx")) | F.contains(low, F.lit("gopro")) | F.startswith(low, F.lit("gopr"))
    phone = F.startswith(low, F.lit("img_")) & F.endswith(low, F.lit(".mov"))
    return F.when(action, 100.0).when(phone, 72.0).when(F.contains(low, F.lit("meta")), 70.0).otherwise(55.0)


def bucket(moment_type: Column, role: Column) -> Column:
    return F.when(moment_type.isin(*OPENING) | role.isin("hook", "setup"), "opening").when(moment_type.isin(*ENDING) | (role == "closing"), "ending").otherwise("middle")


def story_role(moment_type: Column) -> Column:
    return F.coalesce(*[F.when(moment_type.isin(*kinds), role) for role, kinds in STORY_ROLES.items()], F.lit("supporting"))


def tone(moment_type: Column, otherwise: Column) -> Column:
    return F.when(moment_type.isin("rapids", "water_action", "splash"), "excitement").when(moment_type.isin("group_photo", "meal"), "joy").otherwise(otherwise)


def any_tag(tags: str, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def tag_bonus(tags: str, gains: dict[str, float]) -> Column:
    """The sum of what each tag of a list adds or takes away."""
    total = F.lit(0.0)
    for tag, gain in gains.items():
        total = total + F.when(F.array_contains(tags, tag), gain).otherwise(0.0)
    return total


def payoff_bonus(tags: str) -> Column:
    """What a late row gains by its tags."""
    total = F.lit(0.0)
    for wanted, gain in PAYOFF_BONUS.items():
        total = total + F.when(any_tag(tags, wanted), gain).otherwise(0.0)
    return total


def _says(text: Column, words: str) -> Column:
    return text.rlike(words)


def reel_subscores(text: Column) -> dict[str, Column]:
    """Cinematic, memory and emotion scores over columns technical, story, audio, motion, people, role and moment_type."""
    role, kind = F.col("role"), F.col("moment_type")
    lift = lambda where, gain: F.when(where, gain).otherwise(0.0)
    shot = 0.38 * F.col("technical") + 0.30 * F.col("story") + 0.20 * F.col("audio") + 0.12 * F.least("motion", F.lit(80.0))
    warm = lift(role.isin("reaction", "group_action", "closing"), 12.0) + lift(kind.isin("group_photo", "gear_up", "walk_to_start", "meal"), 8.0) + lift(_says(text, "laugh|cheer|smile|group|friends|people"), 10.0)
    loud = lift(role.isin("reaction", "group_action"), 10.0) + lift(_says(text, "laugh|cheer|scream|excite|reaction|splash"), 14.0)
    return {
        "cinematic": clamp(shot + lift(_says(text, "scenic|landscape|river|waterfall|calm|view"), 8.0) - lift(F.col("motion") > 95, 5.0)),
        "memory": clamp(0.45 * F.col("people") + 0.35 * F.col("story") + 10.0 + warm),
        "emotion": clamp(0.42 * F.col("audio") + 0.24 * F.col("people") + 0.24 * F.col("story") + 5.0 + loud),
    }


def motion_context(motion: Column) -> Column:
    return F.when(motion >= 22, "high_action_motion").when(motion >= 10, "moderate_motion").otherwise("low_motion")


def audio_event(loud: Column, mean: Column) -> Column:
    """The kind of a sound by its loudness against its source's mean (a whole number), and by columns technical, people, moment_type and name.

    Tenths of the mean are quotients of whole numbers, as 0.7 and 2.8 are no doubles: a loudness that equals a bound is not over it.
    """
    name = F.lower("name")
    active = F.col("moment_type").isin("rapids", "splash", "launch") | F.contains(name, F.lit("gopr")) | F.contains(name, F.lit("gx"))
    bright = F.col("people")
    return (
        F.when(loud < F.greatest(F.lit(300.0), mean * 0.25), "silence_or_quiet")
        .when(loud > mean * 28 / 10, F.when((F.col("technical") > 80) | (bright > 26), "cheering_or_laughing_candidate").otherwise("loud_reaction_candidate"))
        .when(active & (loud > mean * 7 / 10) & (bright > 9), "river_or_action_noise")
        .when(loud.between(1500, F.greatest(mean * 2, F.lit(12000))) & F.col("technical").between(30, 70), "conversation_candidate")
        .when(bright > 25, "wind_or_high_frequency_noise")
        .otherwise("ambient_audio")
    )


def list_items(text: Column) -> Column:
    """The items of a comma list, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
