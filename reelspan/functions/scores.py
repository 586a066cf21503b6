"""The scoring formulas of all stages as expressions; scores run from 0 to 100.

The weights are fixed values of the product; each function names what it blends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp


def resolution(pixels: Column, video: bool) -> Column:
    return clamp(pixels / (1920.0 * 1080.0 if video else 4000.0 * 3000.0) * 85 + 15)


def exposure(mean: Column, dark: Column, bright: Column) -> Column:
    """dark, bright: shares of pixels at either end."""
    return clamp(100 - 0.6 * F.abs(mean - 128) - 160 * (dark + bright))


def photo_technical(res: Column, sharp: Column, exposed: Column, contrast: Column) -> Column:
    return clamp(0.35 * res + 0.35 * sharp + 0.20 * exposed + 0.10 * contrast)


def video_technical(res: Column, sharp: Column, exposed: Column, stable: Column, contrast: Column) -> Column:
    return clamp(0.25 * res + 0.25 * sharp + 0.20 * exposed + 0.20 * stable + 0.10 * contrast)


def motion_and_stability(difference: Column) -> tuple[Column, Column]:
    """From the mean difference of neighbouring frames; 50 and 50 where there is none."""
    motion, stable = clamp(5 * difference), clamp(100 - 4 * F.greatest(difference - 10, F.lit(0.0)))
    return F.coalesce(motion, F.lit(50.0)), F.coalesce(stable, F.lit(50.0))


def duration_score(seconds: Column, least: float) -> Column:
    score = clamp(seconds / 20 * 100)
    return F.when((seconds > 0) & (seconds < least), score / 2).otherwise(score)


def orientation(width: Column, height: Column) -> Column:
    ratio = width / F.when(height > 0, height)
    return F.when(ratio < 0.8, "vertical").when(ratio > 1.4, "wide").when(ratio.isNotNull(), "square_friendly")


def activity_fit(moment: Column, motion: Column, audio: Column, story: Column, technical: Column, people: Column, role: Column, camera: Column, more: Column, less: Column, adventure: Column) -> Column:
    """more, less: hits of terms to favour and to avoid; adventure: goal and type agree."""
    role_score = F.when(role.isin("action", "group_action"), 100.0).when(role == "reaction", 78.0).otherwise(55.0)
    blend = 0.22 * moment + 0.20 * motion + 0.16 * audio + 0.14 * story + 0.10 * technical + 0.08 * people + 0.05 * role_score + 0.05 * camera
    return clamp(blend + F.least(6.0 * more, F.lit(24.0)) - F.least(8.0 * less, F.lit(28.0)) + F.when(adventure, 10.0).otherwise(0.0))


def video_purposes(fit: Column, motion: Column, audio: Column, insta: Column, technical: Column, movie: Column, story: Column, duration: Column, stable: Column, quality: Column, people: Column) -> dict[str, Column]:
    return {
        "reel": clamp(0.48 * fit + 0.18 * motion + 0.12 * audio + 0.12 * insta + 0.10 * technical),
        "documentary": clamp(0.28 * movie + 0.24 * fit + 0.24 * story + 0.14 * duration + 0.10 * stable),
        "capsule": clamp(0.45 * F.greatest(quality, fit) + 0.25 * story + 0.20 * duration + 0.10 * people),
    }


def photo_purposes(insta: Column, fit: Column, people: Column, technical: Column, movie: Column, story: Column, quality: Column, album: Column) -> dict[str, Column]:
    return {
        "reel": clamp(0.40 * insta + 0.25 * fit + 0.20 * people + 0.15 * technical),
        "documentary": clamp(0.35 * movie + 0.30 * story + 0.20 * fit + 0.15 * technical),
        "capsule": clamp(0.60 * F.greatest(quality, album, fit) + 0.25 * story + 0.15 * people),
    }


def people_of_faces(faces: Column) -> Column:
    return F.when(faces <= 0, 0.0).when(faces == 1, 72.0).when(faces == 2, 84.0).otherwise(F.least(F.lit(100.0), 88.0 + 3 * faces))


def album_diversity(photos: Column, hero: Column) -> Column:
    crowd = F.when(photos <= 2, 10.0).when(photos > 6, -F.least(3.0 * (photos - 6), F.lit(18.0))).otherwise(0.0)
    return clamp(70.0 + F.when(hero, 5.0).otherwise(0.0) + crowd, 35.0, 100.0)


def album_final(technical: Column, memory: Column, story: Column, people: Column, diversity: Column) -> Column:
    return 0.30 * technical + 0.30 * memory + 0.20 * story + 0.10 * people + 0.10 * diversity


def album_variant(strategy: Column, people: Column, memory: Column, story: Column, quality: Column, diversity: Column, candid: Column, final: Column) -> Column:
    social = 0.36 * people + 0.34 * memory + 0.12 * story + 0.10 * quality + 0.08 * diversity + F.when(candid, 10.0).otherwise(0.0)
    visual = 0.32 * story + 0.26 * memory + 0.22 * quality + 0.12 * diversity + 0.08 * people
    return F.when(strategy == "people_memory", social).when(strategy == "visual_story", visual).otherwise(final)


def clip_scores(quality: Column, brightness: Column, sharpness: Column, motion: Column, story: Column, people: Column, audio: Column, fit: Column, seconds: Column) -> dict[str, Column]:
    technical = 0.45 * quality + 0.20 * brightness + 0.35 * sharpness
    action = F.greatest(motion, F.lit(52.0))
    short, long = F.greatest(F.lit(0.0), 100 - 3 * F.abs(seconds - 12)), F.greatest(F.lit(0.0), 100 - 0.8 * F.abs(seconds - 45))
    return {
        "technical": technical,
        "reel": 0.38 * fit + 0.20 * action + 0.12 * short + 0.08 * technical,
        "documentary": 0.30 * story + 0.18 * fit + 0.14 * long + 0.10 * technical,
        "overall": 0.16 * technical + 0.18 * action + 0.06 * people + 0.20 * story + 0.14 * audio + 0.26 * fit,
    }


def reel_clarity(quality: Column, sharpness: Column, brightness: Column, action: Column, scenic: Column) -> Column:
    lift = F.when(action, 7.0).otherwise(0.0) + F.when(scenic, 3.0).otherwise(0.0)
    return clamp(0.55 * quality + 0.30 * clamp(sharpness / 4500 * 100) + 0.15 * clamp(100 - 1.25 * F.abs(brightness - 126)) + lift)


def whole(x: Column) -> Column:
    """A score in ten-thousandths, rounded half up."""
    return F.floor(x * 10_000 + 0.5)
