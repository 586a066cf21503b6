"""Selection of a media set's assets with a reason each: uses and thresholds, a quota, and enough running time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SelectionRules:
    photo_least: float = 65.0
    video_least: float = 60.0
    album: float = 70.0
    instagram: float = 72.0
    movie: float = 68.0
    least: int = 20
    most: int = 250
    percent: float = 10.0
    target_ms: int = 3_600_000
    preserve_all_videos: bool = False


def uses(rules: SelectionRules) -> Column:
    """What a row of album, reel, movie, capsule, fit and video is good for, as a comma list."""
    reel = F.col("reel")
    return F.concat_ws(
        ",",
        F.when(F.col("album") >= rules.album, "album"),
        F.when(reel >= rules.instagram, "instagram"),
        F.when(F.col("movie") >= rules.movie, "movie"),
        F.when(F.col("video") & (F.col("fit") >= 60) & (reel >= rules.instagram * 0.95), "activity_reel"),
        F.when(F.col("capsule") >= max(rules.photo_least, rules.video_least), "time_capsule"),
    )


def select_scores(rows: DataFrame, rules: SelectionRules) -> DataFrame:
    """rows (media_set, name, video, seconds, quality, reel, movie, capsule, album, fit) with uses, selected and reason.

    Videos that fill up the running time are taken in their order while time and number allow; as both only grow along
    that order, what is taken is a prefix, and sums over a window say where it ends.
    """
    of_set = Window.partitionBy("media_set")
    best = F.greatest("quality", "reel", "movie", "capsule")
    able = (F.col("quality") >= F.when(F.col("video"), rules.video_least).otherwise(rules.photo_least)) | (F.col("uses") != "")
    r = rows.withColumn("uses", uses(rules)).withColumn("able", able)
    r = r.withColumns({"rk": F.row_number().over(of_set.orderBy(F.desc(best), "name")), "n": F.count("*").over(of_set), "n_able": F.count_if("able").over(of_set)})
    r = r.withColumn("rk_able", F.sum(F.col("able").cast("int")).over(of_set.orderBy("rk")))
    target = F.least(F.lit(rules.most), F.greatest(F.lit(rules.least), F.bround(F.col("n") * (rules.percent / 100), 0)))
    reason = F.when(F.col("able") & (F.col("rk_able") <= rules.most), F.when(F.col("uses") == "", "selected by quality threshold").otherwise(F.concat(F.lit("selected for "), F.col("uses"))))
    if rules.preserve_all_videos:
        reason = F.coalesce(reason, F.when(F.col("video"), "selected to preserve source video for downstream timeline intelligence"))
    r = r.withColumn("reason", F.coalesce(reason, F.when(F.col("rk") <= target - F.col("n_able"), "selected by media-set quota")))
    ms = F.floor(F.col("seconds") * 1000)
    taken = F.col("reason").isNotNull()
    more = F.col("video") & ~taken & ((F.col("movie") >= rules.movie * 0.70) | (F.col("reel") >= rules.instagram * 0.70))
    r = r.withColumns({"have_ms": F.sum(F.when(taken & F.col("video"), ms).otherwise(0)).over(of_set), "have_n": F.count("reason").over(of_set), "more": more})
    order = Window.partitionBy("media_set", "video").orderBy(F.desc("movie"), F.desc("reel"), F.desc("fit"), "name").rowsBetween(Window.unboundedPreceding, -1)
    before_ms, before_n = F.coalesce(F.sum(F.when(F.col("more"), ms).otherwise(0)).over(order), F.lit(0)), F.coalesce(F.sum(F.col("more").cast("int")).over(order), F.lit(0))
    fills = F.col("more") & (F.col("have_ms") + before_ms < rules.target_ms) & (F.col("have_n") + before_n < rules.most)
    r = r.withColumn("reason", F.coalesce("reason", F.when(fills, "selected to preserve activity video runtime")))
    return r.select(*rows.columns, "uses", F.col("reason").isNotNull().alias("selected"), F.coalesce("reason", F.lit("below configured quality and purpose thresholds")).alias("reason"))
