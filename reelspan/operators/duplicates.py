"""Duplicate groups of media with their reasons, keepers and manifest rows.

Files of one digest are exact copies. Photos, and videos that can be compared, are near copies if their visual hashes nearly agree: videos of known but other dimensions, or of known lengths more than two
seconds apart, cannot. Rows that agree in all of this are one class, so no pairs of copies are made; classes are linked where their hashes meet (up to two bits, in proportion to the hashes) or through blocks of their hashes (more bits),
and components of the links are groups. Classes of videos of one hash, of two near ones, or that meet at a value, are linked with their neighbours in length only, so their links grow with the number of classes and not with that of their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .graph import connected_components
from .similarity import _near_hashes, meeting_points, one_bit_pairs, star_hashes

APART_SECONDS = 2.0
EXACT, NEAR_PHOTO, NEAR_VIDEO = "exact_hash", "photo_visual_similarity", "video_visual_similarity"
PRIORITY = {EXACT: 0, NEAR_PHOTO: 1, NEAR_VIDEO: 1}  # fixed values: which reason a group is given


def neighbour_links(classes: DataFrame, near: DataFrame) -> DataFrame:
    """meeting_links() of near hashes: near holds the pairs (ha, hb) of different hashes that are near."""
    return meeting_links(classes, near.select(F.explode(F.array("ha", "hb")).alias("h"), "ha", "hb"))


def meeting_links(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, distance) of videos that can be compared, of one hash or of a group of hashes: six at most for each class of each, which join and rate what all pairs of comparable classes do.

    classes: first, h, width, height, duration; groups: h, ha, hb (null: none), where hashes of equal ha and hb meet, either two or a value and what is one bit from it. Classes whose dimensions are known meet those of equal ones; one
    whose dimensions are unknown meets all. Of those within APART_SECONDS of a length the nearest are enough, as these are linked with the ones beyond, and on the way from one hash to the other two that are linked differ in it.
    Outside its own hash, the first and last of a span of APART_SECONDS stand for those between. A class of unknown length meets every length, so one of a kind is enough for all others.
    Frames of rows begin with their group: one that ends with it costs the square of its rows.
    """
    known = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    rows = classes.select("first", "h", F.when(known, F.col("width")).alias("width"), F.when(known, F.col("height")).alias("height"), "duration")
    span, item = F.floor(F.nanvl(F.col("duration") / APART_SECONDS, F.lit(float("inf")))), F.struct("duration", "first")
    ends = rows.groupBy("h", "width", "height", span.alias("span")).agg(F.array_distinct(F.array(F.min(item), F.max(item))).alias("ends"))
    ends = ends.select("h", "width", "height", F.explode("ends").alias("end")).select("end.first", "h", "width", "height", "end.duration")
    own = rows.withColumns({"ha": F.col("h"), "hb": F.col("h")})
    met = ends.join(groups, "h").select(*own.columns).union(own)

    it, timed, unknown = F.struct("first", "h"), F.col("duration").isNotNull(), F.col("width").isNull()
    any_shape, one_shape = Window.partitionBy("ha", "hb"), Window.partitionBy("ha", "hb", "width", "height")
    upwards, downwards = (F.asc_nulls_last("duration"), F.asc("first")), (F.desc_nulls_first("duration"), F.desc("first"))
    found = {}
    # of equal shapes the later one of two finds the earlier one; those of unknown shape are sought on both sides
    for name, window, wanted in (("equal_before", one_shape.orderBy(*upwards), timed), ("open_before", any_shape.orderBy(*upwards), timed & unknown), ("open_after", any_shape.orderBy(*downwards), timed & unknown)):
        nearest = F.last(F.when(wanted, F.struct("duration", it.alias("it"))), True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        found[name] = F.when(timed & (F.abs(F.col("duration") - nearest["duration"]) <= APART_SECONDS), nearest["it"])
    found["untimed"] = F.min(F.when(~timed & unknown, it)).over(any_shape)
    found["untimed_equal"] = F.min(F.when(~timed, it)).over(one_shape)
    found["untimed_known"] = F.when(unknown, F.min(F.when(~timed & ~unknown, it)).over(any_shape))
    found["shapeless"] = F.when(~timed & ~unknown, F.min(F.when(unknown, it)).over(any_shape))
    linked = met.select("first", "h", F.array_compact(F.array(*found.values())).alias("others"))
    linked = linked.select(F.col("first").alias("a"), "h", F.explode(F.array_distinct("others")).alias("other"))
    return linked.select("a", F.col("other.first").alias("b"), F.bit_count(F.col("h").bitwiseXOR(F.col("other.h"))).cast("int").alias("distance")).where("a <> b").distinct()


def links(records: DataFrame, photo_bits: int, video_bits: int) -> DataFrame:
    """(a, b, kind of reason, distance) between paths, enough of them to join what belongs together and to know each group's best reason."""
    exact = records.where("digest is not null").groupBy("digest").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = records.join(exact, "digest").where("path <> first").select(F.col("first").alias("a"), F.col("path").alias("b"), F.lit(EXACT).alias("type"), F.lit(0).alias("distance"))
    for video, bits, name in ((False, photo_bits, NEAR_PHOTO), (True, video_bits, NEAR_VIDEO)):
        shape = [F.col(c) if video else F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("duration", "double"))]
        own = records.where((F.col("video") == video) & F.col("visual").isNotNull()).select("path", F.col("visual").alias("h"), *shape)
        keys = ["h", "width", "height", "duration"]
        classes = scratch.written(own.groupBy(*keys).agg(F.min("path").alias("first")), "duplicate-classes")
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        members = own.alias("x").join(classes.alias("c"), same[0] & same[1] & same[2] & same[3]).where("x.path <> c.first").select(F.col("c.first").alias("a"), F.col("x.path").alias("b"), F.lit(name).alias("type"), F.lit(0).alias("distance"))
        hashes = classes.select("h").distinct()
        if video and bits == 2:
            found = meeting_links(classes, meeting_points(hashes).select("h", F.col("point").alias("ha"), F.lit(None).cast("long").alias("hb")))
        else:
            near = one_bit_pairs(meeting_points(hashes)) if bits == 1 else star_hashes(meeting_points(hashes)) if bits == 2 else _near_hashes(hashes, bits)
            near, a, b = scratch.written(near, "near-hashes"), classes.alias("a"), classes.alias("b")
            found = neighbour_links(classes, near) if video else near.join(a, F.col("ha") == F.col("a.h")).join(b, F.col("hb") == F.col("b.h")).select(F.col("a.first").alias("a"), F.col("b.first").alias("b"), "distance")
        out = out.union(members).union(found.select("a", "b", F.lit(name).alias("type"), "distance"))
    return out


def quality(prefix: str = "") -> Column:
    """By what the keeper of a group is chosen: pixels, length, bytes, filled fields, path."""
    c = lambda name: F.col(prefix + name)
    filled = sum((c(x).isNotNull().cast("int") for x in ("width", "height", "duration", "created", "modified")), F.lit(0))
    pixels = F.coalesce(c("width"), F.lit(0)).cast("long") * F.coalesce(c("height"), F.lit(0)).cast("long")
    return F.struct(pixels.alias("pixels"), F.coalesce(c("duration"), F.lit(0.0)).alias("seconds"), c("bytes").alias("bytes"), filled.alias("filled"), c("path").alias("path"))


def manifest(records: DataFrame, photo_bits: int = 6, video_bits: int = 6, preserve_videos: bool = True) -> DataFrame:
    """A row for each member of a group: media_set, group_id (the least path), action (keep, review or preserve), original_path, duplicate_path, file_type, size_bytes, width, height,
    duration_seconds, duplicate_type, similarity_score, hash_distance, reason.

    records: media_set, path (unique), digest, visual (a 64-bit hash), video (boolean), file_type, bytes, width, height, duration, created, modified. The reason of a group is its best one: an exact copy first, then the
    least distance. The keeper is the best member; near copies of videos may be preserved, as they are often other takes. Null digests and hashes are like no other.
    """
    records = scratch.written(records, "records")  # read several times, and a hash may cost a pass over a file
    found = scratch.written(links(records, photo_bits, video_bits), "duplicate-links")
    roots = scratch.written(connected_components(found.select("a", "b")), "duplicate-groups")
    order = F.struct(F.when(F.col("type") == EXACT, PRIORITY[EXACT]).otherwise(PRIORITY[NEAR_PHOTO]).alias("p"), "distance", "type")
    reasons = found.join(roots, found["a"] == roots["node"]).groupBy("root").agg(F.min(order).alias("best"))
    members = records.join(roots.withColumnRenamed("node", "path"), "path")
    keepers = members.groupBy("root").agg(F.max(quality()).alias("q")).select("root", F.col("q.path").alias("keeper"))
    rows = members.join(scratch.written(reasons.join(keepers, "root"), "group-reasons"), "root")
    limit = F.when(F.col("best.type") == NEAR_PHOTO, photo_bits).otherwise(video_bits)
    reason = F.when(F.col("best.type") == EXACT, "same content; the best copy is kept").otherwise(F.concat(F.when(F.col("best.type") == NEAR_PHOTO, "photo").otherwise("video"), F.lit(" hashes differ in "), F.col("best.distance"), F.lit(" of at most "), limit, F.lit(" bits; the best copy is kept")))
    keeps = F.col("path") == F.col("keeper")
    action = F.when(keeps, "keep").when((F.col("best.type") == NEAR_VIDEO) & F.lit(preserve_videos), "preserve").otherwise("review")
    return rows.select(
        "media_set", F.col("root").alias("group_id"), action.alias("action"), F.col("path").alias("original_path"), F.when(keeps, "").otherwise(F.col("keeper")).alias("duplicate_path"), "file_type", F.col("bytes").alias("size_bytes"), "width", "height",
        F.col("duration").alias("duration_seconds"), F.col("best.type").alias("duplicate_type"), F.floor((64 - F.col("best.distance")) * 10000 / 64 + 0.5).alias("similarity_score"), F.col("best.distance").alias("hash_distance"), reason.alias("reason"),
    )
