"""Contract tables in full: duplicate manifests with reasons, purpose scores of both kinds of media, audits of segments by their text, capture dates as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chapters, dates, rules, scores, terms
from ..functions.scalars import clamp, hash_percent, letter_hash
from ..operators import duplicates, intervals, lookup
from .curation_queries import _ASSETS, assets
from .registry import LETTER_HASH, SQL, Tables, query

_BITS = 2


def records(t: Tables) -> DataFrame:
    """Documents as media files: their text is the content, two of three are photos."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    video = i % 3 == 0
    return t.documents.select(
        F.coalesce("lang", F.lit("")).alias("media_set"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), i.cast("string"), F.when(video, ".mp4").otherwise(".jpg")).alias("path"), F.md5(text.cast("binary")).alias("digest"), letter_hash(F.coalesce("text", F.lit(" "))).alias("visual"), video.alias("video"),
        F.when(video, "mp4").otherwise("jpg").alias("file_type"), F.octet_length(text).cast("long").alias("bytes"), F.when(i % 7 > 0, (640 * (1 + i % 2)).cast("int")).alias("width"), F.when(i % 7 > 0, (480 * (1 + i % 2)).cast("int")).alias("height"),
        F.when(video & (i % 5 > 0), F.length(text) / 100.0).alias("duration"), F.when(i % 2 > 0, "2024-01-01").alias("created"), F.lit("2024-02-02").alias("modified"),
    )


@query(f"""WITH RECURSIVE {LETTER_HASH}, r AS (SELECT coalesce(lang, '') AS media_set, coalesce(source, '') || '/' || d.doc_id || CASE WHEN d.doc_id % 3 = 0 THEN '.mp4' ELSE '.jpg' END AS path, md5(coalesce(text, '')) AS digest, bits, d.doc_id % 3 = 0 AS video, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
    CASE WHEN d.doc_id % 7 > 0 THEN CAST(640 * (1 + d.doc_id % 2) AS INTEGER) END AS width, CASE WHEN d.doc_id % 7 > 0 THEN CAST(480 * (1 + d.doc_id % 2) AS INTEGER) END AS height, CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 5 > 0 THEN length(coalesce(text, '')) / 100.0::DOUBLE END AS duration, d.doc_id % 2 AS created FROM documents d JOIN h ON h.doc_id = d.doc_id),
p AS (SELECT a.path AS a, b.path AS b, CASE WHEN a.digest = b.digest THEN 0 ELSE 1 END AS pr, CASE WHEN a.digest = b.digest THEN 0 ELSE bit_count(xor(a.bits, b.bits)) END AS d, CASE WHEN a.digest = b.digest THEN '{duplicates.EXACT}' WHEN a.video THEN '{duplicates.NEAR_VIDEO}' ELSE '{duplicates.NEAR_PHOTO}' END AS type
  FROM r a JOIN r b ON a.path <> b.path AND (a.digest = b.digest OR a.video = b.video AND bit_count(xor(a.bits, b.bits)) <= {_BITS} AND (NOT a.video OR NOT coalesce(a.width <> b.width OR a.height <> b.height, false) AND NOT coalesce(abs(a.duration - b.duration) > 2.0, false)))),
c AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node), g AS (SELECT node, min(root) AS root FROM c GROUP BY 1),
w AS (SELECT root, min({{'p': pr, 'd': d, 't': type}}) AS best FROM p JOIN g ON p.a = g.node GROUP BY 1),
k AS (SELECT root, arg_max(path, {{'a': coalesce(CAST(width AS BIGINT) * height, 0), 'b': coalesce(duration, 0.0), 'c': bytes, 'd': (width IS NOT NULL)::INT + (height IS NOT NULL)::INT + (duration IS NOT NULL)::INT + (created > 0)::INT, 'e': path}}) AS keeper FROM r JOIN g ON path = node GROUP BY 1)
SELECT media_set, root AS group_id, CASE WHEN path = keeper THEN 'keep' WHEN best.t = '{duplicates.NEAR_VIDEO}' THEN 'preserve' ELSE 'review' END AS action, path AS original_path, CASE WHEN path = keeper THEN '' ELSE keeper END AS duplicate_path, CASE WHEN video THEN 'mp4' ELSE 'jpg' END AS file_type, bytes AS size_bytes, width, height, duration AS duration_seconds,
  best.t AS duplicate_type, CAST(floor((64 - best.d) * 10000 / 64 + 0.5) AS BIGINT) AS similarity_score, CAST(best.d AS INTEGER) AS hash_distance,
  CASE WHEN best.t = '{duplicates.EXACT}' THEN 'same content; the best copy is kept' ELSE CASE WHEN best.t = '{duplicates.NEAR_PHOTO}' THEN 'photo' ELSE 'video' END || ' hashes differ in ' || best.d || ' of at most {_BITS} bits; the best copy is kept' END AS reason
FROM r JOIN g ON path = node JOIN w USING (root) JOIN k USING (root)""")
def duplicate_contract(t: Tables) -> DataFrame:
    """The duplicate manifest in all of its fourteen columns, with the reason of each group; near copies of videos are preserved."""
    return duplicates.manifest(records(t), _BITS, _BITS)


MAXIMISE, MINIMISE, REQUIRED, REJECTED = ("water", "rapids", "speed", "group_reactions"), ("walking", "static"), ("water", "tunnel", "gopro", "rapids"), ("walking", "talking")
_WORDS = "lower(name || ' ' || moment_type || ' ' || role || ' ' || array_to_string(tags, ' '))"


def _words() -> Column:
    return F.lower(F.concat_ws(" ", "name", "moment_type", "role", F.array_join("tags", " ")))


def _hits(names: tuple[str, ...]) -> Column:
    return sum((F.when(terms.says(F.col("words"), n), 1).otherwise(0) for n in names), F.lit(0))


def _says_sql(name: str) -> str:
    return "(" + " OR ".join(f"contains(words, '{n}')" for n in terms.needles(name)) + ")"


def _hits_sql(names: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN {_says_sql(n)} THEN 1 ELSE 0 END" for n in names) + ")"


def _c(sql: str) -> str:
    return f"least(greatest({sql}, 0.0), 100.0)"


def _hundredths(sql: str) -> str:
    return f"CAST(floor(({sql}) * 100 + 0.5) AS BIGINT)"


_INSTA, _MOVIE, _STABLE, _ALBUM = "((event_id * 7) % 101)::DOUBLE", "((event_id * 11) % 101)::DOUBLE", "((event_id * 13) % 101)::DOUBLE", "((event_id * 17) % 101)::DOUBLE"
_QUALITY = "((event_id * 19) % 101)::DOUBLE"
_FIT = _c(
    "0.22 * (CASE WHEN moment_type IN ('rapids', 'splash', 'launch') THEN 90.0 ELSE 45.0 END) + 0.20 * motion + 0.16 * audio + 0.14 * story + 0.10 * technical + 0.08 * people"
    f" + 0.05 * (CASE WHEN role IN ('action', 'group_action') THEN 100.0 WHEN role = 'reaction' THEN 78.0 ELSE 55.0 END) + 0.05 * {rules.CAMERA_SQL}"
    f" + least(6.0 * {_hits_sql(MAXIMISE)}, 24.0) - least(8.0 * {_hits_sql(MINIMISE)}, 28.0) + CASE WHEN moment_type IN ('launch', 'rapids', 'water_action', 'splash') THEN 10.0 ELSE 0.0 END"
)


@query(f"""WITH {_ASSETS}, w AS (SELECT *, {_WORDS} AS words FROM m), f AS (SELECT *, CAST({_FIT} AS DOUBLE) AS fit, {_INSTA} AS insta, {_MOVIE} AS movie, {_STABLE} AS stable, {_ALBUM} AS album, {_QUALITY} AS quality, {_c("seconds / 20 * 100")} AS length FROM w)
SELECT event_id, CASE WHEN video THEN 'video' ELSE 'photo' END AS kind, {_hundredths("fit")} AS activity, {_hundredths(_c("0.55 * album + 0.25 * people + 0.20 * technical"))} AS album,
  {_hundredths("CASE WHEN video THEN " + _c("0.48 * fit + 0.18 * motion + 0.12 * audio + 0.12 * insta + 0.10 * technical") + " ELSE " + _c("0.40 * insta + 0.25 * fit + 0.20 * people + 0.15 * technical") + " END")} AS reel,
  {_hundredths("CASE WHEN video THEN " + _c("0.28 * movie + 0.24 * fit + 0.24 * story + 0.14 * length + 0.10 * stable") + " ELSE " + _c("0.35 * movie + 0.30 * story + 0.20 * fit + 0.15 * technical") + " END")} AS documentary,
  {_hundredths("CASE WHEN video THEN " + _c("0.45 * greatest(quality, fit) + 0.25 * story + 0.20 * length + 0.10 * people") + " ELSE " + _c("0.60 * greatest(quality, album, fit) + 0.25 * story + 0.15 * people") + " END")} AS capsule,
  'bucket=' || {rules.BUCKET_SQL} || '; more=' || CAST({_hits_sql(MAXIMISE)} AS VARCHAR) || '; less=' || CAST({_hits_sql(MINIMISE)} AS VARCHAR) AS reason FROM f""")
def purpose_outputs(t: Tables) -> DataFrame:
    """Every purpose score of videos and photos, each from inputs of its own, in hundredths, and why."""
    c, i = F.col, F.col("event_id")
    given = {name: (i * k % 101).cast("double") for name, k in (("insta", 7), ("movie", 11), ("stable", 13), ("album_score", 17), ("quality", 19))}
    m = assets(t).withColumn("words", _words()).withColumns({**given, "length": clamp(c("seconds") / 20 * 100), "more": _hits(MAXIMISE), "less": _hits(MINIMISE)})
    moment = F.when(c("moment_type").isin("rapids", "splash", "launch"), 90.0).otherwise(45.0)
    fit = scores.activity_fit(moment, c("motion"), c("audio"), c("story"), c("technical"), c("people"), c("role"), rules.camera_score(c("name")), c("more"), c("less"), c("moment_type").isin("launch", "rapids", "water_action", "splash"))
    m = m.withColumn("fit", fit)
    video = scores.video_purposes(c("fit"), c("motion"), c("audio"), c("insta"), c("technical"), c("movie"), c("story"), c("length"), c("stable"), c("quality"), c("people"))
    photo = scores.photo_purposes(c("insta"), c("fit"), c("people"), c("technical"), c("movie"), c("story"), c("quality"), c("album_score"))
    both = {k: F.when(c("video"), video[k]).otherwise(photo[k]) for k in video}
    out = {"activity": c("fit"), "album": clamp(0.55 * c("album_score") + 0.25 * c("people") + 0.20 * c("technical")), **both}
    reason = F.concat(F.lit("bucket="), rules.bucket(c("moment_type"), c("role")), F.lit("; more="), c("more"), F.lit("; less="), c("less"))
    return m.select("event_id", F.when(c("video"), "video").otherwise("photo").alias("kind"), *[F.floor(v * 100 + 0.5).alias(k) for k, v in out.items()], reason.alias("reason"))


_RAMP = ("lit_tunnel", "mud_water_run", "water_crossing", "water_speed_run", "speed_action")
_SHARE = 60.0  # of rows that may be sped up are
_PERCENT = "CAST(CAST('0x' || substr(sha1(name), 1, 8) AS BIGINT) % 10000 AS DOUBLE) / 100"


@query(f"""WITH {_ASSETS}, w AS (SELECT *, {_WORDS} AS words FROM m), f AS (SELECT *, 58.0 + least(8.0 * {_hits_sql(REQUIRED)}, 28.0) - least(20.0 * {_hits_sql(REJECTED)}, 60.0) + CASE WHEN motion >= 60 THEN 6.0 ELSE 0.0 END AS raw, {_hits_sql(REJECTED)} AS rejected FROM w)
SELECT event_id, CAST({_c("raw")} AS DOUBLE) AS confidence, rejected > 0 OR raw < 45 AS mismatch,
  CASE WHEN NOT ({" OR ".join(_says_sql(x) for x in REQUIRED)}) AND motion < 70 THEN 'text_candidate' ELSE concat_ws(',', {", ".join(f"CASE WHEN {_says_sql(x)} THEN '{x}' END" for x in REQUIRED)}, CASE WHEN motion >= 70 THEN 'hero_action' END) END AS audit_tags,
  CASE WHEN role IN ('action', 'group_action', 'supporting') AND list_has_any(tags, [{", ".join(f"'{x}'" for x in _RAMP)}]) AND {_PERCENT} < {_SHARE} THEN CASE WHEN greatest(motion, audio) >= 82 THEN 1.45 WHEN greatest(motion, audio) >= 58 THEN 1.25 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS speed FROM f""")
def segment_audits(t: Tables) -> DataFrame:
    """What the text of a segment says about it, without a look at its pictures: confidence, whether it is of another activity, tags, and how fast it may be shown."""
    c = F.col
    m = assets(t).withColumn("words", _words())
    rejected = _hits(REJECTED)
    raw = 58.0 + F.least(8.0 * _hits(REQUIRED), F.lit(28.0)) - F.least(20.0 * rejected, F.lit(60.0)) + F.when(c("motion") >= 60, 6.0).otherwise(0.0)
    tags = F.concat_ws(",", *[F.when(terms.says(c("words"), x), x) for x in REQUIRED], F.when(c("motion") >= 70, "hero_action"))
    strong = F.greatest("motion", "audio")
    fast = F.when(strong >= 82, 1.45).when(strong >= 58, 1.25).otherwise(1.0)
    chosen = c("role").isin("action", "group_action", "supporting") & rules.any_tag("tags", _RAMP) & (hash_percent(c("name")) < _SHARE)
    return m.select("event_id", clamp(raw).alias("confidence"), ((rejected > 0) | (raw < 45)).alias("mismatch"), F.when(tags == "", "text_candidate").otherwise(tags).alias("audit_tags"), F.when(chosen, fast).otherwise(1.0).alias("speed"))


_SHAPES = {
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "%Y-%m-%d %H:%M:%S", r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$": "%Y:%m:%d %H:%M:%S", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": "%Y-%m-%dT%H:%M:%S", r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$": "%d.%m.%Y %H:%M:%S",
    r"^\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}$": "%d %b %Y %H:%M", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2} [AP]M$": "%m/%d/%Y %I:%M %p", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$": "%m/%d/%Y %H:%M", r"^(?:19|20)\d{6}$": "%Y%m%d",
}
_ZONED = " ".join(f"WHEN regexp_matches(t, '{shape}') THEN epoch_us(try_cast(regexp_replace(t, '([+-]\\d{{2}})(\\d{{2}})$', '\\1:\\2') AS TIMESTAMPTZ))" for shape in dates.ZONED)
_LOCAL = " ".join(f"WHEN regexp_matches(t, '{shape}') THEN try_strptime(t, '{form}')" for shape, form in _SHAPES.items())


@query(rf"""WITH s AS (SELECT stamp_id, coalesce(zone, 'UTC') AS z, trim(raw) AS t FROM stamps), l AS (SELECT *, CASE {_LOCAL} END AS local FROM s), e AS (SELECT *, timezone(z, local) AS instant FROM l)
SELECT stamp_id, CASE WHEN regexp_matches(t, '^\d{{13}}$') THEN CAST(t AS BIGINT) * 1000 WHEN regexp_matches(t, '^\d{{10}}$') THEN CAST(t AS BIGINT) * 1000000 {_ZONED} ELSE epoch_us(CASE WHEN timezone(z, instant - INTERVAL 1 HOUR) = local THEN instant - INTERVAL 1 HOUR ELSE instant END) END AS instant_us FROM e""")
def written_dates(t: Tables) -> DataFrame:
    """The instants that stamps name, whatever way they are written."""
    return t.stamps.select("stamp_id", dates.instant(F.col("raw"), F.col("zone")).alias("instant_us"))


_TARGET_MS, _LEAST_SCENES, _LEAST_SCENE_MS = 1_800_000, 3, 2_500


@query(f"""WITH {_ASSETS}, v AS (SELECT event_id, media_set, moment_type, t0, CAST(floor(t0 / 21600) AS BIGINT) AS moment, CAST(floor(least(greatest(seconds, 2.5), 12.0) * 1000 + 0.5) AS BIGINT) AS ms FROM m WHERE video),
a AS (SELECT media_set, min(t0) AS first, sum(ms) AS available FROM v GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY first, media_set) AS chapter, greatest({_LEAST_SCENES * _LEAST_SCENE_MS}, {_TARGET_MS} * available / sum(available) OVER ()) AS target FROM a),
r AS (SELECT v.*, chapter, target, row_number() OVER w AS n, sum(ms) OVER w - ms AS before FROM v JOIN c USING (media_set) WINDOW w AS (PARTITION BY media_set ORDER BY t0, event_id)),
k AS (SELECT *, row_number() OVER o AS sequence, sum(ms) OVER o AS until, lag(chapter) OVER o AS last_chapter, lag(moment) OVER o AS last_moment FROM r WHERE before < target OR n <= {_LEAST_SCENES} WINDOW o AS (ORDER BY chapter, t0, event_id))
SELECT sequence, 'activity_' || lpad(chapter::VARCHAR, 2, '0') || '_' || media_set AS chapter_id, event_id, moment, CAST(until - ms AS BIGINT) AS output_start_ms, CAST(until AS BIGINT) AS output_end_ms, ms AS duration_ms,
  CASE WHEN last_chapter IS NULL THEN 'opening' WHEN last_chapter <> chapter THEN 'chapter_bridge' WHEN last_moment = moment THEN 'continuous_sequence' ELSE 'hard_cut' END AS transition, {rules.ROLE_SQL} AS story_role FROM k""")
def documentary_contract(t: Tables) -> DataFrame:
    """The documentary's rows: a chapter for each activity in order of its first scene, with a share of the running time as its footage has one, each scene on the output's clock.

    A chapter takes its scenes in order until it has its share and at least three. Its seconds follow those of the chapters before it; these are as many numbers as there are
    chapters, so scenes are numbered by chapter, and no window runs over all of them.
    """
    c = F.col
    ms = F.floor(F.least(F.greatest("seconds", F.lit(2.5)), F.lit(12.0)) * 1000 + 0.5)
    v = assets(t).where("video").select("event_id", "media_set", "moment_type", "at", F.floor(c("at") / 21_600).alias("moment"), ms.alias("ms"))
    footage = v.groupBy("media_set").agg(F.min("at").alias("first"), F.sum("ms").alias("available"))
    total = footage.agg(F.sum("available").alias("total"))
    target = F.greatest(F.lit(float(_LEAST_SCENES * _LEAST_SCENE_MS)), F.lit(_TARGET_MS) * c("available") / c("total"))
    chapters = footage.crossJoin(F.broadcast(total)).withColumns({"target": target, "chapter": F.row_number().over(Window.orderBy("first", "media_set"))})
    scenes = Window.partitionBy("media_set").orderBy("at", "event_id")
    r = v.join(chapters, "media_set").withColumns({"n": F.row_number().over(scenes), "before": F.sum("ms").over(scenes) - c("ms")})
    kept = r.where((c("before") < c("target")) | (c("n") <= _LEAST_SCENES)).withColumn("last_moment", F.lag("moment").over(scenes))
    sizes = kept.groupBy("chapter").agg(F.count("*").alias("rows"), F.sum("ms").alias("length"))
    ahead = Window.orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("chapter", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("ms_before"))
    k = kept.join(F.broadcast(starts), "chapter")
    transition = F.when((c("n") == 1) & (c("rows_before") == 0), "opening").when(c("n") == 1, "chapter_bridge").when(c("last_moment") == c("moment"), "continuous_sequence").otherwise("hard_cut")
    begin = c("ms_before") + c("before")
    return k.select(
        (c("rows_before") + c("n")).alias("sequence"), F.concat(F.lit("activity_"), F.lpad(c("chapter").cast("string"), 2, "0"), F.lit("_"), c("media_set").cast("string")).alias("chapter_id"), "event_id", "moment", begin.alias("output_start_ms"), (begin + c("ms")).alias("output_end_ms"), c("ms").alias("duration_ms"),
        transition.alias("transition"), rules.story_role(c("moment_type")).alias("story_role"),
    )


_SAID = "CASE event_id % 4 WHEN 0 THEN 'cam/' || media_set || '/' || name WHEN 1 THEN 'old/' || upper(name) WHEN 2 THEN name ELSE 'lost/' || event_id || '.x' END"


@query(f"""WITH {_ASSETS}, f AS (SELECT 'cam/' || media_set || '/' || name AS path, name, technical FROM m WHERE event_id % 3 > 0 UNION ALL SELECT 'copy/' || name, name, story FROM m WHERE event_id % 9 = 1),
n AS (SELECT lower(name) AS low, count(*) AS n, min(path) AS one_path, arg_min(technical, path) AS value FROM f GROUP BY 1), r AS (SELECT event_id, {_SAID} AS said FROM m)
SELECT event_id, CASE WHEN f.path IS NOT NULL THEN f.path WHEN n = 1 THEN one_path END AS found_path, CASE WHEN f.path IS NOT NULL THEN 'path' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS found_by, CASE WHEN f.path IS NOT NULL THEN f.technical WHEN n = 1 THEN value END AS technical
FROM r LEFT JOIN f ON f.path = said LEFT JOIN n ON low = lower(regexp_replace(said, '^.*/', ''))""")
def path_lookup(t: Tables) -> DataFrame:
    """Files by what rows say of them: by path, else by a name that only one file has."""
    m = assets(t)
    own = F.concat(F.lit("cam/"), F.col("media_set").cast("string"), F.lit("/"), "name")
    files = m.where("event_id % 3 > 0").select(own.alias("path"), "technical").union(m.where("event_id % 9 = 1").select(F.concat(F.lit("copy/"), "name"), F.col("story")))
    i = F.col("event_id")
    said = F.when(i % 4 == 0, own).when(i % 4 == 1, F.concat(F.lit("old/"), F.upper("name"))).when(i % 4 == 2, F.col("name")).otherwise(F.concat(F.lit("lost/"), i.cast("string"), F.lit(".x")))
    return lookup.looked_up(m.select("event_id", said.alias("said")), "said", files, "path", ["technical"]).drop("said")


LADDER = ("container", "exif", "content_created", "file_created")


_STEPS = ", ".join(f"'{x}'" for x in (*LADDER, "modified"))


@query(f"""WITH w AS ({SQL["written_dates"]}), r AS (SELECT stamp_id // 5 AS media_id, min({{'k': stamp_id, 'us': instant_us}}) AS b FROM w WHERE instant_us IS NOT NULL GROUP BY 1)
SELECT media_id, b.us AS capture_us, [{_STEPS}][CAST(b.k % 5 + 1 AS INTEGER)] AS capture_source FROM r""")
def capture_ladder(t: Tables) -> DataFrame:
    """The capture date of a file is the first of five that can be read: of its container, its picture data, two of the file system, and when it was last written. Five stamps are one file's."""
    read = t.stamps.select("stamp_id", dates.instant(F.col("raw"), F.col("zone")).alias("instant_us")).where("instant_us is not null")
    best = read.groupBy(F.floor(F.col("stamp_id") / 5).alias("media_id")).agg(F.min(F.struct("stamp_id", "instant_us")).alias("b"))
    source = F.element_at(F.array(*map(F.lit, (*LADDER, "modified"))), (F.col("b.stamp_id") % 5 + 1).cast("int"))
    return best.select("media_id", F.col("b.instant_us").alias("capture_us"), source.alias("capture_source"))


_NAMES, _SHARES, _WEIGHTS = list(chapters.CHAPTERS), [s for s, _ in chapters.CHAPTERS.values()], [w for _, w in chapters.CHAPTERS.values()]
_RUNNING = 240.0
_CHAPTER = "CASE " + " ".join(f"WHEN moment_type IN ({', '.join(f"'{x}'" for x in kinds)}) THEN '{name}'" for name, kinds in chapters.MOMENTS.items()) + " ELSE 'reflection' END"
_PLACES = f"range(1, {len(_NAMES) + 1})"


@query(f"""WITH RECURSIVE {_ASSETS}, a AS (SELECT media_set, {_CHAPTER} AS chapter, CAST(sum(CAST(round(least(seconds, 12.0) * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS available FROM m WHERE video GROUP BY 1, 2),
g AS (SELECT media_set, map(list(chapter), list(available)) AS have FROM a GROUP BY 1),
s AS (SELECT media_set, list_transform({[*_NAMES]}, lambda n: coalesce(have[n], 0.0)::DOUBLE) AS av, list_transform({_SHARES}, lambda x: (x * {_RUNNING})::DOUBLE) AS want FROM g),
f AS (SELECT media_set, av, list_transform({_PLACES}, lambda i: least(want[i], av[i])) AS now, list_reduce(want, lambda x, y: x + y, 0.0::DOUBLE) - list_reduce(list_transform({_PLACES}, lambda i: least(want[i], av[i])), lambda x, y: x + y, 0.0::DOUBLE) AS rest, 0 AS k FROM s
  UNION ALL SELECT media_set, av, list_transform({_PLACES}, lambda i: now[i] + add[i]), rest - list_reduce(add, lambda x, y: x + y, 0.0::DOUBLE), k + 1
  FROM (SELECT *, list_transform({_PLACES}, lambda i: CASE WHEN w[i] > 0 AND rest > 0.01 THEN least(av[i] - now[i], rest * (w[i] / whole)) ELSE 0.0 END::DOUBLE) AS add
    FROM (SELECT *, list_reduce(w, lambda x, y: x + y, 0.0::DOUBLE) AS whole FROM (SELECT *, list_transform({_PLACES}, lambda i: CASE WHEN av[i] - now[i] > 0.01 THEN {_WEIGHTS}[i] ELSE 0.0 END::DOUBLE) AS w FROM f WHERE k < {len(_NAMES)}))))
SELECT media_set, {[*_NAMES]}[i] AS chapter, CAST(round(av[i] * 1000) AS BIGINT) AS available_ms, CAST(round(now[i] * 1000) AS BIGINT) AS target_ms FROM (SELECT *, unnest({_PLACES}) AS i FROM f WHERE k = {len(_NAMES)})""")
def chapter_seconds(t: Tables) -> DataFrame:
    """The seconds of each chapter of each media set's documentary: its share, cut at what it has, and what it takes over from chapters that have less."""
    v = assets(t).where("video").select("media_set", chapters.chapter(F.col("moment_type")).alias("chapter"), F.round(F.least("seconds", F.lit(12.0)) * 1000).cast("long").alias("ms"))
    have = v.groupBy("media_set").pivot("chapter", _NAMES).agg(F.sum("ms") / 1000)
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    available = F.array(*[F.coalesce(n, F.lit(0.0)) for n in _NAMES])
    target = chapters.filled(numbers(x * _RUNNING for x in _SHARES), available, numbers(_WEIGHTS))
    each = F.arrays_zip(F.array(*map(F.lit, _NAMES)).alias("chapter"), available.alias("available"), target.alias("target"))
    return have.select("media_set", F.explode(each).alias("c")).select("media_set", "c.chapter", F.round(F.col("c.available") * 1000).cast("long").alias("available_ms"), F.round(F.col("c.target") * 1000).cast("long").alias("target_ms"))


@query(r"""WITH p AS (SELECT DISTINCT lower(array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 4), ' ')) AS phrase FROM benchmark WHERE len(regexp_extract_all(text, '\S+')) >= 4),
l AS (SELECT doc_id, i - 1 AS line, ' ' || lower(array_to_string(regexp_extract_all(lines[i], '\S+'), ' ')) || ' ' AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT DISTINCT doc_id, line FROM l JOIN p ON contains(said, ' ' || phrase || ' ')), o AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= 1 THEN 0 ELSE 1 END AS opens FROM h),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM o)
SELECT doc_id, CAST(min(line) * 4000 - 250 AS BIGINT) AS start_ms, CAST(max(line) * 4000 + 4250 AS BIGINT) AS end_ms, count(*) AS n_merged FROM g GROUP BY doc_id, island""")
def phrase_mute_windows(t: Tables) -> DataFrame:
    """Where phrases of a table are said: lines are four seconds each, a quarter of a second is added on both sides, and windows that meet are one. The phrases are the first four words of benchmark items."""
    said = lambda c: F.concat(F.lit(" "), F.lower(F.array_join(F.regexp_extract_all(c, F.lit(r"\S+"), 0), " ")), F.lit(" "))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    phrases = t.benchmark.where(F.size(words) >= 4).select(F.lower(F.array_join(F.slice(words, 1, 4), " ")).alias("term")).distinct()
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    keyed = lines.select(F.struct("doc_id", "line").alias("at"), said(F.col("words")).alias("words"))
    hits = terms.term_hits(keyed, "at", "words", phrases.select("term", F.concat(F.lit(" "), "term", F.lit(" ")).alias("needle"))).select("at").distinct()
    spans = hits.select(F.col("at.doc_id").alias("doc_id"), (F.col("at.line") * 4.0 - 0.25).alias("start_s"), (F.col("at.line") * 4.0 + 4.25).alias("end_s"))
    merged = intervals.islands(spans, ["doc_id"])
    return merged.select("doc_id", F.round(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.round(F.col("end_s") * 1000).cast("long").alias("end_ms"), "n_merged")
