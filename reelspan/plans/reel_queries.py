"""Ranks by tags, refined windows, bursts, chronologies and face rules, over the assets of the curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores
from ..operators import intervals, selection
from .curation_queries import _ASSETS, _list, _whole, assets
from .registry import Tables, query

BURST = 900.0  # seconds
_BONUS = " + ".join(f"CASE WHEN list_contains(tags, '{t}') THEN {b} ELSE 0.0 END" for t, b in rules.HIGHLIGHT_BONUS.items())


@query(f"""WITH {_ASSETS}, r AS (SELECT event_id, media_set, {_whole(f"technical + 0.55 * motion + 0.45 * story + ({_BONUS})")} AS score, motion, audio, t0 FROM m)
SELECT event_id, score, CAST(row_number() OVER (PARTITION BY media_set ORDER BY score DESC, motion DESC, audio DESC, t0, event_id) AS INTEGER) AS rank FROM r""")
def highlight_rank(t: Tables) -> DataFrame:
    """The order in which a media set's rows are offered for its highlight: a weighted score with gains and losses by tag, then further keys."""
    score = 1.0 * F.col("technical") + 0.55 * F.col("motion") + 0.45 * F.col("story") + rules.tag_bonus("tags", rules.HIGHLIGHT_BONUS)
    r = assets(t).withColumn("score", scores.whole(score))
    rank = F.row_number().over(Window.partitionBy("media_set").orderBy(F.desc("score"), F.desc("motion"), F.desc("audio"), "at", "event_id"))
    return r.select("event_id", "score", rank.alias("rank"))


@query(f"""WITH RECURSIVE {_ASSETS}, c AS (SELECT event_id, role, t0 * 0 AS start_s, floor(seconds) AS end_s, greatest(floor(seconds) - 12.0, 0.0) AS last FROM m WHERE video),
w AS (SELECT *, unnest(list_slice(list_sort(list_distinct(list_append(list_transform(range(0, CAST(floor(last / 5.0) AS BIGINT) + 1), lambda i: i * 5.0::DOUBLE), last))), 1, 8)) AS a FROM c),
s AS (SELECT *, least(a + 12.0, end_s) AS b, {_whole("CASE WHEN role IN ('action', 'group_action') THEN least(a / greatest(0.1, end_s) * 8.0, 8.0) ELSE 8.0 - abs(a - 20.0) / 10.0 END")} AS score FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, a) AS i FROM s),
f AS (SELECT event_id, i, a, b, score, true AS kept, 1 AS n, [a] AS x, [b] AS y FROM o WHERE i = 1
  UNION ALL SELECT event_id, i, a, b, score, ok, n + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN list_append(x, a) ELSE x END, CASE WHEN ok THEN list_append(y, b) ELSE y END
  FROM (SELECT o.*, n, x, y, n < 3 AND len(list_filter(range(1, len(x) + 1), lambda k: o.a < y[k] + 0.1 AND x[k] < o.b + 0.1)) = 0 AS ok FROM f JOIN o ON o.event_id = f.event_id AND o.i = f.i + 1) z)
SELECT event_id, a AS start_s, b AS end_s, score, n::BIGINT AS pick FROM f WHERE kept""")
def refined_windows(t: Tables) -> DataFrame:
    """The three best windows of every video, none within a tenth of a second of another."""
    clips = assets(t).where("video").select("event_id", "role", F.lit(0.0).alias("start_s"), F.floor("seconds").cast("double").alias("end_s"))
    w = intervals.sliding(clips, 12.0, 5.0, 8)
    progress = F.least(F.col("window_start") / F.greatest(F.lit(0.1), F.col("end_s")) * 8.0, F.lit(8.0))
    score = F.when(F.col("role").isin("action", "group_action"), progress).otherwise(8.0 - F.abs(F.col("window_start") - 20.0) / 10.0)
    w = w.select("event_id", F.col("window_start").alias("start_s"), F.col("window_end").alias("end_s"), scores.whole(score).alias("score"))

    def fold(group: list[dict]):
        for pick, (i, _) in enumerate(selection.select(group, (selection.Pass(("-score", "start_s")),), selection.Limits(most=3, source="event_id", apart=0.1), "start_s"), 1):
            yield group[i] | {"pick": pick}

    return selection.by_group(w, ["event_id"], fold, "event_id long, start_s double, end_s double, score long, pick long")


@query(f"""WITH {_ASSETS}, p AS (SELECT event_id, media_set, t0, (event_id * 40503) % 65536 AS bits FROM m WHERE NOT video)
SELECT a.event_id AS a, b.event_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM p a JOIN p b ON a.media_set = b.media_set AND a.event_id < b.event_id AND abs(a.t0 - b.t0) < {BURST} AND bit_count(xor(a.bits, b.bits)) <= 5""")
def burst_pairs(t: Tables) -> DataFrame:
    """Photos of a media set that are near in time and alike: dealt by buckets of time, so a set of any size is many tasks."""
    p = assets(t).where("not video").select("event_id", "media_set", F.col("at").alias("start_s"), (F.col("at") + BURST).alias("end_s"), (F.col("event_id") * 40503 % 65536).alias("bits"))
    distance = F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits"))).cast("int")
    both = intervals.overlapping(p, p, ["media_set"], BURST).where((F.col("l.event_id") < F.col("r.event_id")) & (distance <= 5) & (F.abs(F.col("l.start_s") - F.col("r.start_s")) < BURST))
    return both.select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"), distance.alias("distance"))


@query(f"""WITH {_ASSETS}, e AS (SELECT event_id, user_id, floor(t0) AS a, floor(t0) + floor(seconds) AS b, event_id % 6 = 0 AS chosen, CAST(floor(least(value, 45.0) * 1000) AS BIGINT) AS ms, value FROM m),
x AS (SELECT * FROM e r WHERE NOT chosen AND NOT EXISTS (SELECT 1 FROM e s WHERE s.chosen AND s.user_id = r.user_id AND least(r.b, s.b) - greatest(r.a, s.a) > 0.5)),
h AS (SELECT user_id, CAST(sum(CASE WHEN chosen THEN ms ELSE 0 END) AS BIGINT) AS have, count(*) FILTER (WHERE chosen) AS n FROM e GROUP BY 1),
q AS (SELECT x.*, have, n, row_number() OVER w AS k, sum(ms) OVER w AS upto FROM x JOIN h USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, a, event_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT event_id, user_id, a, true AS chosen FROM e WHERE chosen UNION ALL SELECT event_id, user_id, a, false FROM q WHERE have + upto - ms < 600000 AND n + k - 1 < 18)
SELECT event_id, chosen, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS INTEGER) AS position FROM z""")
def documentary_chronology(t: Tables) -> DataFrame:
    """The chosen rows of each source, filled up by the best that overlap none of them until time or number is reached, in order of time."""
    e = assets(t).select("event_id", "user_id", F.floor("at").cast("double").alias("start_s"), (F.floor("at") + F.floor("seconds")).cast("double").alias("end_s"), (F.col("event_id") % 6 == 0).alias("chosen"), F.floor(F.least("value", F.lit(45.0)) * 1000).alias("ms"), "value")
    chosen, raw = e.where("chosen"), e.where("not chosen")
    met = intervals.overlapping(raw, chosen, ["user_id"], 3_600.0, 0.5).select(F.col("l.event_id").alias("event_id")).distinct()
    have = e.groupBy("user_id").agg(F.sum(F.when(F.col("chosen"), F.col("ms")).otherwise(0)).alias("have"), F.count_if("chosen").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "start_s", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    q = raw.join(met, "event_id", "left_anti").join(have, "user_id").withColumns({"k": F.count("*").over(w), "upto": F.sum("ms").over(w)})
    more = q.where((F.col("have") + F.col("upto") - F.col("ms") < 600_000) & (F.col("n") + F.col("k") - 1 < 18))
    both = chosen.select("event_id", "user_id", "start_s", "chosen").union(more.select("event_id", "user_id", "start_s", "chosen"))
    return both.select("event_id", "chosen", F.row_number().over(Window.partitionBy("user_id").orderBy("start_s", "event_id")).alias("position"))


_FACES, _EVENTS = ("face_visible",), ("water_speed_run", "lit_tunnel", "hero_action")


@query(f"""WITH {_ASSETS}, s AS (SELECT *, people / 100 AS person, technical / 300 AS scene, moment_type || ' ' || role AS said FROM m)
SELECT event_id, NOT list_has_any(tags, {_list(_FACES)}) AND NOT list_has_any(tags, {_list(_EVENTS)}) AND (regexp_matches(said, 'person|people|friend|group|selfie|portrait|standing') OR (person >= 0.20 AND person - scene >= 0.035)) AS rejected,
  CASE WHEN user_id % 3 = 0 OR regexp_matches(said, 'group|meal') THEN 'memory' ELSE 'action' END AS goal FROM s""")
def face_rules(t: Tables) -> DataFrame:
    """Rows about persons whose faces are not to be seen go, unless something happens in them; and what a profile values."""
    said = F.concat_ws(" ", "moment_type", "role")
    person, scene = F.col("people") / 100, F.col("technical") / 300
    about = said.rlike("person|people|friend|group|selfie|portrait|standing") | ((person >= 0.20) & (person - scene >= 0.035))
    rejected = ~rules.any_tag("tags", _FACES) & ~rules.any_tag("tags", _EVENTS) & about
    goal = F.when((F.col("user_id") % 3 == 0) | said.rlike("group|meal"), "memory").otherwise("action")
    return assets(t).select("event_id", rejected.alias("rejected"), goal.alias("goal"))


@query(f"""WITH {_ASSETS}, v AS (SELECT event_id, media_set, motion, story, tags, seconds FROM m WHERE video),
x AS (SELECT *, unnest([{{'variant': 'action', 'least': 55.0, 'length': 15.0}}, {{'variant': 'story', 'least': 0.0, 'length': 45.0}}, {{'variant': 'short', 'least': 30.0, 'length': 8.0}}], recursive := true) FROM v)
SELECT variant, media_set, count(*) AS candidates, CAST(sum(CAST(floor(least(seconds, length) * 1000) AS BIGINT)) AS BIGINT) AS ms, max(CASE WHEN variant = 'story' THEN story ELSE motion END) AS best FROM x WHERE motion >= "least" GROUP BY ALL""")
def variant_budgets(t: Tables) -> DataFrame:
    """What each variant of a reel has to choose from in every media set."""
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(a).alias("least"), F.lit(b).alias("length")) for k, a, b in (("action", 55.0, 15.0), ("story", 0.0, 45.0), ("short", 30.0, 8.0))])
    x = assets(t).where("video").select("media_set", "motion", "story", "seconds", F.inline(variants)).where(F.col("motion") >= F.col("least"))
    best = F.when(F.col("variant") == "story", F.col("story")).otherwise(F.col("motion"))
    return x.groupBy("variant", "media_set").agg(F.count("*").alias("candidates"), F.sum(F.floor(F.least("seconds", "length") * 1000)).alias("ms"), F.max(best).alias("best"))
