"""Queries of the story, video, timeline, reel and documentary stages over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds
from ..operators import intervals, selection, sessions, similarity
from .registry import Tables, query

GAP, CAP = 21_600, 40
_EPOCH = "epoch_us(ts) / 1e6"
_SESSIONS = f"""e AS (SELECT event_id, ts, user_id, event_type, value, {_EPOCH} AS t0 FROM events),
l AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {GAP} THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) - 1 AS rn FROM g),
s AS (SELECT *, CAST(sum(CASE WHEN rn % {CAP} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM r)"""


def _sessions(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return sessions.sessionize(events, ["user_id"], ["ts", "event_id"], seconds(F.col("ts")), GAP, CAP)


def _spans(t: Tables) -> DataFrame:
    """Each event as an interval that begins at its second and lasts its value."""
    at = seconds(F.col("ts"))
    return t.events.select("event_id", "user_id", "event_type", "value", F.floor(at).cast("double").alias("start_s"), (F.floor(at) + F.ceil("value") + 60).cast("double").alias("end_s"))


_SPANS = f"""sp AS (SELECT event_id, user_id, event_type, value, CAST(floor({_EPOCH}) AS DOUBLE) AS start_s, CAST(floor({_EPOCH}) + ceil(value) + 60 AS DOUBLE) AS end_s FROM events)"""


@query(f"WITH {_SESSIONS} SELECT event_id, user_id, session, CAST(rn % {CAP} + 1 AS INTEGER) AS rank_in_session FROM s")
def moments_sessionize(t: Tables) -> DataFrame:
    return _sessions(t).select("event_id", "user_id", "session", "rank_in_session")


@query(f"""WITH {_SESSIONS} SELECT user_id, session, count(*) AS assets, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, min(ts) AS first_ts, max(ts) AS last_ts, max(value) AS best,
CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM s GROUP BY user_id, session""")
def moment_aggregates(t: Tables) -> DataFrame:
    return _sessions(t).groupBy("user_id", "session").agg(
        F.count("*").alias("assets"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("value").alias("best"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )


@query(f"""WITH {_SESSIONS}, m AS (SELECT user_id, session, count(*) AS assets, (min(t0) + max(t0)) / 2 AS mid FROM s GROUP BY 1, 2)
SELECT user_id, session, assets, event_id AS hero FROM (SELECT s.user_id, s.session, assets, event_id, row_number() OVER (PARTITION BY s.user_id, s.session ORDER BY value DESC, abs(t0 - mid), event_id) AS k
FROM s JOIN m ON s.user_id = m.user_id AND s.session = m.session) WHERE k = 1""")
def hero_assets(t: Tables) -> DataFrame:
    events = _sessions(t).withColumn("t0", seconds(F.col("ts")))
    whole = Window.partitionBy("user_id", "session")
    mid = (F.min("t0").over(whole) + F.max("t0").over(whole)) / 2
    key = F.struct(F.col("value").alias("v"), (-F.abs(F.col("t0") - F.col("mid"))).alias("d"), (-F.col("event_id")).alias("e"))
    return events.withColumn("mid", mid).groupBy("user_id", "session").agg(F.count("*").alias("assets"), F.max_by("event_id", key).alias("hero"))


@query(f"""WITH {_SESSIONS}, a AS (SELECT user_id, session, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, max(value) AS best FROM s GROUP BY 1, 2)
SELECT user_id, session, CASE WHEN e * 2 > n THEN 'recovery' WHEN best >= 150 THEN 'peak' WHEN n >= 4 THEN 'gathering' WHEN n = 1 THEN 'glimpse' ELSE 'scene' END AS moment_type FROM a""")
def moment_types(t: Tables) -> DataFrame:
    a = _sessions(t).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("value").alias("best"))
    kind = F.when(F.col("e") * 2 > F.col("n"), "recovery").when(F.col("best") >= 150, "peak").when(F.col("n") >= 4, "gathering").when(F.col("n") == 1, "glimpse").otherwise("scene")
    return a.select("user_id", "session", kind.alias("moment_type"))


@query(f"""WITH {_SESSIONS}, m AS (SELECT user_id, session, count(*) AS n, min(t0) AS a, max(t0) AS b FROM s GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n < 2 AND a - lag(b) OVER (PARTITION BY user_id ORDER BY session) <= 43200 THEN 0 ELSE 1 END AS opens FROM m)
SELECT user_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY session) AS BIGINT) AS moment, session, n FROM f""")
def merge_small_sessions(t: Tables) -> DataFrame:
    """A session of one event joins the one before it, if that ended within half a day."""
    m = _sessions(t).withColumn("t0", seconds(F.col("ts"))).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t0").alias("a"), F.max("t0").alias("b"))
    w = Window.partitionBy("user_id").orderBy("session")
    opens = F.when((F.col("n") < 2) & (F.col("a") - F.lag("b").over(w) <= 43200), 0).otherwise(1)
    return m.withColumn("opens", opens).select("user_id", F.sum("opens").over(w).alias("moment"), "session", "n")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id, i * ((n + 24) // 25) // n + 1 AS moment FROM r""")
def split_to_target(t: Tables) -> DataFrame:
    """Each user's events cut into as few runs of at most 25 as there can be, of nearly equal size."""
    w = Window.partitionBy("user_id")
    r = t.events.select("event_id", "user_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return r.select("event_id", "user_id", (F.floor(F.col("i") * F.ceil(F.col("n") / 25) / F.col("n")) + 1).alias("moment"))


@query("""SELECT conv_id, count(*) AS n_assets, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def moment_json(t: Tables) -> DataFrame:
    """The nested document of each conversation, written as JSON and read back."""
    nested = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("assets")).select("conv_id", F.to_json(F.struct("assets")).alias("doc"))
    back = nested.select("conv_id", F.from_json("doc", "assets array<struct<turn: long, role: string>>").alias("d"))
    return back.select("conv_id", F.size("d.assets").cast("long").alias("n_assets"), F.array_min("d.assets.turn").alias("first_turn"), F.array_max("d.assets.turn").alias("last_turn"), F.array_join("d.assets.role", ">").alias("roles"))


@query("""WITH d AS (SELECT event_id, user_id, ts, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS motion FROM events),
a AS (SELECT *, avg(motion) OVER (PARTITION BY user_id) AS mean FROM d)
SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_boundary FROM a WHERE motion >= greatest(1.9 * mean, 14)""")
def scene_boundaries(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = t.events.withColumn("motion", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("mean", F.avg("motion").over(Window.partitionBy("user_id")))
    return d.where(F.col("motion") >= F.greatest(1.9 * F.col("mean"), F.lit(14))).select("event_id", "user_id", F.lead("event_id").over(w).alias("next_boundary"))


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_EPOCH} AS x FROM events), n AS (SELECT a.event_id, arg_min(b.event_id, {{'x': b.x, 'e': b.event_id}}) AS follower FROM e a JOIN e b ON a.user_id = b.user_id AND b.x - a.x >= 86400.0 GROUP BY 1),
k AS (SELECT arg_min(event_id, {{'x': x, 'e': event_id}}) AS event_id, user_id FROM e GROUP BY user_id UNION ALL SELECT follower, user_id FROM k JOIN n ON n.event_id = k.event_id) SELECT event_id, user_id FROM k""")
def debounced_boundaries(t: Tables) -> DataFrame:
    """Events of each user that come at least a day after the last one kept."""

    def fold(group: list[dict]) -> list[dict]:
        return selection.spaced(sorted(group, key=lambda r: (r["at"], r["event_id"])), "at", 86_400.0)

    return selection.by_group(t.events.select("event_id", "user_id", seconds(F.col("ts")).alias("at")), ["user_id"], fold, "event_id long, user_id long, at double").select("event_id", "user_id")


@query(f"""WITH p AS (SELECT user_id, floor({_EPOCH}) AS x, lag(floor({_EPOCH})) OVER (PARTITION BY user_id ORDER BY floor({_EPOCH})) AS b FROM events)
SELECT user_id, count(*) AS points, CAST(sum(greatest(coalesce(CAST(ceil((x - b) / 86400) AS BIGINT), 1), 1) - 1) AS BIGINT) AS inserted FROM p GROUP BY user_id""")
def densify_boundaries(t: Tables) -> DataFrame:
    points = t.events.select("user_id", F.floor(seconds(F.col("ts"))).cast("double").alias("at"))
    dense = intervals.densified(points, ["user_id"], "at", 86_400.0)
    return dense.groupBy("user_id").agg(F.count_if(~F.col("inserted")).alias("points"), F.count_if("inserted").alias("inserted"))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice AS d, greatest(CAST(ceil(o_totalprice / 45000) AS INTEGER), 1) AS k FROM orders)
SELECT o_orderkey, k AS n_parts, i AS part, CAST(floor((i - 1) * (d / k) + 0.5) AS BIGINT) AS part_start, CAST(floor(i * (d / k) + 0.5) AS BIGINT) AS part_end FROM (SELECT *, unnest(range(1, k + 1))::INTEGER AS i FROM n)""")
def clip_segmentation(t: Tables) -> DataFrame:
    clips = t.orders.select("o_orderkey", F.lit(0.0).alias("start_s"), F.col("o_totalprice").alias("end_s"))
    cut = intervals.subdivided(clips, F.lit(45_000.0))
    return cut.select("o_orderkey", "n_parts", "part", F.floor(F.col("part_start") + 0.5).alias("part_start"), F.floor(F.col("part_end") + 0.5).alias("part_end"))


@query(f"""WITH {_SPANS}, n AS (SELECT *, greatest(end_s - 60, start_s) AS last FROM sp),
w AS (SELECT event_id, end_s, unnest(list_slice(list_transform(range(0, CAST(floor((last - start_s) / 33) AS BIGINT) + 1), lambda i: start_s + i * 33) || CASE WHEN (last - start_s) % 33 = 0 THEN [] ELSE [last] END, 1, 8)) AS window_start FROM n)
SELECT event_id, window_start, least(window_start + 60, end_s) AS window_end FROM w""")
def sliding_windows(t: Tables) -> DataFrame:
    return intervals.sliding(_spans(t), 60.0, 33.0, 8).select("event_id", "window_start", "window_end")


@query(f"""SELECT user_id, CAST(floor({_EPOCH} / 86400) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CASE WHEN max(value) >= 200 THEN 'loud' WHEN max(value) < 5 THEN 'silence' ELSE 'normal' END AS kind FROM events GROUP BY 1, 2""")
def tumbling_audio(t: Tables) -> DataFrame:
    kind = F.when(F.max("value") >= 200, "loud").when(F.max("value") < 5, "silence").otherwise("normal")
    return t.events.groupBy("user_id", F.floor(seconds(F.col("ts")) / 86_400).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), kind.alias("kind"))


BUCKET = 3_600.0  # seconds; an event here lasts some minutes
_OVERLAP = "l.user_id = r.user_id AND l.start_s < r.end_s AND l.end_s > r.start_s"


@query(f"""WITH {_SPANS} SELECT l.event_id, arg_min(r.event_id, {{'s': r.start_s, 'e': r.event_id}}) AS first_overlap, count(*) AS n FROM sp l JOIN sp r ON {_OVERLAP} AND l.event_id <> r.event_id GROUP BY 1""")
def overlap_first(t: Tables) -> DataFrame:
    both = intervals.overlapping(_spans(t), _spans(t), ["user_id"], BUCKET).where("l.event_id <> r.event_id")
    return both.groupBy(F.col("l.event_id").alias("event_id")).agg(F.min_by("r.event_id", F.struct("r.start_s", "r.event_id")).alias("first_overlap"), F.count("*").alias("n"))


@query(f"""WITH {_SPANS} SELECT l.event_id, coalesce(sum(CAST(round(r.value * 100) AS BIGINT)) // count(r.value), 5000)::BIGINT AS energy FROM (SELECT * FROM sp WHERE event_type = 'view') l
LEFT JOIN (SELECT * FROM sp WHERE event_type <> 'view') r ON {_OVERLAP} GROUP BY 1""")
def overlap_avg(t: Tables) -> DataFrame:
    """Mean of the overlapping values in whole hundredths, and 50 where there is none."""
    views = _spans(t).where("event_type = 'view'")
    both = intervals.overlapping(views, _spans(t).where("event_type <> 'view'"), ["user_id"], BUCKET)
    total, n = F.sum(F.round(F.col("r.value") * 100).cast("long")), F.count("r.value")
    means = both.groupBy(F.col("l.event_id").alias("event_id")).agg(F.floor(total / F.when(n > 0, n)).cast("long").alias("mean"))
    return views.select("event_id").join(means, "event_id", "left").select("event_id", F.coalesce("mean", F.lit(5000)).cast("long").alias("energy"))


@query(f"""WITH {_SPANS} SELECT l.event_id, arg_max(r.event_id, {{'v': r.value, 'e': -r.event_id}}) AS best FROM sp l JOIN sp r ON {_OVERLAP} AND l.event_type = r.event_type GROUP BY 1""")
def overlap_argmax(t: Tables) -> DataFrame:
    both = intervals.overlapping(_spans(t), _spans(t), ["user_id", "event_type"], BUCKET)
    return both.groupBy(F.col("l.event_id").alias("event_id")).agg(F.max_by("r.event_id", F.struct(F.col("r.value").alias("v"), (-F.col("r.event_id")).alias("e"))).alias("best"))


@query(f"""WITH {_SPANS} SELECT l.event_id, l.user_id FROM sp l WHERE l.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM sp r WHERE r.event_type = 'purchase' AND l.user_id = r.user_id AND least(l.end_s, r.end_s) - greatest(l.start_s, r.start_s) > 0.5)""")
def anti_overlap(t: Tables) -> DataFrame:
    left, right = _spans(t).where("event_type = 'view'"), _spans(t).where("event_type = 'purchase'")
    met = intervals.overlapping(left, right, ["user_id"], BUCKET, 0.5).select(F.col("l.event_id").alias("event_id")).distinct()
    return left.join(met, "event_id", "left_anti").select("event_id", "user_id")


@query(f"""WITH {_SPANS}, p AS (SELECT user_id, {_EPOCH} AS x, value FROM events), w AS (SELECT event_id, user_id, start_s, end_s + 3600 AS end_s FROM sp WHERE event_type = 'purchase')
SELECT w.event_id, count(*) AS samples, max(value) AS peak FROM p JOIN w ON p.user_id = w.user_id AND x BETWEEN start_s AND end_s GROUP BY 1""")
def containment_agg(t: Tables) -> DataFrame:
    points = t.events.select("user_id", seconds(F.col("ts")).alias("at"), "value")
    spans = _spans(t).where("event_type = 'purchase'").withColumn("end_s", F.col("end_s") + 3600).select("event_id", "user_id", "start_s", "end_s")
    return intervals.contained(points, spans, ["user_id"], "at", BUCKET).groupBy("s.event_id").agg(F.count("*").alias("samples"), F.max("p.value").alias("peak"))


@query(f"""WITH p AS (SELECT user_id, event_id, {_EPOCH} AS at FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, {_EPOCH} AS at FROM events WHERE event_type = 'view')
SELECT p.event_id, arg_min(v.event_id, {{'d': abs(p.at - v.at), 't': v.at}}) AS nearest FROM p JOIN v ON p.user_id = v.user_id GROUP BY 1""")
def nearest_sample(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", seconds(F.col("ts")).alias("at"))
    views = rows.where("event_type = 'view'").select("user_id", F.col("at").alias("v_at"), F.col("event_id").alias("view_id"))
    found = similarity.nearest(rows.where("event_type = 'purchase'").select("user_id", "event_id", "at"), views, ["user_id"], "at", "v_at", "view_id")
    return found.where("nearest is not null").select("event_id", "nearest")


@query("""WITH i AS (SELECT l_partkey AS k, epoch(l_shipdate)::DOUBLE AS a, epoch(l_shipdate)::DOUBLE + l_quantity * 86400 AS b FROM lineitem),
o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 86400 THEN 1 WHEN row_number() OVER (PARTITION BY k ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS opens FROM i),
g AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT k AS l_partkey, min(a) AS start_s, max(b) AS end_s, count(*) AS n_merged FROM g GROUP BY k, grp""")
def interval_union(t: Tables) -> DataFrame:
    at = seconds(F.col("l_shipdate"))
    rows = t.lineitem.select("l_partkey", at.alias("start_s"), (at + F.col("l_quantity") * 86_400).alias("end_s"))
    return intervals.islands(rows, ["l_partkey"], 86_400.0)


@query(f"""WITH {_SPANS}, m AS (SELECT l.event_id AS event_id, (greatest(l.start_s, r.start_s) - l.start_s) / 2 AS a, (least(l.end_s, r.end_s) - l.start_s) / 2 AS b FROM (SELECT * FROM sp WHERE event_type = 'view') l JOIN (SELECT * FROM sp WHERE event_type = 'error') r ON {_OVERLAP}),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY event_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.05 THEN 0 ELSE 1 END AS opens FROM m WHERE b - a >= 0.05),
g AS (SELECT *, sum(opens) OVER (PARTITION BY event_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o) SELECT event_id, min(a) AS start_s, max(b) AS end_s FROM g GROUP BY event_id, grp""")
def mute_window_remap(t: Tables) -> DataFrame:
    """Where errors overlap a view, in the view's own time at double speed, merged."""
    both = intervals.overlapping(_spans(t).where("event_type = 'view'"), _spans(t).where("event_type = 'error'"), ["user_id"], BUCKET)
    start, end = (F.greatest("l.start_s", "r.start_s") - F.col("l.start_s")) / 2, (F.least("l.end_s", "r.end_s") - F.col("l.start_s")) / 2
    cut = both.select(F.col("l.event_id").alias("event_id"), start.alias("start_s"), end.alias("end_s")).where("end_s - start_s >= 0.05")
    return intervals.islands(cut, ["event_id"], 0.05).drop("n_merged")


@query("""SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS sequence, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def output_cursor(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.sum(F.round(F.col("value") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.events.select("event_id", "user_id", F.row_number().over(w).alias("sequence"), F.coalesce(before, F.lit(0)).cast("long").alias("cursor"))


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, i AS idx FROM r WHERE n <= 5 OR i IN (0, round_even((n - 1) / 4.0, 0), round_even((n - 1) * 2 / 4.0, 0), round_even((n - 1) * 3 / 4.0, 0), n - 1)""")
def even_sample(t: Tables) -> DataFrame:
    """Five rows of each user, evenly spaced by index (rounded half to even)."""
    w = Window.partitionBy("user_id")
    r = t.events.select("event_id", "user_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), F.count("*").over(w).alias("n"))
    at = F.array(*[F.bround((F.col("n") - 1) * k / F.lit(4.0), 0).cast("long") for k in range(5)])
    return r.where((F.col("n") <= 5) | F.array_contains(at, F.col("idx"))).select("event_id", "user_id", "idx")


@query("""WITH r AS (SELECT event_id, user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 4 // count(*) OVER (PARTITION BY user_id) AS band FROM events)
SELECT user_id, CAST(band AS BIGINT) AS band, arg_max(event_id, {'v': value, 'e': -event_id}) AS best FROM r GROUP BY 1, 2""")
def band_best(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    band = F.floor((F.row_number().over(w.orderBy("ts", "event_id")) - 1) * 4 / F.count("*").over(w))
    rows = t.events.select("event_id", "user_id", "value", band.alias("band"))
    return rows.groupBy("user_id", "band").agg(F.max_by("event_id", F.struct(F.col("value").alias("v"), (-F.col("event_id")).alias("e"))).alias("best"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)
SELECT o_orderpriority, CAST(i // 4 + 1 AS BIGINT) AS page, count(*) AS photos, min(o_orderkey) AS first_key FROM r GROUP BY 1, 2""")
def album_pages(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = t.orders.select("o_orderkey", "o_orderpriority", (F.floor(i / 4) + 1).alias("page"))
    return rows.groupBy("o_orderpriority", "page").agg(F.count("*").alias("photos"), F.min("o_orderkey").alias("first_key"))


_BASE_SPEED = "CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 1 END"


@query(f"""WITH b AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c, {_BASE_SPEED} AS speed FROM events),
s AS (SELECT *, sum(c // speed) OVER (PARTITION BY user_id) AS total, sum(CASE WHEN event_type_anchor THEN c ELSE 0 END) OVER (PARTITION BY user_id) AS anchored FROM (SELECT *, speed = 1 AS event_type_anchor FROM b))
SELECT event_id, speed * CASE WHEN speed = 1 OR total <= 60000 THEN 1.0 ELSE greatest(1.0, CAST(total - anchored AS DOUBLE) / greatest(60000 - anchored, 21000)) END AS speed FROM s""")
def speed_compress(t: Tables) -> DataFrame:
    """Fast rows are sped up further until a user's total meets ten minutes, anchors stay as they are."""
    base = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "view", 2).otherwise(1)
    rows = t.events.select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("c"), base.alias("base"))
    w = Window.partitionBy("user_id")
    rows = rows.withColumns({"total": F.sum(F.floor(F.col("c") / F.col("base"))).over(w), "anchored": F.sum(F.when(F.col("base") == 1, F.col("c")).otherwise(0)).over(w)})
    more = F.greatest(F.lit(1.0), (F.col("total") - F.col("anchored")).cast("double") / F.greatest(60_000 - F.col("anchored"), F.lit(21_000)))
    return rows.select("event_id", (F.col("base") * F.when((F.col("base") == 1) | (F.col("total") <= 60_000), 1.0).otherwise(more)).alias("speed"))


@query("""WITH o AS (SELECT event_id, user_id, ts, value, event_type IN ('view', 'click') AS able, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (WHERE event_type = 'purchase' AND value > 150) OVER (PARTITION BY user_id) AS fast FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, able ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, able) AS m FROM o),
p AS (SELECT *, CASE WHEN m = 1 THEN i WHEN i % 3 = 1 THEN (i - 1) // 3 END AS turn FROM e WHERE able AND fast = 0)
SELECT event_id, user_id, CASE WHEN value >= 72 THEN 3.0 ELSE 1.5 END::DOUBLE AS speed FROM p WHERE turn < greatest(1, least(m // 3 + 1, greatest(1, n // 4)))""")
def speed_mix(t: Tables) -> DataFrame:
    """Where nothing is fast yet, the second of every three able rows is, up to a target; 3 times for loud ones, else 1.5 times."""
    by_user = Window.partitionBy("user_id")
    able = F.col("event_type").isin("view", "click")
    rows = t.events.select("event_id", "user_id", "ts", "value", able.alias("able"), ((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("quick"))
    rows = rows.withColumns({"n": F.count("*").over(by_user), "fast": F.count_if("quick").over(by_user)})
    of_kind = Window.partitionBy("user_id", "able")
    rows = rows.withColumns({"i": F.row_number().over(of_kind.orderBy("ts", "event_id")) - 1, "m": F.count("*").over(of_kind)}).where("able and fast = 0")
    turn = F.when(F.col("m") == 1, F.col("i")).when(F.col("i") % 3 == 1, F.floor((F.col("i") - 1) / 3))
    target = F.greatest(F.lit(1), F.least(F.floor(F.col("m") / 3) + 1, F.greatest(F.lit(1), F.floor(F.col("n") / 4))))
    return rows.where(turn < target).select("event_id", "user_id", F.when(F.col("value") >= 72, 3.0).otherwise(1.5).alias("speed"))


@query(f"""SELECT user_id, list_sort(list({_EPOCH}))[count(*) // 2 + 1] AS upper_median, min({_EPOCH}) AS first_at FROM events GROUP BY 1""")
def activity_order_median(t: Tables) -> DataFrame:
    ranked = t.events.select("user_id", seconds(F.col("ts")).alias("at"))
    w = Window.partitionBy("user_id")
    ranked = ranked.withColumns({"k": F.row_number().over(w.orderBy("at")), "n": F.count("*").over(w)})
    return ranked.groupBy("user_id").agg(F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("at"))).alias("upper_median"), F.min("at").alias("first_at"))


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_type) AS chapters, CAST(sum(n) AS BIGINT) AS events FROM f GROUP BY 1""")
def chapters_rollup(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"])
    return f.groupBy("user_id").agg(F.array_join(ordered, ",").alias("chapters"), F.sum("n").alias("events"))


@query("""WITH r AS (SELECT event_id, user_id, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2 AS forced FROM events)
SELECT event_id, user_id, forced, CAST(row_number() OVER (PARTITION BY user_id ORDER BY forced DESC, ts, event_id) AS INTEGER) AS position FROM r""")
def forced_coverage(t: Tables) -> DataFrame:
    forced = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")) <= 2
    rows = t.events.withColumn("forced", forced)
    return rows.select("event_id", "user_id", "forced", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("forced"), "ts", "event_id")).alias("position"))


@query("""WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id, event_type) AS best FROM events) SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type, ts, event_id) AS INTEGER) AS position FROM m""")
def continuity_order(t: Tables) -> DataFrame:
    rows = t.events.withColumn("best", F.max("value").over(Window.partitionBy("user_id", "event_type")))
    return rows.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("best"), "event_type", "ts", "event_id")).alias("position"))


def _candidates(t: Tables) -> DataFrame:
    spans = _spans(t).withColumn("duration", F.col("end_s") - F.col("start_s"))
    best = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")) == 1
    return spans.withColumns({"hook": F.col("event_type") == "purchase", "required": best})


@query(f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM sp),
f AS (SELECT event_id, user_id, i, true AS kept, 1 AS n, [start_s] AS a, [end_s] AS b FROM o WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, ok, n + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN list_append(a, start_s) ELSE a END, CASE WHEN ok THEN list_append(b, end_s) ELSE b END
  FROM (SELECT o.*, n, a, b, n < 3 AND len(list_filter(range(1, len(a) + 1), lambda k: start_s < b[k] + 300.0 AND a[k] < end_s + 300.0)) = 0 AS ok FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) z)
SELECT event_id, user_id, n::BIGINT AS pick, 0::BIGINT AS why FROM f WHERE kept""")
def top_windows_nms(t: Tables) -> DataFrame:
    """The three best windows of each user that do not overlap within five minutes."""
    limits = selection.Limits(most=3, source="user_id", apart=300.0)
    return selection.select_by(_candidates(t), ["user_id"], (selection.Pass(("-value",)),), limits, "event_id").select("event_id", "user_id", "pick", "why")


@query(f"""WITH RECURSIVE {_SPANS}, o AS (SELECT event_id, user_id, event_type AS y, value, end_s - start_s AS d, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS i, sum(end_s - start_s) OVER (PARTITION BY user_id) AS total FROM sp),
f AS (SELECT event_id, user_id, i, y AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, 0.0::DOUBLE AS dropped, true AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, CASE WHEN gone THEN a ELSE y END, CASE WHEN gone THEN b ELSE a END, CASE WHEN gone THEN c ELSE b END, dropped + CASE WHEN gone THEN d ELSE 0.0 END, NOT gone
  FROM (SELECT o.*, a, b, c, dropped, coalesce(y = a, false) OR coalesce(y = b, false) OR coalesce(y = c, false) AS again, (coalesce(y = a, false) OR coalesce(y = b, false) OR coalesce(y = c, false)) AND value < 92.0 AND total - dropped - d >= 0.45 * total AS gone FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) o)
SELECT event_id, user_id FROM f WHERE kept""")
def repetition_filter(t: Tables) -> DataFrame:
    """Events of a type seen among the last three kept go, unless they score high or too little would stay."""
    rows = _spans(t).select("event_id", "user_id", "event_type", "value", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration"))

    def fold(group: list[dict]) -> list[dict]:
        kept = selection.thin(sorted(group, key=lambda r: (r["start_s"], r["event_id"])), "event_type", "value", 92.0, 0.45, 3)
        return [{"event_id": r["event_id"], "user_id": r["user_id"]} for r in kept]

    return selection.by_group(rows, ["user_id"], fold, "event_id long, user_id long")


@query(f"""WITH RECURSIVE {_SPANS}, o AS (SELECT event_id, user_id, value, (event_id % 5)::INTEGER AS stage, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM sp),
f AS (SELECT event_id, user_id, i, true AS kept, 1 AS size, CASE WHEN stage <= 1 THEN 1 ELSE 0 END AS setup, stage >= 3 AS started FROM o WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, NOT gone, size + CASE WHEN gone THEN 0 ELSE 1 END, setups, started OR (NOT gone AND stage >= 3)
  FROM (SELECT q.*, n - size > greatest(10, floor(n * 0.48)) AND stage <= 1 AND CASE WHEN started THEN value < 90 ELSE setups > 4 AND value < 150 END AS gone
    FROM (SELECT o.*, f.size, f.started, f.setup + CASE WHEN o.stage <= 1 AND NOT f.started THEN 1 ELSE 0 END AS setups FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) q) z)
SELECT event_id, user_id FROM f WHERE kept""")
def story_regressions(t: Tables) -> DataFrame:
    """A story does not go back: early stages go once a late one has come, unless they score high or too little would stay."""
    rows = _spans(t).select("event_id", "user_id", "start_s", (F.col("event_id") % 5).alias("stage"), (F.col("value") >= 150).alias("strong"), (F.col("value") >= 90).alias("closing"))

    def fold(group: list[dict]) -> list[dict]:
        kept = selection.without_regressions(sorted(group, key=lambda r: (r["start_s"], r["event_id"])), "stage", "strong", "closing")
        return [{"event_id": r["event_id"], "user_id": r["user_id"]} for r in kept]

    return selection.by_group(rows, ["user_id"], fold, "event_id long, user_id long")


@query()
def documentary_timeline(t: Tables) -> DataFrame:
    """Chapters by type in order, each within its budget, forced rows first, no row twice."""
    order = ("signup", "view", "click", "purchase", "error")
    rows = _candidates(t)
    for name in order:
        rows = rows.withColumn(f"is_{name}", F.col("event_type") == name).withColumn(f"must_{name}", F.col("required") & (F.col("event_type") == name))
    passes = tuple(p for i, name in enumerate(order) for p in (selection.Pass(("-value",), where=f"must_{name}", relaxed=True), selection.Pass(("start_s",), where=f"is_{name}", take=18, until_seconds=420.0 * (i + 1))))
    return selection.select_by(rows, ["user_id"], passes, selection.Limits(most=90), "event_id").select("event_id", "user_id", "pick", "why")


@query("""WITH a AS (SELECT o_orderpriority AS chapter, count(*)::DOUBLE AS available FROM orders GROUP BY 1) SELECT chapter, available, least(available, 3000.0)::DOUBLE AS capped FROM a""")
def chapter_targets(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_orderpriority").alias("chapter")).agg(F.count("*").cast("double").alias("available"))
    return a.withColumn("capped", F.least(F.col("available"), F.lit(3000.0)))


@query()
def chapter_water_fill(t: Tables) -> DataFrame:
    """Equal targets capped at what a chapter has, the rest dealt out by weight: five chapters in one task."""
    a = t.orders.groupBy(F.col("o_orderpriority").alias("chapter")).agg(F.count("*").cast("double").alias("available"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chapter")
        available = dict(zip(rows["chapter"], rows["available"], strict=True))
        weights = {c: 1.0 + i for i, c in enumerate(available)}
        filled = selection.water_fill({c: 1.2 * i * rows["available"].mean() / len(available) for i, c in enumerate(available, 1)}, available, weights)
        return pd.DataFrame({"chapter": list(filled), "target": [round(v, 3) for v in filled.values()]})

    return a.groupBy().applyInPandas(run, "chapter string, target double")
