"""Queries of the scoring formulas, duplicate groups, lookups and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.scalars import letter_hash
from ..operators import graph, similarity
from ..sources import scratch
from .registry import LETTER_HASH, Tables, query

_SIGNALS = """x AS (SELECT event_id, user_id, event_type, ts, least(value, 100.0) AS motion, least(value * 2, 100.0) AS audio, 100.0::DOUBLE - least(value, 100.0) AS story, (event_id % 101)::DOUBLE AS technical,
  (event_id % 7 * 14)::DOUBLE AS people, CASE event_type WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'reaction' ELSE 'scenic' END AS role, (event_id % 3)::DOUBLE AS more, (event_id % 5)::DOUBLE AS less FROM events)"""


def _signals(t: Tables) -> DataFrame:
    e, value = F.col("event_id"), F.col("value")
    return t.events.select(
        "event_id", "user_id", "event_type", "ts",
        F.least(value, F.lit(100.0)).alias("motion"), F.least(value * 2, F.lit(100.0)).alias("audio"), (100.0 - F.least(value, F.lit(100.0))).alias("story"), (e % 101).cast("double").alias("technical"),
        (e % 7 * 14).cast("double").alias("people"), F.when(F.col("event_type") == "purchase", "action").when(F.col("event_type") == "signup", "reaction").otherwise("scenic").alias("role"),
        (e % 3).cast("double").alias("more"), (e % 5).cast("double").alias("less"),
    )


def _fit() -> Column:
    c = F.col
    return scores.activity_fit(F.lit(45.0), c("motion"), c("audio"), c("story"), c("technical"), c("people"), c("role"), F.lit(50.0), c("more"), c("less"), c("role") == "action")


_FIT = """least(greatest(9.9::DOUBLE + 0.20::DOUBLE * motion + 0.16::DOUBLE * audio + 0.14::DOUBLE * story + 0.10::DOUBLE * technical + 0.08::DOUBLE * people
  + 0.05::DOUBLE * CASE role WHEN 'action' THEN 100.0 WHEN 'reaction' THEN 78.0 ELSE 55.0 END::DOUBLE + 2.5::DOUBLE + least(6 * more, 24) - least(8 * less, 28) + CASE WHEN role = 'action' THEN 10 ELSE 0 END, 0), 100)"""


@query(f"WITH {_SIGNALS} SELECT event_id, CAST(floor({_FIT} * 100 + 0.5) AS BIGINT) AS fit FROM x")
def activity_fit(t: Tables) -> DataFrame:
    return _signals(t).select("event_id", F.floor(_fit() * 100 + 0.5).alias("fit"))


@query(f"""WITH {_SIGNALS}, f AS (SELECT *, {_FIT} AS fit FROM x)
SELECT event_id, CAST(floor(least(greatest(0.48::DOUBLE * fit + 0.18::DOUBLE * motion + 0.12::DOUBLE * audio + 0.12::DOUBLE * technical + 0.10::DOUBLE * technical, 0), 100) * 100 + 0.5) AS BIGINT) AS reel,
  CAST(floor(least(greatest(0.45::DOUBLE * greatest(technical, fit) + 0.25::DOUBLE * story + 0.20::DOUBLE * audio + 0.10::DOUBLE * people, 0), 100) * 100 + 0.5) AS BIGINT) AS capsule FROM f""")
def purpose_scores(t: Tables) -> DataFrame:
    c = F.col
    rows = _signals(t).withColumn("fit", _fit())
    got = scores.video_purposes(c("fit"), c("motion"), c("audio"), c("technical"), c("technical"), c("technical"), c("story"), c("audio"), c("motion"), c("technical"), c("people"))
    return rows.select("event_id", *[F.floor(got[k] * 100 + 0.5).alias(k) for k in ("reel", "capsule")])


@query("""WITH n AS (SELECT o_custkey, count(*) AS photos, bool_or(o_orderpriority = '1-URGENT') AS hero FROM orders GROUP BY 1)
SELECT o_custkey, photos, least(greatest(70.0 + CASE WHEN hero THEN 5.0 ELSE 0.0 END + CASE WHEN photos <= 2 THEN 10.0 WHEN photos > 6 THEN -least(3.0 * (photos - 6), 18.0) ELSE 0.0 END, 35.0), 100.0)::DOUBLE AS diversity,
  CASE WHEN photos = 1 THEN 72.0 WHEN photos = 2 THEN 84.0 ELSE least(100.0, 88.0 + 3 * photos) END::DOUBLE AS people FROM n""")
def album_scores(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("photos"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("hero"))
    return n.select("o_custkey", "photos", scores.album_diversity(F.col("photos"), F.col("hero")).alias("diversity"), scores.people_of_faces(F.col("photos")).alias("people"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN (p_size % 10) / 5.0 < 0.8 THEN 'vertical' WHEN (p_size % 10) / 5.0 > 1.4 THEN 'wide' ELSE 'square_friendly' END AS orientation FROM part""")
def orientation_tags(t: Tables) -> DataFrame:
    width = F.when(F.col("p_size") % 10 > 0, F.col("p_size") % 10)
    return t.part.select("p_partkey", scores.orientation(width, F.lit(5.0)).alias("orientation"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN 0.5 ELSE 1.0 END::DOUBLE * least(greatest(l_quantity / 20 * 100, 0), 100) AS duration FROM lineitem""")
def duration_scores(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", scores.duration_score(F.col("l_quantity"), 5.0).alias("duration"))


_DUP = f"""{LETTER_HASH}, g AS (SELECT bits, min(doc_id) AS doc FROM h GROUP BY 1), p AS (SELECT a.doc AS a, b.doc AS b, bit_count(xor(a.bits, b.bits)) AS d FROM g a JOIN g b ON a.bits <> b.bits AND bit_count(xor(a.bits, b.bits)) <= 1)"""


@query(f"""WITH RECURSIVE {_DUP}, r AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT node AS doc_id, root AS keeper, CAST(best AS INTEGER) AS best_distance FROM c JOIN (SELECT c.root AS k, min(d) AS best FROM p JOIN c ON p.a = c.node GROUP BY 1) ON root = k""")
def near_duplicate_groups(t: Tables) -> DataFrame:
    """Components of the hashes within one bit (each by its least document), their keeper, and the distance of their closest pair as the reason."""
    hashes = t.documents.select("doc_id", letter_hash(F.coalesce("text", F.lit(" "))).alias("bits")).groupBy("bits").agg(F.min("doc_id").alias("doc"))
    pairs = scratch.written(similarity.hamming_pairs(hashes, "doc", "bits", 1), "pairs")
    roots = graph.connected_components(pairs.select("a", "b"))
    best = pairs.join(roots, pairs["a"] == roots["node"]).groupBy("root").agg(F.min("distance").alias("best_distance"))
    return roots.join(best, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("keeper"), "best_distance")


@query("""SELECT l_partkey, arg_max(l_suppkey, {'d': l_shipdate, 'o': l_orderkey, 'l': l_linenumber, 's': l_suppkey}) AS last_supplier, arg_min(l_suppkey, {'d': l_shipdate, 'o': l_orderkey, 'l': l_linenumber, 's': l_suppkey}) AS first_supplier FROM lineitem GROUP BY 1""")
def last_row_wins(t: Tables) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return t.lineitem.groupBy("l_partkey").agg(F.max_by("l_suppkey", order).alias("last_supplier"), F.min_by("l_suppkey", order).alias("first_supplier"))


CHAPTERS = {"arrival": ("thonre", "eaux", "mit"), "action": ("ingen", "ción", "lich"), "rest": ("anea", "elle", "keit")}
_HITS = {k: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in v) for k, v in CHAPTERS.items()}


@query(f"""WITH h AS (SELECT doc_id, lang, {", ".join(f"{v} AS {k}" for k, v in _HITS.items())} FROM documents)
SELECT doc_id, CASE WHEN greatest(arrival, action, rest) = 0 THEN lang WHEN arrival >= greatest(action, rest) THEN 'arrival' WHEN action >= rest THEN 'action' ELSE 'rest' END AS chapter FROM h""")
def essence_chapter(t: Tables) -> DataFrame:
    """The chapter of most term hits, the first one on ties, else a fallback."""
    low = F.lower("text")
    hits = F.array(*[F.struct(sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("chapter")) for i, (k, words) in enumerate(CHAPTERS.items())])
    best = F.array_max(hits)
    return t.documents.select("doc_id", "lang", best.alias("b")).select("doc_id", F.when(F.col("b.n") == 0, F.col("lang")).otherwise(F.col("b.chapter")).alias("chapter"))


@query("""WITH o AS (SELECT event_id, event_type AS chapter, ts::DATE AS moment, lag(event_type) OVER w AS before, lag(ts::DATE) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN before IS NULL THEN 'opening' WHEN before <> chapter THEN 'chapter_bridge' WHEN last = moment THEN 'continuous_sequence' ELSE 'hard_cut' END AS transition FROM o""")
def transition_types(t: Tables) -> DataFrame:
    """How a row follows the one before it: type is its chapter, day its moment."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("event_id", F.col("event_type").alias("chapter"), F.to_date("ts").alias("moment"), F.lag("event_type").over(w).alias("before"), F.lag(F.to_date("ts")).over(w).alias("last"))
    kind = F.when(F.col("before").isNull(), "opening").when(F.col("before") != F.col("chapter"), "chapter_bridge").when(F.col("last") == F.col("moment"), "continuous_sequence").otherwise("hard_cut")
    return rows.select("event_id", kind.alias("transition"))


@query("""WITH b AS (SELECT event_id, user_id, ts, least(greatest(value, 1.5), 45.0) AS seconds, CASE WHEN value > 100 THEN 2.0 ELSE 1.0 END AS speed FROM events), d AS (SELECT *, CAST(floor(seconds / speed * 1000 + 0.5) AS BIGINT) AS ms FROM b)
SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS edit_sequence, CAST(sum(ms) OVER w - ms AS BIGINT) AS timeline_start_ms, CAST(sum(ms) OVER w AS BIGINT) AS timeline_end_ms, speed::DOUBLE AS speed FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def edit_decisions(t: Tables) -> DataFrame:
    """The cut list: a source span, its speed and where it lands on the output's clock."""
    b = t.events.select("event_id", "user_id", "ts", F.least(F.greatest("value", F.lit(1.5)), F.lit(45.0)).alias("seconds"), F.when(F.col("value") > 100, 2.0).otherwise(1.0).alias("speed"))
    d = b.withColumn("ms", F.floor(F.col("seconds") / F.col("speed") * 1000 + 0.5))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    end = F.sum("ms").over(w)
    return d.select("event_id", F.row_number().over(w).alias("edit_sequence"), (end - F.col("ms")).alias("timeline_start_ms"), end.alias("timeline_end_ms"), "speed")


@query("""SELECT conv_id, turn, turn * 10.0::DOUBLE - 0.25::DOUBLE AS start_s, turn * 10.0::DOUBLE + 10.25::DOUBLE AS end_s FROM conversations WHERE contains(lower(text), 'thanea') OR contains(lower(text), 'ingen')""")
def transcript_mute_windows(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.conversations.where(F.contains(low, F.lit("thanea")) | F.contains(low, F.lit("ingen"))).select("conv_id", "turn", (F.col("turn") * 10.0 - 0.25).alias("start_s"), (F.col("turn") * 10.0 + 10.25).alias("end_s"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS top_ids, max(value) AS best FROM r WHERE k <= 6 GROUP BY 1""")
def first_child_ids(t: Tables) -> DataFrame:
    ranked = t.events.select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("k")).where("k <= 6")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string"))
    return ranked.groupBy("user_id").agg(F.array_join(ids, ",").alias("top_ids"), F.max("value").alias("best"))


@query("""SELECT l.doc_id, d.source, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'keep' ELSE 'review' END AS status FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.n_chars > 500""")
def lookup_with_fallback(t: Tables) -> DataFrame:
    docs = t.documents.where("n_chars > 500").select("doc_id", "source", F.lit(True).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("quality") == 1, "keep").otherwise("review")
    return t.labels.select("doc_id", "quality").join(docs, "doc_id", "left").select("doc_id", "source", status.alias("status"))


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS v FROM supplier) SELECT a.k AS left_key, b.k AS right_key FROM a JOIN a b ON a.n = b.n AND a.k < b.k AND abs(a.v - b.v) <= 500""")
def comparable_pairs(t: Tables) -> DataFrame:
    """Pairs that agree in one field and differ little in another."""
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("v"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k")) & (F.abs(F.col("a.v") - F.col("b.v")) <= 500)).select(F.col("a.k").alias("left_key"), F.col("b.k").alias("right_key"))


@query("""SELECT o_orderstatus AS phase, count(*) AS rows, count(DISTINCT o_custkey) AS sources, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def result_counters(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("phase")).agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("sources"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
