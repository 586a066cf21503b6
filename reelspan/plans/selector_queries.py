"""Albums, reels, highlights, timelines, moments by a target number, repetition by reason, and terms of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, terms
from ..functions.scalars import letter_hash, seconds
from ..operators import repetition, selectors, sessions
from ..sources import scratch
from .curation_queries import _ASSETS, _list, as_assets, assets
from .registry import Tables, query
from .timeline_queries import _SESSIONS, CAP, _sessions

ALBUMS = (
    selectors.Album("small", 10, 12, 16, 1, 2),
    selectors.Album("standard", 16, 20, 28, 1, 3, apart_from=("small",)),
    selectors.Album("enhanced", 10, 40, 10_000, all_good=True, overlap=0.05, apart_from=("small", "standard")),
)


@query()
def album_selection(t: Tables) -> DataFrame:
    """Three albums of each source's documents, the later ones apart from the earlier: photos are texts, hashed by their letters, taken one a half minute, fifty a moment."""
    i, words = F.col("doc_id"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("double")
    rows = t.documents.select(
        F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("lang", F.lit("")).alias("media_set"), letter_hash(F.coalesce("text", F.lit(" "))).alias("visual"), (i * 30.0).alias("at"), F.floor(i / 50).alias("moment"),
        (F.floor(i / 50) % 4 == 0).alias("important"), F.least(words / 5, F.lit(100.0)).alias("final"), (F.least(words / 5, F.lit(100.0)) + i % 7).alias("variant"),
    )
    likeness = selectors.photo_likeness(width=64, copy_bits=2, burst_bits=6)
    return selectors.albums(rows, ["source"], "doc_id", ALBUMS, likeness, [F.col("at"), -F.col("variant")])


def _opening_rank(kind: Column) -> Column:
    return F.when(kind.rlike("walk|stairs|start"), 0).when(kind.rlike("gear|helmet"), 1).when(F.contains(kind, F.lit("arrival")), 2).otherwise(3)


def segments(t: Tables) -> DataFrame:
    """The assets as windows of their users' footage, with what selectors ask of them."""
    events = t.events.select("event_id", "user_id", "ts", "value")
    whole = scratch.written(events.groupBy("user_id").agg(F.min(seconds(F.col("ts"))).alias("first"), F.max(seconds(F.col("ts"))).alias("last")), "footage")
    # joined first: tags and names are wider than what they are made of
    spans = as_assets(events.join(whole, "user_id"), "first", "last").withColumns({"start": F.col("at") - F.col("first"), "source_seconds": F.col("last") - F.col("first")})
    kind = F.col("moment_type")
    score = F.col("technical") + 0.55 * F.col("motion") + 0.45 * F.col("story") + rules.tag_bonus("tags", rules.HIGHLIGHT_BONUS)
    weak = ("ground_only", "setup_surface", "weak_close_pov")
    shown = rules.any_tag("tags", ("group_reaction", "face_visible", "people_visible"))
    return spans.select(
        "media_set", "event_id", F.col("user_id").alias("source"), F.col("first").alias("source_order"), "start", (F.col("start") + F.col("seconds")).alias("end"), "seconds", "source_seconds", "tags", "role", kind.alias("moment_type"), rules.bucket(kind, F.col("role")).alias("bucket"),
        F.floor(F.col("at") / 21_600).alias("moment"), (F.col("event_id") % len(rules.MOMENT_TYPES)).alias("story_order"), _opening_rank(kind).alias("opening_rank"), (_opening_rank(kind) >= 3).alias("weak_opening"), F.col("motion").alias("activity"), F.col("technical").alias("final"),
        F.col("people").alias("remembered"), F.col("story").alias("confidence"), score.alias("score"), ((F.col("story") >= 35) & ~F.array_contains("tags", "ground_only")).alias("strong"), ((F.col("technical") >= 82) & shown).alias("memorable"),
        (rules.any_tag("tags", ("water_speed_run", "mud_water_run", "speed_action", "lit_tunnel")) & ~rules.any_tag("tags", weak)).alias("pays"), (F.col("technical") + rules.payoff_bonus("tags")).alias("payoff"),
    )


@query()
def reel_selection(t: Tables) -> DataFrame:
    """A reel of each media set in nine turns, with budgets for opening and ending, caps by moment, source and role."""
    plan = selectors.Reel(target=1800.0, most=24, least=12, opening=120.0, ending=120.0, required_types=("launch", "rapids", "water_action", "splash"), required_tags=("lit_tunnel", "water_speed_run", "speed_action"))
    return selectors.reel(segments(t).withColumnRenamed("remembered", "memory"), ["media_set"], "event_id", plan)


COVERAGE = {"lit_tunnel": 1, "water_speed_run": 4, "mud_water_run": 2, "water_crossing": 1, "speed_action": 1}


@query()
def master_highlight(t: Tables) -> DataFrame:
    """A highlight of each media set: required tags, memories, each source's events and best windows, late payoffs."""
    plan = selectors.Highlight(target=7200.0, most=120, per_source=3, required_tags=("lit_tunnel", "water_speed_run"), coverage=COVERAGE, layout_limits={"water_action": 5, "tunnel": 5, "motion": 5, "action_camera_water": 5})
    late = F.col("pays") & (F.col("start") >= 0.55 * F.col("source_seconds"))
    return selectors.highlight(segments(t).withColumnRenamed("memorable", "memory").withColumn("late", late), ["media_set"], "event_id", plan)


TIMELINE = selectors.Timeline(target=900.0, most=30, required_tags=("lit_tunnel", "water_speed_run", "mud_water_run", "water_crossing", "speed_action", "group_reaction", "face_visible", "people_visible"))


@query()
def budgeted_selection(t: Tables) -> DataFrame:
    """A timeline of each media set within fifteen minutes of output at double speed, anchors at normal speed."""
    rows = segments(t).withColumns({"price": F.greatest("seconds", F.lit(0.1)) / 2.0, "anchor_price": F.greatest("seconds", F.lit(0.1))})
    return selectors.budgeted(rows, ["media_set"], "event_id", TIMELINE)


@query()
def timeline_speeds(t: Tables) -> DataFrame:
    """The slowest speed of four at which a media set's timeline shows its tags, and that timeline."""
    return selectors.least_speed(segments(t), ["media_set"], "event_id", TIMELINE, (1.0, 1.5, 2.0, 3.0))


@query(f"""WITH RECURSIVE {_SESSIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) - 1 AS i FROM s),
whole AS (SELECT user_id, list(t0 ORDER BY i) AS ts, count(*) AS n FROM p GROUP BY 1), b AS (SELECT user_id, min(i) AS lo FROM p GROUP BY user_id, session),
f AS (SELECT user_id, ts, n, list(lo ORDER BY lo) AS cuts, CAST(2 * count(*) AS BIGINT) AS target FROM b JOIN whole USING (user_id) GROUP BY ALL
  UNION ALL SELECT user_id, ts, n, list_sort(list_append(cuts, lo + CASE WHEN size <= 2 THEN 1 WHEN widest.g > 5 AND widest.j BETWEEN greatest(1, size // 4) AND least(size - 1, size * 3 // 4) THEN widest.j ELSE size // 2 END)), target
  FROM (SELECT *, list_max(list_transform(range(1, size), lambda j: {{'g': ts[lo + 1 + j] - ts[lo + j], 'j': j}})) AS widest FROM (SELECT *, big.size AS size, big.lo AS lo FROM (
    SELECT *, list_max(list_transform(range(1, len(cuts) + 1), lambda k: {{'size': coalesce(cuts[k + 1], n) - cuts[k], 'lo': cuts[k]}})) AS big FROM f WHERE len(cuts) < target) z) y WHERE size > 1) x),
d AS (SELECT user_id, unnest(cuts) AS lo, unnest(list_transform(range(1, len(cuts) + 1), lambda k: coalesce(cuts[k + 1], n) - cuts[k])) AS size FROM (SELECT user_id, n, arg_max(cuts, len(cuts)) AS cuts FROM f GROUP BY 1, 2)),
c AS (SELECT user_id, lo + CAST(round_even(k * size / ((size + {CAP - 28}) // {CAP - 27}), 0) AS BIGINT) AS lo FROM (SELECT *, unnest(range(0, (size + {CAP - 28}) // {CAP - 27})) AS k FROM d))
SELECT p.event_id, p.user_id, count(c.lo) AS moment FROM p JOIN c ON p.user_id = c.user_id AND c.lo <= p.i GROUP BY ALL""")
def target_moments(t: Tables) -> DataFrame:
    """Each user's sessions cut further, at the widest gaps, until there are twice as many, and into moments of at most thirteen."""
    s = _sessions(t).select("event_id", "user_id", seconds(F.col("ts")).alias("at"), "session")
    counts = s.groupBy("user_id").agg((2 * F.count_distinct("session")).alias("target"))
    return sessions.split_to_target(s.join(counts, "user_id"), ["user_id"], "event_id", "at", "session", "target", CAP - 27)


_BACKGROUND, _GENERIC, _PRESERVED = (_list(x) for x in (repetition.BACKGROUND, repetition.GENERIC, repetition.PRESERVED))
_LAYOUT = "concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(tags, {_list(v)}) THEN '{k}' END" for k, v in repetition.LAYOUT.items()) + ")"
_SHARE = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_ALIKE = f"layout <> '' AND layout = k.layout AND greatest({_SHARE.format(a='visual', b='k.visual')}, {_SHARE.format(a='background', b='k.background')}) >= 0.72 OR people AND {_SHARE.format(a='background', b='k.background')} >= 0.72"


@query(f"""WITH RECURSIVE {_ASSETS}, q AS (SELECT event_id, user_id, t0, seconds, technical AS score, people < 14 AND story < 30 AS faceless, embedding::DOUBLE[] AS vector, list_filter(tags, lambda x: NOT list_contains({_GENERIC}, x)) AS visual, list_filter(tags, lambda x: list_contains({_BACKGROUND}, x)) AS background,
    {_LAYOUT} AS layout, list_has_any(tags, ['face_visible', 'people_visible']) AS people, list_has_any(tags, {_PRESERVED}) AS preserved FROM m LEFT JOIN embeddings ON vec_id = event_id // 3),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS i, CAST(sum(CAST(round(seconds * 1000000) AS BIGINT)) OVER (PARTITION BY user_id) AS DOUBLE) / 1000000 AS total FROM q),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, '' AS why, true AS kept, 0.0::DOUBLE AS dropped, CAST([] AS STRUCT(layout VARCHAR, visual VARCHAR[], background VARCHAR[], vector DOUBLE[])[]) AS recent FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, i, event_id, why, kept, dropped + CASE WHEN kept THEN 0.0 ELSE seconds END, CASE WHEN kept THEN list_slice(list_append(recent, {{'layout': layout, 'visual': visual, 'background': background, 'vector': vector}}), -6, -1) ELSE recent END
  FROM (SELECT *, why NOT IN ('faceless', 'similar_tags', 'similar_vector') AS kept FROM (SELECT *, CASE WHEN preserved THEN 'preserved' WHEN faceless THEN 'faceless' WHEN total - dropped - seconds < greatest(8.0, total * 0.45) THEN 'too_little_left' WHEN like_tags = 0 AND like_vector = 0 THEN 'new' WHEN score >= 92 THEN 'high_score' WHEN like_tags = 1 THEN 'similar_tags' ELSE 'similar_vector' END AS why
    FROM (SELECT o.*, f.dropped, f.recent, CASE WHEN len(list_filter(list_slice(recent, -2, -1), lambda k: {_ALIKE})) >= 2 THEN 1 ELSE 0 END AS like_tags, CASE WHEN len(list_filter(recent, lambda k: coalesce(list_cosine_similarity(vector, k.vector), 0.0) >= 0.91)) > 0 THEN 1 ELSE 0 END AS like_vector FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) z) y) x)
SELECT event_id, user_id, kept, why FROM f WHERE i > 0""")
def repetition_reasons(t: Tables) -> DataFrame:
    """Which of a user's rows repeat the last ones kept, and why: by tags, by vector, for lack of a face; preserved rows stay."""
    vectors = t.embeddings.select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    m = assets(t).withColumn("v", F.floor(F.col("event_id") / 3)).join(vectors, "v", "left")
    rows = m.select("event_id", "user_id", "at", "seconds", F.col("technical").alias("score"), ((F.col("people") < 14) & (F.col("story") < 30)).alias("faceless"), "vector", *(c.alias(n) for n, c in repetition.signatures().items()))
    return repetition.judged(rows, ["user_id"], "event_id")


_NEEDLES = ", ".join(f"('{t}', '{n}')" for t in terms.ALIASES for n in terms.needles(t))


@query(f"""WITH {_ASSETS}, a(term, needle) AS (VALUES {_NEEDLES}) SELECT DISTINCT event_id, term FROM m JOIN a ON contains(lower(replace(moment_type, '_', ' ') || ' ' || role || ' ' || name || ' ' || array_to_string(tags, ' ')), needle)""")
def profile_terms(t: Tables) -> DataFrame:
    """The terms of profiles that the words of an asset speak for, by an automaton of all their needles."""
    words = F.concat_ws(" ", F.replace(F.col("moment_type"), F.lit("_"), F.lit(" ")), "role", "name", F.array_join("tags", " "))
    return terms.term_hits(assets(t).select("event_id", words.alias("words")), "event_id", "words", terms.alias_table(t.spark))


_PATTERNS = {"english": "*/en/*", "secure": "https://**", "numbered": "**/[0-9][0-9][0-9]*", "mobile": "*//m.*", "plain": "example.org", "short": "**/???"}


@query(r"""SELECT page_id, concat_ws(',', CASE WHEN regexp_full_match(lower(url), '[^/]*/en/[^/]*') THEN 'english' END, CASE WHEN regexp_full_match(lower(url), 'https://.*') THEN 'secure' END, CASE WHEN regexp_full_match(lower(url), '.*/[0-9][0-9][0-9][^/]*') THEN 'numbered' END,
  CASE WHEN regexp_full_match(lower(url), '[^/]*//m\.[^/]*') THEN 'mobile' END, CASE WHEN contains(lower(url), 'example.org') THEN 'plain' END, CASE WHEN regexp_full_match(lower(url), '.*/[^/][^/][^/]') THEN 'short' END) AS patterns FROM pages""")
def path_patterns(t: Tables) -> DataFrame:
    """Which patterns an address is of."""
    return t.pages.select("page_id", F.concat_ws(",", *[F.when(terms.glob(F.col("url"), p), name) for name, p in _PATTERNS.items()]).alias("patterns"))
