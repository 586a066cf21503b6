"""Queries of the inventory, duplicate-detection, scoring and selection stages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, hash_percent, letter_hash, metric, natural_key, occurrence_decay, sign_hash
from ..operators import similarity
from ..operators.ranking import numbered
from ..sources import scratch
from .registry import LETTER_HASH, Tables, query


@query("""SELECT doc_id, lower(source) AS media_set, CASE WHEN n_chars >= 4000 THEN 'long' WHEN n_chars >= 1000 THEN 'medium' ELSE 'short' END AS kind, lang
FROM documents WHERE n_chars > 0""")
def inventory_scan(t: Tables) -> DataFrame:
    kind = F.when(F.col("n_chars") >= 4000, "long").when(F.col("n_chars") >= 1000, "medium").otherwise("short")
    return t.documents.where("n_chars > 0").select("doc_id", F.lower("source").alias("media_set"), kind.alias("kind"), "lang")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS section,
  lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS extension, regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g') AS slug FROM pages""")
def url_classify(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id",
        F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/", 1).alias("section"),
        F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).alias("extension"),
        F.regexp_replace(F.lower(F.regexp_replace(url, "^https?://", "")), "[^a-z0-9]+", "-").alias("slug"),
    )


@query("""SELECT o_orderkey, coalesce(first_ship, o_orderdate) AS capture_date, CASE WHEN first_ship IS NOT NULL THEN 'metadata' ELSE 'created' END AS capture_source
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def capture_fallback(t: Tables) -> DataFrame:
    ships = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    joined = t.orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("first_ship", "o_orderdate").alias("capture_date"), F.when(F.col("first_ship").isNotNull(), "metadata").otherwise("created").alias("capture_source"))


@query("""SELECT o_orderkey, c_name, n_name, r_name, coalesce(n_lines, 0) AS n_lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def enriched_rows(t: Tables) -> DataFrame:
    """Rows with the names that their keys stand for, and a count from a table of details, aggregated before it is joined."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""WITH g AS (SELECT text, 'dup_' || min(doc_id) AS group_id, min(doc_id) AS keeper, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT group_id, members, doc_id, keeper, doc_id = keeper AS is_keeper, CASE WHEN doc_id = keeper THEN 'keep' ELSE 'remove' END AS action, 'exact_sha256' AS duplicate_type, 100.0::DOUBLE AS confidence, source, lang, n_chars, CASE WHEN doc_id = keeper THEN '' ELSE 'same content as ' || keeper END AS reason, CAST(row_number() OVER (PARTITION BY group_id ORDER BY doc_id) AS INTEGER) AS position, sha256(text) AS digest FROM documents JOIN g USING (text)""")
def duplicate_manifest(t: Tables) -> DataFrame:
    """Every member of every group of copies, what becomes of it and why."""
    d = t.documents.withColumn("digest", F.sha2("text", 256)).drop("text")
    g = d.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("members")).where("members > 1")
    kept = F.col("doc_id") == F.col("keeper")
    return d.join(g, "digest").select(
        F.concat(F.lit("dup_"), F.col("keeper").cast("string")).alias("group_id"), "members", "doc_id", "keeper", kept.alias("is_keeper"), F.when(kept, "keep").otherwise("remove").alias("action"), F.lit("exact_sha256").alias("duplicate_type"), F.lit(100.0).alias("confidence"),
        "source", "lang", "n_chars", F.when(kept, "").otherwise(F.concat(F.lit("same content as "), F.col("keeper").cast("string"))).alias("reason"), F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")).alias("position"), "digest",
    )


@query("SELECT p_name, p_type, p_size, min(p_retailprice) AS price FROM part GROUP BY ALL HAVING count(DISTINCT p_retailprice) = 1")
def ambiguous_name_index(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name", "p_type", "p_size").agg(F.min("p_retailprice").alias("price"), F.count_distinct("p_retailprice").alias("n")).where("n = 1").drop("n")


@query("""SELECT doc_id, sha256(text) AS digest, count(*) OVER w AS group_size, min(doc_id) OVER w AS keeper, doc_id = min(doc_id) OVER w AS is_keeper
FROM documents WINDOW w AS (PARTITION BY text)""")
def exact_duplicates(t: Tables) -> DataFrame:
    return similarity.exact_groups(t.documents.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("""SELECT 'dup_' || lpad(CAST(row_number() OVER (ORDER BY min(doc_id)) AS VARCHAR), 4, '0') AS group_id, min(doc_id) AS keeper, count(*) AS members, CAST(count(*) - 1 AS BIGINT) AS removable
FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_groups(t: Tables) -> DataFrame:
    groups = t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("members")).where("members > 1")
    ranked = numbered(groups.select("keeper", "members"), ["keeper"], "rank")
    return ranked.select(F.concat(F.lit("dup_"), F.lpad(F.col("rank").cast("string"), 4, "0")).alias("group_id"), "keeper", "members", (F.col("members") - 1).alias("removable"))


@query("SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)")
def keeper_manifest(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("digest", F.sha2("text", 256)).select("doc_id", "source", "n_chars", "digest")
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    extra = docs.join(groups, "digest").where("doc_id <> keeper").select("doc_id")
    return docs.join(extra, "doc_id", "left_anti").select("doc_id", "source", "n_chars")


_HASHES = """h AS (SELECT vec_id, label, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b) AS bits FROM embeddings)"""


@query(f"""WITH {LETTER_HASH}, g AS (SELECT bits, min(doc_id) AS doc, count(*) AS n FROM h GROUP BY 1)
SELECT a.doc AS a, b.doc AS b, a.n * b.n AS pairs, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM g a JOIN g b ON a.doc < b.doc AND bit_count(xor(a.bits, b.bits)) <= 2""")
def near_duplicates_hamming(t: Tables) -> DataFrame:
    """Pairs of different hashes within two bits, each by its least document, and the pairs of documents they stand for."""
    hashes = t.documents.select("doc_id", letter_hash(F.coalesce("text", F.lit(" "))).alias("bits")).groupBy("bits").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"))
    hashes = scratch.written(hashes, "letter-hashes")
    sizes = [hashes.select(F.col("doc").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b")]
    near = similarity.hamming_pairs(hashes, "doc", "bits", 2).join(sizes[0], "a").join(sizes[1], "b")
    return near.select("a", "b", (F.col("n_a") * F.col("n_b")).alias("pairs"), "distance")


@query(f"""WITH {LETTER_HASH}, g AS (SELECT bits, min(doc_id) AS class_id, count(*) AS n FROM h GROUP BY 1), l AS (SELECT a.bits, sum(b.n) AS links FROM g a JOIN g b ON a.bits <> b.bits AND bit_count(xor(a.bits, b.bits)) <= 2 GROUP BY 1)
SELECT doc_id, class_id, CAST(coalesce(links, 0) + n - 1 AS BIGINT) AS n_links FROM h JOIN g USING (bits) LEFT JOIN l USING (bits)""")
def hash_links(t: Tables) -> DataFrame:
    """Each document's class of equal hashes and the number of others within two bits."""
    return similarity.hamming_links(t.documents.select("doc_id", letter_hash(F.coalesce("text", F.lit(" "))).alias("bits")), "doc_id", "bits", 2)


@query(f"""WITH {_HASHES}, bit AS (SELECT label, i, 2 * sum(CAST((bits >> i) & 1 AS INTEGER)) >= count(*) AS one FROM h, (SELECT unnest(range(0, 64)) AS i) GROUP BY label, i)
SELECT label, string_agg(CASE WHEN one THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS majority FROM bit GROUP BY label""")
def majority_hash(t: Tables) -> DataFrame:
    hashed = t.embeddings.select("label", sign_hash(F.col("embedding")).alias("bits"))
    votes = [(2 * F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))) >= F.count("*")).cast("int").cast("string") for i in reversed(range(64))]
    return hashed.groupBy("label").agg(F.concat(*votes).alias("majority"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, least(greatest(l_quantity * 2, 0), 100) AS technical, least(greatest(100 - abs(l_discount - 0.05) * 1000, 0), 100) AS exposure, least(greatest(l_extendedprice / 1000, 0), 100) AS story FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor((35 * technical + 35 * exposure + 30 * story) * 10 + 0.5)::BIGINT AS quality, floor(greatest(60 * technical + 40 * story, 50 * exposure + 50 * story) * 10 + 0.5)::BIGINT AS purpose FROM s""")
def quality_scores(t: Tables) -> DataFrame:
    """Scores in thousandths, as whole numbers."""
    technical, exposure, story = clamp(F.col("l_quantity") * 2), clamp(100 - F.abs(F.col("l_discount") - 0.05) * 1000), clamp(F.col("l_extendedprice") / 1000)
    scored = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", technical.alias("technical"), exposure.alias("exposure"), story.alias("story"))
    quality = 35 * F.col("technical") + 35 * F.col("exposure") + 30 * F.col("story")
    purpose = F.greatest(60 * F.col("technical") + 40 * F.col("story"), 50 * F.col("exposure") + 50 * F.col("story"))
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.floor(quality * 10 + 0.5).alias("quality"), F.floor(purpose * 10 + 0.5).alias("purpose"))


@query("""SELECT d.doc_id, concat_ws(',', CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0 THEN 'album' END, CASE WHEN n_chars BETWEEN 200 AND 2000 THEN 'reel' END, CASE WHEN n_chars > 2000 THEN 'documentary' END) AS recommended_uses
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def recommended_uses(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    uses = F.concat_ws(",", F.when(good, "album"), F.when(F.col("n_chars").between(200, 2000), "reel"), F.when(F.col("n_chars") > 2000, "documentary"))
    return t.documents.select("doc_id", "n_chars").join(labels, "doc_id", "left").select("doc_id", uses.alias("recommended_uses"))


@query("""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, value, CAST(rk AS INTEGER) AS rank, CASE WHEN value >= 200 THEN 'threshold' ELSE 'quota' END AS reason FROM r
WHERE rk <= 250 AND (value >= 200 OR rk <= least(250, greatest(20, CAST(floor(n * 0.1) AS BIGINT))))""")
def select_topk_quota(t: Tables) -> DataFrame:
    ranked = t.events.select("event_id", "event_type", "value").withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")))
    sizes = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    quota = F.least(F.lit(250), F.greatest(F.lit(20), F.floor(F.col("n") * 0.1)))
    kept = ranked.where("rank <= 250").join(sizes, "event_type").where((F.col("value") >= 200) | (F.col("rank") <= quota))
    return kept.select("event_id", "event_type", "value", "rank", F.when(F.col("value") >= 200, "threshold").otherwise("quota").alias("reason"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
SELECT l_suppkey, count(*) AS kept, sum(l_quantity) AS runtime FROM r WHERE before < 300 GROUP BY 1""")
def runtime_preservation(t: Tables) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    before = F.coalesce(F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return t.lineitem.withColumn("before", before).where("before < 300").groupBy("l_suppkey").agg(F.count("*").alias("kept"), F.sum("l_quantity").alias("runtime"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount_percents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def purpose_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount_percents"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{5,}') AS ws FROM documents),
f AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) GROUP BY doc_id, x),
r AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM f)
SELECT w.doc_id, coalesce(string_agg(x, ',' ORDER BY i), '') AS keywords FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND rk <= 12 GROUP BY w.doc_id""")
def keyword_extract(t: Tables) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{5,}"), 0))
    return t.documents.select("doc_id", F.array_join(F.slice(words, 1, 12), ",").alias("keywords"))


@query(r"""SELECT event_id, CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS DOUBLE) AS k, round(value, 2) AS score FROM events WHERE regexp_matches(props, '"k": -?[0-9]+')""")
def kv_metric_parse(t: Tables) -> DataFrame:
    reason = F.concat(F.lit("k="), F.regexp_extract("props", '"k": (-?[0-9]+)', 1), F.lit("; score="), F.format_string("%.2f", F.round("value", 2)))
    parsed = t.events.select("event_id", reason.alias("reason"))
    return parsed.select("event_id", metric(F.col("reason"), "k").alias("k"), metric(F.col("reason"), "score").alias("score")).where("k is not null")


ALIASES = {"water": ("rethe", "thnt"), "summit": ("ción", "ados"), "camp": ("ungen", "keit"), "bridge": ("eaux", "elle")}
_ALIAS_SQL = ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{a}')" for a in (k, *v))} THEN '{k}' END" for k, v in ALIASES.items())


@query(f"SELECT doc_id, concat_ws(',', {_ALIAS_SQL}) AS terms FROM documents")
def alias_term_match(t: Tables) -> DataFrame:
    low = F.lower("text")

    def hit(words):
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        return found

    return t.documents.select("doc_id", F.concat_ws(",", *[F.when(hit((k, *v)), k) for k, v in ALIASES.items()]).alias("terms"))


@query("""WITH w AS (SELECT DISTINCT source, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), n AS (SELECT source, lang, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT a.source, count(*) AS common FROM w a JOIN w b ON a.source = b.source AND a.w = b.w AND a.lang = 'en' AND b.lang = 'de' GROUP BY 1)
SELECT a.source, round(coalesce(common, 0) / (a.n + b.n - coalesce(common, 0)), 6) AS similarity FROM n a JOIN n b ON a.source = b.source AND a.lang = 'en' AND b.lang = 'de' LEFT JOIN c ON c.source = a.source""")
def jaccard_tags(t: Tables) -> DataFrame:
    """Of each source's words in two languages: distinct words first, then sizes by joins, so no set is gathered."""
    words = t.documents.where(F.col("lang").isin("en", "de")).select("source", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w")).distinct()
    both = words.groupBy("source", "w").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))
    sizes = both.groupBy("source").agg(F.sum("en").alias("en"), F.sum("de").alias("de"), F.sum(F.col("en") * F.col("de")).alias("common"))
    return sizes.where("en > 0 and de > 0").select("source", F.round(F.col("common") / (F.col("en") + F.col("de") - F.col("common")), 6).alias("similarity"))


@query("""SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'customers' AS kind, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops_media_sets(t: Tables) -> DataFrame:
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    parts = {"both": c.intersect(s), "customers": c.subtract(s), "any": c.union(s).distinct()}
    out = [df.select(F.lit(kind).alias("kind"), "k") for kind, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(r"""WITH p AS (SELECT page_id, lower(url) AS u FROM pages), k AS (SELECT page_id, list_transform(regexp_extract_all(u, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, CAST(greatest(20, length(x)) AS INTEGER), '0') ELSE x END) AS parts FROM p)
SELECT page_id, row_number() OVER (ORDER BY array_to_string(parts, ''), page_id) AS rank FROM k""")
def natural_sort_rank(t: Tables) -> DataFrame:
    """Pages in the order of their address, with digit runs by value."""
    return numbered(t.pages.select("page_id", natural_key(F.col("url")).alias("key")), ["key", "page_id"], "rank").select("page_id", "rank")


@query("""SELECT o_orderkey, (CAST('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000) / 100 AS percent FROM orders WHERE (CAST('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000) / 100 < 10""")
def hash_sampling(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", hash_percent(F.col("o_orderkey").cast("string")).alias("percent")).where("percent < 10")


@query("""WITH s AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seen FROM events)
SELECT event_id, CAST(seen AS BIGINT) AS seen, least(greatest(78.0 - least(5.0 * seen, 30.0) + CASE WHEN event_type IN ('purchase', 'signup') THEN 6.0 ELSE 0.0 END, 35.0), 100.0)::DOUBLE AS diversity FROM s""")
def source_occurrence_decay(t: Tables) -> DataFrame:
    seen = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return t.events.select("event_id", "event_type", seen.alias("seen")).select("event_id", "seen", occurrence_decay(F.col("seen"), F.col("event_type").isin("purchase", "signup")).alias("diversity"))


@query("""SELECT p_brand, variant, count(*) FILTER (WHERE p_size <= lim) AS n, CASE WHEN count(*) FILTER (WHERE p_size <= lim) >= 20 THEN 'ready' WHEN count(*) FILTER (WHERE p_size <= lim) > 0 THEN 'partial' ELSE 'empty' END AS status
FROM part CROSS JOIN (VALUES ('small', 10), ('medium', 25), ('large', 50)) v(variant, lim) GROUP BY 1, 2""")
def cross_variant_report(t: Tables) -> DataFrame:
    limits = {"small": 10, "medium": 25, "large": 50}
    rows = t.part.select("p_brand", "p_size", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(v).alias("lim")) for k, v in limits.items()])).alias("v"))
    counted = rows.groupBy("p_brand", F.col("v.variant").alias("variant")).agg(F.count_if(F.col("p_size") <= F.col("v.lim")).alias("n"))
    return counted.withColumn("status", F.when(F.col("n") >= 20, "ready").when(F.col("n") > 0, "partial").otherwise("empty"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name IN ('ASIA', 'EUROPE'))")
def enabled_semi_join(t: Tables) -> DataFrame:
    enabled = t.nation.join(t.region.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(enabled, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a, b, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank
FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3""")
def cosine_neighbors(t: Tables) -> DataFrame:
    """The three nearest of all rows to each query; queries are the rows whose id is divisible by 100."""
    return similarity.top_cosine(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 3)
