"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Texts are cut into tokens: numbers, and runs of letters (all of non-ASCII among them). A number
becomes <num>, a unit word after a number <unit>, a token that starts with a capital <name>;
any other token stands for itself. Windows of `width` canonical tokens with at least `literals`
plain ones are hash-joined with those of the benchmark items, so a question with other numbers,
names or units still meets its template. A second, folded template (all words in lower case, no
names) finds copies in any case.

Slot consistency then tells a re-parameterised question from chance: over the windows that a
document shares with an item, a slot value of the item must stand for one value of the
document, and the other way round. A document leaks an item if the shared windows make up
`coverage` of the item's windows at least, and `consistent` of the slot pairs at least agree with the
most frequent partner of their item value.

That is judged for the first match of each item window, and also for each run of matches in the item's
order and for each alignment (place in the document less place in the item), so what stands elsewhere in
the document does not hide a leak. The first matches are reported if they are a leak, else the best other.

Defined results: null texts have no windows; an item without a window of enough plain tokens
meets nothing; rows that agree in doc_id and text give one result, a null doc_id is a value of its
own; items of a null item_id are left out; further columns are ignored, whatever their names; empty tables give
empty results. Texts are read whole: a very long one is one row, cut into one row a window. Of a pair's tries of equal
rank the greatest by coverage, consistency and counts is reported; thresholds that are met exactly count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
JAVA_TOKEN = r"[0-9]++(?:[.,:/][0-9]+)*+|[A-Za-z\x{80}-\x{10FFFF}]++"  # the same; Java takes many times longer over the negated class
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms "
    "ton tons ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees kb mb gb tb hz khz mhz ghz v w kw kwh mph kmh"
).split()


@dataclass(frozen=True)
class DecontaminationRules:
    width: int = 8
    literals: int = 4
    coverage: float = 0.5
    consistent: float = 0.8
    broadcast_windows: int = 500_000  # the benchmark is broadcast up to so many windows, else joined by a shuffle


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_TOKEN), 0)


def _is_number(t: Column) -> Column:
    return t.between("0", "9~")


def canonical(tokens_column: str, names: bool = True) -> Column:
    """The tokens of a column with typed placeholders (without <name> if the tokens are folded)."""

    def one(t: Column, i: Column) -> Column:
        before = F.try_element_at(tokens_column, F.when(i > 0, i.cast("int")))  # i counts from 0, so this is the token before
        return (
            F.when(_is_number(t), "<num>")
            .when(F.lit(names) & ((t < "a") | (t >= "\u0080") & t.rlike(r"^\p{Lu}")), "<name>")
            .when(t.isin(*UNITS) & _is_number(before), "<unit>")
            .otherwise(t)
        )

    return F.transform(tokens_column, one)


def windows_of(column: str, width: int) -> Column:
    """The digest of each window of an array of token digests, in order. (slice() of a window would copy it through a Scala vector.)"""
    return F.when(
        F.size(column) >= width,
        F.transform(F.sequence(F.lit(0), F.size(column) - width), lambda i: F.xxhash64(*[F.get(column, i + k) for k in range(width)])),
    )


def template_index(items: DataFrame, rules: DecontaminationRules) -> DataFrame:
    """folded, item_id, at (from 1), digest, item_values, item_window of each window with enough plain tokens."""
    cut = _cut(items.where("item_id is not null").select("item_id", "text"), rules.width)
    rows = cut.select("folded", "item_id", "values", "template", F.posexplode("digests").alias("at", "digest"))
    rows = rows.select(
        "folded",
        "item_id",
        (F.col("at") + 1).alias("at"),
        "digest",
        F.slice("values", F.col("at") + 1, rules.width).alias("item_values"),
        F.slice("template", F.col("at") + 1, rules.width).alias("item_window"),
    )
    return rows.where(F.size(F.filter("item_window", lambda t: ~t.startswith("<"))) >= rules.literals)


def _cut(keyed: DataFrame, width: int) -> DataFrame:
    """keyed with folded, values, template and digests (of its windows) in place of text: two rows of each."""
    cut = keyed.withColumn("values", tokens(shared.text_of())).drop("text").withColumn("low", F.transform("values", F.lower))
    cut = cut.withColumns({"template": canonical("values"), "low_template": canonical("low", names=False)})
    typed = [F.struct(F.lit(f).alias("folded"), F.col(v).alias("values"), F.col(t).alias("template")) for f, v, t in ((False, "values", "template"), (True, "low", "low_template"))]
    rest = [c for c in keyed.columns if c != "text"]
    each = cut.select(*rest, F.explode(F.array(*typed)).alias("typed")).select(*rest, "typed.*").withColumn("hashes", F.transform("template", lambda t: F.xxhash64(t)))
    return each.withColumn("digests", windows_of("hashes", width)).drop("hashes")


def _met(keyed: DataFrame, keys: list[str], digests: DataFrame, rules: DecontaminationRules) -> DataFrame:
    """keys, doc_id, folded, item_id, item_at, at, values, window of the windows that documents share with items.

    digests is broadcast (its size is checked), so values are cut out where they meet and nothing else is shuffled.
    """
    # outer, as Spark would else filter on the size of digests, with all that digests is made of inlined into its lambda
    each = _cut(keyed, rules.width).select(*keys, "doc_id", "folded", "values", "template", F.posexplode_outer("digests").alias("at", "digest"))
    here = F.col("at") + 1
    met = each.join(F.broadcast(digests), ["folded", "digest"])
    return met.select(*keys, "doc_id", "folded", "item_id", "item_at", here.alias("at"), F.slice("values", here, rules.width).alias("values"), F.slice("template", here, rules.width).alias("window")).distinct()


def _met_by_shuffle(keyed: DataFrame, keys: list[str], digests: DataFrame, rules: DecontaminationRules) -> DataFrame:
    """The same for a benchmark of any size: digests meet by a shuffle, then the documents concerned give their values."""
    each = _cut(keyed, rules.width).select(*keys, "doc_id", "folded", F.posexplode_outer("digests").alias("at", "digest"))
    met = each.join(digests, ["folded", "digest"]).select(*keys, "folded", "item_id", "item_at", (F.col("at") + 1).alias("at")).distinct()
    places = shared.written(met.groupBy(*keys, "folded").agg(F.collect_list(F.struct("item_id", "item_at", "at")).alias("places")), "met-windows")
    cut = _cut(keyed.dropDuplicates(keys), rules.width).join(places, [*keys, "folded"])
    values = F.transform("places", lambda m: F.struct(m["item_id"].alias("item_id"), m["item_at"].alias("item_at"), m["at"].alias("at"), F.slice("values", m["at"], rules.width).alias("values"), F.slice("template", m["at"], rules.width).alias("window")))
    return cut.select(*keys, "doc_id", "folded", F.explode(values).alias("m")).select(*keys, "doc_id", "folded", "m.*")


def _tries(seen: DataFrame, pair: list[str]) -> DataFrame:
    """seen (pair, item_at, at, ...) with the column try: each match once as a first one (0), in its run (1) and alignment (2), where those are others."""
    of_pair = Window.partitionBy(*pair)
    order = of_pair.orderBy("at", "item_at")
    back = F.coalesce(F.lag("item_at").over(order) >= F.col("item_at"), F.lit(False))
    seen = seen.withColumns({"back": back.cast("long"), "shift": F.col("at").cast("long") - F.col("item_at")})
    seen = seen.withColumn("run", F.sum("back").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumns({"runs": F.max("run").over(of_pair), "least": F.min("shift").over(of_pair), "most": F.max("shift").over(of_pair), "first_at": F.min("at").over(Window.partitionBy(*pair, "item_at"))})
    tries = [(0, F.lit(0).cast("long"), F.col("at") == F.col("first_at")), (1, F.col("run"), F.col("runs") > 0), (2, F.col("shift"), F.col("least") < F.col("most"))]
    each = F.filter(F.array(*[F.when(where, F.struct(F.lit(k).alias("kind"), n.alias("n"))) for k, n, where in tries]), lambda x: x.isNotNull())
    return seen.withColumn("try", F.explode(each)).drop("back", "shift", "run", "runs", "least", "most", "first_at")


def leaks(docs: DataFrame, items: DataFrame, rules: DecontaminationRules = DecontaminationRules()) -> DataFrame:
    """row_digest, row_doc, doc_id, item_id, n_windows, coverage, n_slots, consistency of each leak of items (item_id, text) in docs (doc_id, text)."""
    index = shared.written(template_index(items, rules), "templates")
    digests = index.select("folded", "digest", "item_id", F.col("at").alias("item_at"))
    keyed, keys = shared.with_keys(docs.select("doc_id", "text"))
    met = _met(keyed, keys, digests, rules) if index.count() <= rules.broadcast_windows else _met_by_shuffle(keyed, keys, digests, rules)
    seen = met.join(index.drop("digest").withColumnRenamed("at", "item_at").distinct(), ["folded", "item_id", "item_at"]).where(F.col("window") == F.col("item_window"))
    seen = seen.select(*keys, "doc_id", "folded", "item_id", "item_at", "at", "values", "item_values", "window")
    seen = shared.written(_tries(seen, [*keys, "doc_id", "item_id", "folded"]), "seen-windows")

    pair = [*keys, "doc_id", "item_id"]
    tried = [*pair, "folded", "try"]
    sizes = index.groupBy("item_id", "folded").agg(F.count_distinct("at").alias("size"))
    covered = seen.groupBy(*tried).agg(F.count_distinct("item_at").alias("n_windows")).join(sizes, ["item_id", "folded"])
    slots = (
        seen.select(*tried, "item_at", F.posexplode(F.arrays_zip("window", "values", "item_values")).alias("i", "z"))
        .where(F.col("z.window").startswith("<"))
        .select(*tried, (F.col("item_at") + F.col("i")).alias("slot"), F.col("z.values").alias("ours"), F.col("z.item_values").alias("theirs"))
        .distinct()
        .groupBy(*tried, "ours", "theirs")
        .agg(F.count("*").alias("n"))
    )

    def agreeing(by: str) -> DataFrame:
        return slots.groupBy(*tried, by).agg(F.max("n").alias("most"), F.sum("n").alias("n")).groupBy(*tried).agg(F.sum("most").alias(f"by_{by}"), F.sum("n").alias(f"n_{by}"))

    safe = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in tried]
    both = agreeing("theirs").alias("a").join(agreeing("ours").alias("b"), safe).select("a.*", F.least("by_theirs", "by_ours").alias("agree"))
    safe = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in tried]
    judged = (
        covered.alias("c")
        .join(both.alias("s"), safe, "left")
        .select(
            *[F.col(f"c.{c}").alias(c) for c in tried],
            "n_windows",
            (F.col("n_windows") / F.col("size")).alias("coverage"),
            F.coalesce("n_theirs", F.lit(0)).cast("long").alias("n_slots"),
            F.coalesce(F.col("agree") / F.col("n_theirs"), F.lit(1.0)).alias("consistency"),
        )
        .where((F.col("coverage") >= rules.coverage) & (F.col("consistency") >= rules.consistent))
    )
    rank = F.struct(~F.col("folded") & (F.col("try.kind") == 0), "coverage", "consistency", "n_windows", "n_slots")
    best = judged.groupBy(*pair).agg(F.max_by(F.struct("n_windows", "coverage", "n_slots", "consistency"), rank).alias("best"))
    return best.select(*pair, "best.*")


def without_leaks(docs: DataFrame, items: DataFrame, rules: DecontaminationRules = DecontaminationRules()) -> DataFrame:
    """The rows of docs that leak no item."""
    keyed, keys = shared.with_keys(docs)
    gone = shared.written(leaks(docs, items, rules).select(F.col("row_digest").alias(keys[0]), F.col("row_doc").alias(keys[1])).distinct(), "leaks")
    return keyed.join(gone, keys, "left_anti").select(*docs.columns)
