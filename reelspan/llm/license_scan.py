"""License scans by a positional rare-token index, with DataFrame operations only.

Words are runs of digits, letters and non-ASCII characters of the ASCII-lower-cased text. The
document frequency of every template word is counted over the whole table. Of each file's
template words, the `rare` ones of highest inverse document frequency are looked up in the
positional postings of the templates, and so are the `votes` rarest key words of every template that can
be there, so that many licences in one file do not crowd out each other; each occurrence at word p of a template's word at q votes
for the alignment p - q. An alignment where `votes` different rare words meet (all of them, for
templates of fewer) is a hit if the template's key phrase stands there word for word; postings of templates
whose key words are not all in the file are passed over.

Base labels come from fixed phrases wherever their words stand consecutively.

The postings are a literal of the fixed templates, and the frequencies one number for each
template word, so a file is scanned in its own row and nothing is shuffled but those counts. Words
are cut once, into a table that keeps them for files that can have a hit or a base label.

Defined results: a null text has no words; repeated rows give repeated results; a null doc_id
stays null; further columns are ignored, whatever their names; an empty table gives an empty result. score is the share
of a template's words that stand at the best hit, or 0.5 for base phrases alone, or 0. Words of equal frequency are taken
in the order of the alphabet. Texts are taken whole: a very long one is one row, and only one that has all words of some
key phrase is looked at closely.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .license_texts import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"  # the same of text in lower case; Java takes many times longer over the negated class

# Phrases of the base labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


@dataclass(frozen=True)
class LicenseRules:
    rare: int = 16
    votes: int = 2


def words_of(text: Column) -> Column:
    """The words in lower case. Of letters beyond ASCII only the Kelvin sign has an ASCII lower form, k, so words are the
    same in number as with A-Z lowered alone, and so are those without a k."""
    return F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORD), 0)


def template_words() -> list[list[str]]:
    return [re.findall(WORD, text) for _, text, _ in TEMPLATES]


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def cut_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, present (template words), possible (templates whose key words are all there), and words where any use is made of them."""
    vocabulary = sorted({w for t in template_words() for w in t})
    cut = docs.select("doc_id", words_of(shared.text_of()).alias("words")).withColumn("present", F.array_intersect(_strings(vocabulary), F.col("words")))
    phrases = [sorted(set(re.findall(WORD, key))) for _, _, key in TEMPLATES]
    possible = F.array(*[F.when(F.size(F.array_intersect("present", _strings(p))) == len(p), t) for t, p in enumerate(phrases)])
    cut = cut.withColumn("possible", F.when(F.size("present") > 1, F.filter(possible, lambda t: t.isNotNull())).otherwise(F.expr("cast(array() as array<int>)")))
    used = (F.size("possible") > 0) | F.array_contains("present", "license")
    return cut.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", "possible", F.when(used, F.col("words")).otherwise(F.expr("cast(array() as array<string>)")).alias("words"))


def document_frequencies(cut: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of cut, and for each template word the rows that have it: as many numbers as the templates have words."""
    counts = cut.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    return cut.count(), {w: found.get(w, 0) for t in template_words() for w in t}


def places(words: str, anchor: str, before: list[str]) -> Column:
    """Where the words of before, and then anchor, stand consecutively: the start of each place."""
    n = len(before)
    at = F.filter(F.transform(words, lambda w, i: F.when(w == anchor, i)), lambda i: i.isNotNull() & (i >= n))
    for k, word in enumerate(before):
        at = _behind(at, words, n - k, word)
    return F.transform(at, lambda i: i - n)


def _behind(at: Column, words: str, shift: int, word: str) -> Column:
    return F.filter(at, lambda i: F.element_at(words, (i - shift + 1).cast("int")) == word)


def scan(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """doc_id, n_words, base (array of label and start), hits (array of label, start, score) of each row of docs (doc_id, text)."""
    cut = shared.written(cut_texts(docs), "license-words")
    total, frequency = document_frequencies(cut)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in frequency.items()}
    templates = template_words()
    phrases = [re.findall(WORD, key) for _, _, key in TEMPLATES]
    # template * 1000 + position, of the key phrases: a hit holds its phrase whole, so the words there give every alignment that can be one
    postings: dict[str, list[int]] = {}
    for t, (words, phrase) in enumerate(zip(templates, phrases, strict=True)):
        first = _find(words, phrase)
        for q in range(first, first + len(phrase)):
            postings.setdefault(words[q], []).append(1000 * t + q)
    none = F.expr("cast(array() as array<bigint>)")
    by_rarity = F.array_intersect(_strings(sorted(idf, key=lambda w: (-idf[w], w))), F.col("present"))  # keeps the order of the first
    anchors = F.array(*[_strings(sorted(set(p), key=lambda w: (-idf[w], w))[: rules.votes]) for p in phrases])
    own = F.flatten(F.transform("possible", lambda t: F.element_at(anchors, t + 1)))
    cut = cut.withColumn("rare", F.when(F.size("possible") > 0, F.array_union(F.slice(by_rarity, 1, rules.rare), own)))

    post = F.create_map(*[x for w, at in sorted(postings.items()) for x in (F.lit(w), F.array(*map(F.lit, at)))])
    no_postings = F.expr("cast(array() as array<int>)")
    span = 1 << 32

    def aligned(word: Column, i: Column) -> Column:
        """template * 2^32 + alignment (shifted to stay positive) of each posting of a rare word in a template whose key phrase can be there."""
        open_postings = F.filter(F.coalesce(F.try_element_at(post, word), no_postings), lambda p: F.array_contains("possible", F.floor(p / 1000).cast("int")))
        return F.when(F.array_contains("rare", word), F.transform(open_postings, lambda p: F.floor(p / 1000) * span + (i - p % 1000 + 1000).cast("long")))

    seen = F.array_distinct(F.flatten(F.filter(F.transform("words", aligned), lambda x: x.isNotNull())))
    cut = cut.withColumn("seen", F.when(F.size("possible") > 0, seen).otherwise(none))

    tables = F.array(*map(_strings, templates))
    keys = F.array(*[F.struct(F.lit(_find(words, key)).alias("at"), F.lit(len(key)).alias("n")) for words, key in zip(templates, phrases, strict=True)])
    labels = _strings([label for label, _, _ in TEMPLATES])

    def judged(a: Column) -> Column:
        t = F.floor(a / span).cast("int") + 1
        start = (a % span - 1000).cast("int")
        table, key = F.element_at(tables, t), F.element_at(keys, t)
        there = F.transform(table, lambda w, q: F.coalesce(F.try_element_at("words", F.when(start + q >= 0, start + q + 1)) == w, F.lit(False)))
        votes = F.size(F.array_intersect(F.array_distinct(F.filter(table, lambda w, q: F.element_at(there, q + 1))), F.col("rare")))
        phrase = F.forall(F.slice(there, key["at"] + 1, key["n"]), lambda x: x)
        return F.when(
            phrase & (votes >= F.least(F.lit(rules.votes), F.size(table))),
            F.struct(
                F.element_at(labels, t).alias("label"),
                F.greatest(start, F.lit(0)).cast("long").alias("start"),
                (F.size(F.filter(there, lambda x: x)) / F.size(table)).alias("score"),
            ),
        )

    base = []
    for label, phrase in BASE.items():
        *before, anchor = phrase.split()
        base.append(_labelled(places("words", anchor, before), label))
    no_base = F.expr("cast(array() as array<struct<label: string, start: bigint>>)")
    return cut.select(
        "doc_id",
        "n_words",
        F.when(F.array_contains("present", "license"), F.concat(*base)).otherwise(no_base).alias("base"),
        F.filter(F.transform("seen", judged), lambda h: h.isNotNull()).alias("hits"),
    )


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels of each row of scan()."""
    starts = F.transform("base", lambda b: b["start"])

    def label_of(x: Column) -> Column:
        return x["label"]

    base = F.array_sort(F.array_distinct(F.transform("base", label_of)))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("base", label_of), F.transform("hits", label_of))))
    best = F.array_max(F.transform("hits", lambda h: h["score"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
