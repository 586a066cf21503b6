"""Terms of profiles: words that stand for others, looked up in texts by a table of terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a term of a profile is looked up by
ALIASES = {
    "group_reactions": ("group", "reaction", "cheer", "laugh", "scream", "people"),
    "gopro": ("gopro", "gopr", "gx", "pov"),
    "helmet_cam": ("helmet", "helmet cam", "pov", "gopro", "gopr", "gx"),
    "rapids": ("rapid", "rapids"),
    "excitement": ("excite", "cheer", "laugh", "scream", "reaction"),
    "static": ("static", "still", "photo", "low_motion"),
    "walking": ("walk", "walking"),
    "talking": ("talk", "conversation", "briefing"),
    "water": ("water", "river", "splash"),
    "mud": ("mud", "muddy"),
    "trail": ("trail", "jungle", "path", "ride"),
    "water_crossing": ("water crossing", "water", "splash", "puddle"),
    "swimming": ("swim", "swimming", "pool", "water"),
    "pool_action": ("pool action", "pool", "swim", "splash", "jump"),
    "pool_jump": ("pool jump", "diving", "dive", "jump", "splash"),
    "diving": ("diving", "dive", "jump", "pool jump", "splash"),
    "slope": ("slope", "hill", "climb", "descent", "downhill", "uphill"),
    "tunnel": ("tunnel", "underpass", "narrow"),
    "turns": ("turn", "turns", "curve", "fast turns"),
    "speed": ("speed", "fast", "motion", "action"),
    "quad": ("quad", "atv", "ride"),
}


def needles(term: str) -> tuple[str, ...]:
    """The words of a term; one without others stands for itself, with blanks for underlines."""
    return ALIASES.get(term, (term.replace("_", " "),))


def says(text: Column, term: str) -> Column:
    """Whether a lower-case text holds a term; a null text holds none."""
    found = F.lit(False)
    for word in needles(term):
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


def glob(path: Column, pattern: str) -> Column:
    """Whether a whole path, whatever its case, is of a pattern: * stands for characters within a folder, ** for any, ? for one, [..] for one of a set, [!..] for one outside it.

    A pattern without any of these is looked for anywhere in the path. An unclosed bracket is an ordinary character.
    """
    low, out, i = pattern.lower(), "", 0
    if not any(c in low for c in "*?["):
        return F.contains(F.lower(path), F.lit(low))
    while i < len(low):
        c, close = low[i], low.find("]", i + 2)
        if c == "*":
            out += ".*" if low[i : i + 2] == "**" else "[^/]*"
            i += low[i : i + 2] == "**"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and close > 0:
            inside = low[i + 1 : close]
            out += "[" + ("^" if inside[0] == "!" else "") + inside.lstrip("!").replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^").replace("&", r"\&") + "]"
            i = close
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return F.lower(path).rlike(f"(?s)^{out}$")


def term_hits(rows: DataFrame, key: str, text: str, terms: DataFrame, block: int = 50_000) -> DataFrame:
    """(key, term) of the terms (term, needle) of which a needle stands anywhere in a row's text, whatever its case: each pair once for a row.

    Needles are numbered in blocks of a fixed number; each block is one automaton (Aho-Corasick), which is shipped with its tasks and reads a text once, however many needles it
    has. Few needles are one block; with more of them the rows are read once a block. Null and empty texts hold none; null and empty needles are left out.
    """
    import ahocorasick

    low = terms.select("term", F.lower("needle").alias("needle")).where("needle <> ''").distinct()
    blocks = max(1, -(-low.count() // block))
    dealt = low.withColumn("block", F.pmod(F.xxhash64("needle"), F.lit(blocks)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = None
    for b in range(blocks):
        automaton = ahocorasick.Automaton()
        held: dict[str, list[str]] = {}
        for r in dealt.where(F.col("block") == b).toLocalIterator():
            held.setdefault(r.needle, []).append(r.term)
        for needle, named in held.items():
            automaton.add_word(needle, tuple(named))
        automaton.make_automaton()

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, some=bool(held)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for i, words in enumerate(batch.column("words").to_pylist() if some else ()):
                    hits = {t for _, named in automaton.iter(words) for t in named} if words else set()
                    at += [i] * len(hits)
                    found += sorted(hits)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "term"])

        part = rows.select(key, F.lower(text).alias("words")).mapInArrow(run, f"`{key}` {kinds[key]}, term string")
        out = part if out is None else out.union(part)
    return out if blocks == 1 else out.distinct()


def alias_table(spark, terms: Sequence[str] = tuple(ALIASES)) -> DataFrame:
    """(term, needle) of some terms."""
    return spark.createDataFrame([(t, n) for t in terms for n in needles(t)], "term string, needle string")
