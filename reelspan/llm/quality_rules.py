"""Quality rules with cross-document line frequency.

Every text gets its base counts, and its lines a digest of their normal form (white space folded,
ASCII lower case, digit runs as one 0). Per host, the distinct documents of each line are counted; lines
of more than `max_documents` are boilerplate and removed. A document is rejected if the base rules
fail, or if it is depleted: more than `max_removed` of its words stood on removed lines.

Exact copies are one document, whatever their number. Near copies are different documents unless classes of near-duplicates are
given: then a class is one document. Without them, lines that more than `max_documents` near copies share go like any other boilerplate, as
nothing in the lines tells a page of thirty shared lines and one of its own from a copy with one line changed.

Base: words are runs of other than ASCII white space; base_failed if n_words < 50 or more than
half of the words stand in 3-word windows that occur twice or more in the text.

Defined results: a null text has no words (and fails); a null host is a host of its own; a line counts
once a document, however often it stands there; a line of exactly `max_documents` documents stays, and so
does a document of exactly `max_removed`; repeated rows give repeated results; a null doc_id stays null;
further columns are ignored, whatever their names; an empty table gives an empty result. Texts are taken
whole: a very long one is one row and takes memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_LINES = "array<struct<line: long, words: int, rows: array<int>>>"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_documents: int = 10
    max_removed: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.translate(None, SPACES + bytes(range(0x80, 0xC0))))  # continuation bytes are no code points of their own
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACES)] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


_DIGITS = re.compile(rb"[0-9]+")


def line_digest(line: bytes) -> int:
    """64 bits (unsigned) of the normal form's MD5."""
    return int.from_bytes(md5(_DIGITS.sub(b"0", b" ".join(line.split()).lower()), usedforsecurity=False).digest()[:8], "little")


def line_table(text: bytes) -> list[tuple[int, int, list[int]]]:
    """The distinct lines with a word: digest, words, and row numbers."""
    found: dict[int, tuple[int, list[int]]] = {}
    for row, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            digest = line_digest(line)
            words, rows = found.get(digest, (0, []))
            rows.append(row)
            found[digest] = (words + n, rows)
    return [(digest, words, rows) for digest, (words, rows) in found.items()]


def _nested(tables: list[list[tuple[int, int, list[int]]]]) -> pa.Array:
    """line_table() of several texts as one Arrow column, without a Python object for each struct."""
    flat = [entry for table in tables for entry in table]
    rows = pa.ListArray.from_arrays(_offsets([e[2] for e in flat]), pa.array([r for e in flat for r in e[2]], pa.int32()))
    digests = np.fromiter((e[0] for e in flat), np.uint64, len(flat)).view(np.int64)
    struct = pa.StructArray.from_arrays([pa.array(digests), pa.array([e[1] for e in flat], pa.int32()), rows], names=["line", "words", "rows"])
    return pa.ListArray.from_arrays(_offsets(tables), struct)


def _offsets(lists: list[list]) -> pa.Array:
    return pa.array([0, *accumulate(map(len, lists))], pa.int32())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host and the two row keys of each row of docs, with its base counts and lines."""
    keyed, keys = shared.with_keys(docs, "host")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "doc_id long, host string, digest long, doc long, text_key long, " + ", ".join(f"{n} long" for n in names) + f", lines {_LINES}"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = shared.byte_texts(batch.column("text"))
        counts = zip(*map(base_counts, texts), strict=True)
        lines = _nested([line_table(t) for t in texts])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host", "digest", "doc", "text_key")), *(pa.array(c, pa.int64()) for c in counts), lines],
            names=["doc_id", "host", "digest", "doc", "text_key", *names, "lines"],
        )

    return shared.arrow_map(keyed.select(F.col("doc_id").cast("long"), "host", "text", F.col(keys[0]).alias("digest"), F.col(keys[1]).alias("doc"), text_key().alias("text_key")), work, schema)


def frequent_lines(lines: DataFrame, rules: QualityRules) -> DataFrame:
    """(host_key, line) of the boilerplate lines of lines (host_key, line), one row for each line of a distinct document."""
    return lines.groupBy("host_key", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > rules.max_documents).select("host_key", "line")


def text_key() -> Column:
    """What classes know a text by."""
    return F.xxhash64("text", F.col("text").isNull())


def verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), classes: DataFrame | None = None) -> DataFrame:
    """Each row of docs (doc_id, text, host) with keys, base counts, base_failed, removed_words, removed_rows, kept.

    classes: (text_key, label) of texts that are near-duplicates of each other; texts that are not there are classes of their own.
    """
    base = shared.written(measured(docs), "measured")
    host_key = F.xxhash64("host", F.col("host").isNull())
    lines = base.select("digest", "doc", host_key.alias("host_key"), F.explode("lines").alias("l")).select("digest", "doc", "host_key", "l.*")
    contents = base.select("digest", "text_key", host_key.alias("host_key"), "lines").dropDuplicates(["digest"])  # exact copies in a host are one document
    if classes is None:
        each = contents.select("host_key", F.explode("lines").alias("l")).select("host_key", "l.line")
    else:
        labelled = contents.join(classes.dropDuplicates(["text_key"]), "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))
        each = labelled.select("host_key", "label", F.explode("lines").alias("l")).select("host_key", "label", "l.line").distinct()
    frequent = shared.written(frequent_lines(each, rules), "frequent-lines")
    removed = (
        lines.join(frequent, ["host_key", "line"])
        .groupBy("digest", "doc", "host_key", "line")
        .agg(F.max("words").alias("words"), F.first("rows").alias("rows"))
        .groupBy("digest", "doc")
        .agg(F.sum("words").alias("removed_words"), F.flatten(F.collect_list("rows")).alias("removed_rows"))
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    removed_words = F.coalesce("removed_words", F.lit(0)).cast("long")
    return (
        base.drop("lines", "text_key")
        .join(removed, ["digest", "doc"], "left")
        .withColumns({"base_failed": failed, "removed_words": removed_words})
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= rules.max_removed * F.col("n_words")))
    )


def cleaned(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source", classes: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are kept, with boilerplate lines taken out of their texts (and n_chars, if there, set anew). classes: as for verdicts()."""
    found = verdicts(docs.select("doc_id", "text", F.col(host).alias("host")), rules, classes)
    kept = found.where("kept").select("digest", "doc", "removed_rows").groupBy("digest", "doc").agg(F.first("removed_rows").alias("removed_rows"))
    with_host = F.col(host)
    keyed, keys = shared.with_keys(docs.withColumn(tmp := shared.fresh(docs, "host"), with_host), tmp)
    gone = shared.fresh(docs, "removed_rows")
    kept = kept.select(F.col("digest").alias(keys[0]), F.col("doc").alias(keys[1]), F.col("removed_rows").alias(gone))
    lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone, i))
    joined = keyed.join(kept, keys).withColumn("text", F.when(F.col(gone).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
