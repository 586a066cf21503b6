"""Secret scans: fixed patterns, and password guess-cost by dynamic programming.

Base kinds are patterns (assign, access, hex). Beyond them, values in a credential context
(a credential word, then : or =, or "is") are priced: the least decimal logarithm of guesses over all
segmentations of the value into known words, dates, repeats, keyboard walks and brute-force spans.
A value of at least `min_cost` that no base span covers whole becomes a span of kind guess, beside
base spans of parts of it.

Spans are code points, end exclusive. Base spans are whole matches. Redaction puts a mark in
place of every span.

Defined results: a null text is empty and has no spans; repeated rows give repeated results; a
null doc_id stays null; further columns are kept by redacted() and ignored by scan(); an empty
table gives an empty result. Texts and values are taken whole, however long, in time about linear in
their length. Of segmentations of the same price any may be meant: only the price is used. A value of exactly
`min_cost` is a secret; a base span that only touches a value leaves it to be priced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("assign", "access", "hex", "guess")

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth|(?:api|access|private|secret)[ _-]?key)"""
    r"""["']?\x20{0,3}(?:[:=]+|\x20is)\x20{0,3}["']?([^\s"'<>]+)""",
    re.IGNORECASE | re.ASCII,
)

# Words that people often use in passwords, most common first.
WORDS = (
    "password pass admin user login welcome letmein qwerty master dragon monkey shadow sunshine princess football baseball secret love "
    "hello freedom whatever trustno superman batman summer winter spring autumn monday friday january february march april june july "
    "august september october november december test guest root access server database default change changeme example sample demo "
    "the and you one two three four five six seven eight nine ten money michael jordan charlie thomas robert daniel jessica ashley george "
    "computer internet google apple orange banana cookie cheese coffee pepper ginger flower purple yellow green blue red black white silver "
    "golden tiger lion bear wolf eagle hunter killer soccer hockey player game star wars magic happy lucky angel"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("0134578@$!", "oieastbasi")


@dataclass(frozen=True)
class GuessCosts:
    min_cost: float = 9.0  # decimal logarithm of guesses
    min_chars: int = 8
    segment: float = 0.3  # of each segment: where it ends
    date: float = 4.6  # about 110 years of days
    year: float = 2.1


def _classes(text: str) -> int:
    """Characters to choose from, by the classes in a text."""
    return max(
        1,
        26 * any("a" <= c <= "z" for c in text)
        + 26 * any("A" <= c <= "Z" for c in text)
        + 10 * any("0" <= c <= "9" for c in text)
        + 33 * any(c < "\x80" and not c.isalnum() for c in text)
        + 1000 * any(c >= "\x80" for c in text),
    )


def _neighbours() -> dict[str, set[str]]:
    """Keys beside each other or one row apart, and each key itself not."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for i, c in enumerate(row):
            beside = {row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)}
            below = {KEY_ROWS[r + d][j] for d in (-1, 1) if 0 <= r + d < len(KEY_ROWS) for j in (i - 1, i, i + 1) if 0 <= j < len(KEY_ROWS[r + d])}
            out[c] = beside | below
    return out


NEIGHBOURS = _neighbours()
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")


class Ranks(dict[str, int]):
    """The rank of each known word, and the length of the longest."""

    @cached_property
    def longest(self) -> int:
        return max(map(len, self), default=0)


@lru_cache(maxsize=4)
def ranked_words(path: str | None = None) -> Ranks:
    """The rank of each known word: passwords first, then, with a path, the whole words of a byte-level BPE vocabulary
    (a tokenizer file) in its order, which is about that of their frequency."""
    ranks = Ranks((w, i + 1) for i, w in enumerate(WORDS))
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token in sorted(vocabulary, key=vocabulary.get):
            word = token[1:].lower()
            if token[0] == "\u0120" and len(word) >= 4 and word.isascii() and word.isalpha():  # the sign is a blank
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def word_cost(value: str, i: int, j: int, low: str, plain: str, ranks: dict[str, int]) -> float | None:
    """The price of value[i:j] as a known word, perhaps in another case or with digits and signs for letters."""
    rank, extra = ranks.get(low[i:j]), 0.0
    if rank is None:
        rank, extra = ranks.get(plain[i:j]), 1.0
    if rank is None:
        return None
    return log10(rank + 1) + extra + (0.0 if value[i:j] == low[i:j] else 0.5)


def guess_cost(value: str, costs: GuessCosts = GuessCosts(), ranks: dict[str, int] | None = None) -> float:
    """The least decimal logarithm of guesses over all segmentations of a value into words, dates, repeats, walks and brute-force spans.

    cost[j] is the least for the first j characters. A brute-force span grows by one character a step, and so does a
    keyboard walk: its best start is a running minimum, as its price is linear in its length. A repeat's
    price grows with the logarithm of its length: a start that once is no better than an earlier one never is
    again, so only the starts that still may win are kept.
    """
    n = len(value)
    if not n:
        return 0.0
    ranks = RANK if ranks is None else ranks
    longest = ranks.longest if isinstance(ranks, Ranks) else max(map(len, ranks), default=0)
    low = value.lower() if value.isascii() else "".join(c.lower() if c < "\x80" else c for c in value)
    plain = low.translate(LEET)
    each = log10(_classes(value))
    infinite = float("inf")
    cost, brute = [0.0] + [infinite] * n, infinite
    ends: dict[int, list[tuple[int, float]]] = {}
    for pattern, price in ((DATE, costs.date), (YEAR, costs.year)):
        for i in range(n - 3):
            if value[i].isdigit() and (m := pattern.match(value, i)):
                ends.setdefault(m.end(), []).append((i, price))
    walk, walked = 0, infinite  # where the walk that holds the last character begins, and the least of cost[i] - 0.5 i over its starts
    repeat, repeats = 0, []  # the same of the repeat, and its starts that may win: (start, cost[start] and the price of a character)
    for j in range(1, n + 1):
        c = low[j - 1]
        if j > 1:
            if c not in NEIGHBOURS.get(low[j - 2], ()):
                walk, walked = j - 1, infinite
            if c != low[j - 2]:
                repeat, repeats = j - 1, []
        brute = min(brute, cost[j - 1] + costs.segment) + each
        best = brute
        for i in range(max(0, j - longest), j - 2):
            if (price := word_cost(value, i, j, low, plain, ranks)) is not None:
                best = min(best, cost[i] + price + costs.segment)
        for i, price in ends.get(j, ()):
            best = min(best, cost[i] + price + costs.segment)
        if (i := j - 3) >= repeat:
            repeats.append((i, cost[i] + log10(_classes(value[i]))))
            now, alive = infinite, []
            for start, price in repeats:
                total = price + log10(j - start)
                if total < now:
                    now = total
                    alive.append((start, price))
            repeats = alive
            best = min(best, now + costs.segment)
        if (i := j - 4) >= walk:  # a start key, a length and turns
            walked = min(walked, cost[i] - 0.5 * i)
            best = min(best, walked + log10(47) + 0.5 * j + costs.segment)
        cost[j] = best
    return cost[n]


def find_secrets(text: str, costs: GuessCosts = GuessCosts(), ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    k, reach = 0, 0  # base spans that begin up to a value, and how far they reach
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        value = m[1].rstrip(".,;:!?)")
        b = a + len(value)
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][1])
            k += 1
        if len(value) < costs.min_chars or b <= reach:
            continue
        if not any(c in m[0][: a - m.start()] for c in ":=") and (value.isalpha() or value.isdigit()):
            continue  # "the secret is complicated" is prose
        if guess_cost(value, costs, ranks) >= costs.min_cost:
            found.append(("guess", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


RANK = ranked_words()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, costs: GuessCosts = GuessCosts(), words: str | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each row of docs (doc_id, text). words: the file of ranked_words()."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t, costs, ranked_words(words))] if t else [] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return shared.arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digests(scanned: DataFrame) -> DataFrame:
    """The counts and the span lists as text, of each row of scan()."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    counts = [_count_of(k).alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts[:3], F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"), counts[3])


def redacted(docs: DataFrame, costs: GuessCosts = GuessCosts(), words: str | None = None) -> DataFrame:
    """docs with every secret in its text replaced by a mark, and n_chars, if there, set anew where that changed the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = [redact(t, s) if t and (s := find_secrets(t, costs, ranked_words(words))) else t for t in texts]
        columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in columns:
            chars = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, new, strict=True)]
            columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return shared.arrow_map(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
