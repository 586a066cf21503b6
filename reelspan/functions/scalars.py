"""Scalar expressions that all stages share: coercions, clamps, decay, hashes, tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_float(x: Column, default: float = 0.0) -> Column:
    """A number from text; blanks and anything else become the default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def safe_int(x: Column, default: int = 0) -> Column:
    """A whole number from text such as '4.0', cut towards zero."""
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(default))


def yes_no(x: Column) -> Column:
    """The truth of a word for yes or no; null for any other."""
    word = F.lower(F.trim(x))
    return F.when(word.isin("yes", "true", "on", "1", "y"), True).when(word.isin("no", "false", "off", "0", "n"), False)


def tenths(x: Column) -> Column:
    """A number of at least zero as text with one decimal, rounded half up."""
    n = F.floor(x * 10 + 0.5)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def hash_percent(key: Column) -> Column:
    """A number in [0, 100) with two decimals that depends on the key only."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 10000) / 100


def occurrence_decay(seen: Column, lift: Column) -> Column:
    """Diversity of a source's next use after so many earlier ones; lift: roles that count a little more."""
    return clamp(78.0 - F.least(5.0 * seen, F.lit(30.0)) + F.when(lift, 6.0).otherwise(0.0), 35.0, 100.0)


def metric(text: Column, key: str) -> Column:
    """The number of key=number inside a reason text, or null."""
    return F.regexp_extract(text, rf"(?:^|[\s;,|]){key}=(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def natural_key(x: Column) -> Column:
    """A sort key that orders digit runs by value: they are padded to twenty digits."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, F.greatest(F.lit(20), F.length(p)), F.lit("0"))).otherwise(p)), "")


def sign_hash(vector: Column) -> Column:
    """64 bits of the signs of the first 64 components, the first one lowest."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.element_at(vector, i + 1) > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.element_at(bits, i + 1), i)))


LETTERS = "etaoinshrdlucmfw"


def letter_pairs() -> list[tuple[str, str]]:
    """64 different pairs of frequent letters, in a fixed order."""
    return [p for step in range(1, 8) for p in ((LETTERS[i], LETTERS[(i + step) % 16]) for i in range(16))][:64]


def letter_hash(text: Column) -> Column:
    """64 bits of a text, each whether one letter is more frequent in it than another: copies with few changes differ in few bits. A null text has 0.

    The letters are counted in one pass over the bytes of each text, as all of them are ASCII.
    """

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        codes = np.frombuffer(LETTERS.encode(), np.uint8)
        first, second = (np.array([LETTERS.index(p[k]) for p in letter_pairs()]) for k in (0, 1))
        counts = np.zeros((len(texts), len(codes)), np.int64)
        for i, t in enumerate(texts.cast(pa.large_binary())):
            if (buffer := t.as_buffer()) is not None:
                counts[i] = np.bincount(np.frombuffer(buffer, np.uint8), minlength=256)[codes]
        bits = np.packbits(counts[:, first] > counts[:, second], axis=1, bitorder="little")
        return pa.array(np.ascontiguousarray(bits).view("<i8").reshape(-1))

    return hashed(text)


def letter_hash_sql(text: str) -> str:
    """The same in SQL, as a UBIGINT."""
    n = {c: f"(length({text}) - length(replace({text}, '{c}', '')))" for c in LETTERS}
    return " | ".join(f"CASE WHEN {n[a]} > {n[b]} THEN CAST(1 AS UBIGINT) << {i} ELSE CAST(0 AS UBIGINT) END" for i, (a, b) in enumerate(letter_pairs()))
