"""Capture dates that are written in many ways, as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how times are written, by the shape of the text; where a zone is written it counts, else the zone of the source
ZONED = {
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$": "yyyy-MM-dd'T'HH:mm:ssX",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{4}$": "yyyy-MM-dd'T'HH:mm:ssxx",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$": "yyyy-MM-dd'T'HH:mm:ssxxx",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4}$": "yyyy-MM-dd HH:mm:ss xx",
}
LOCAL = {
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "yyyy-MM-dd HH:mm:ss",
    r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$": "yyyy:MM:dd HH:mm:ss",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": "yyyy-MM-dd'T'HH:mm:ss",
    r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$": "dd.MM.yyyy HH:mm:ss",
    r"^\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}$": "dd MMM yyyy HH:mm",
    r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2} [AP]M$": "MM/dd/yyyy hh:mm a",
    r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$": "MM/dd/yyyy HH:mm",
    r"^(?:19|20)\d{6}$": "yyyyMMdd",
}


def instant(text: Column, zone: Column) -> Column:
    """Microseconds since 1970 of a written time, null where it is none: blanks around it do not count, plain numbers of ten and thirteen digits are seconds and milliseconds.

    A time without a zone is one of the source's zone (a null zone: UTC); of one that the clocks repeated there the first is meant. Slashes are months first.
    """
    t = F.trim(text)

    def unzoned(pattern: str) -> Column:
        return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(t, F.lit(pattern)), F.coalesce(zone, F.lit("UTC"))))

    out = F.when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1000).when(t.rlike(r"^\d{10}$"), t.try_cast("long") * 1_000_000)
    for shape, pattern in ZONED.items():
        out = out.when(t.rlike(shape), F.unix_micros(F.try_to_timestamp(t, F.lit(pattern))))
    for shape, pattern in LOCAL.items():
        out = out.when(t.rlike(shape), unzoned(pattern))
    return out
