"""The moment and level logic run as streams over the events, their last state written to shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seconds
from ..sources import scratch
from ..streaming import moments, stateful, timed
from .registry import Tables, query


def _streamed(t: Tables, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a transformation of the event stream gives out, each row once when its watermark has passed."""
    batch = t.events
    stream = t.spark.readStream.schema(batch.schema).parquet(f"{t.folder}/event[s].parquet")  # a pattern, as the source may be one file
    shaped = transform(stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value"))
    path = scratch.new_path(t.spark, name)

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch writes the same again

    running = shaped.writeStream.outputMode("append").option("checkpointLocation", scratch.new_path(t.spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return t.spark.read.schema(shaped.schema).parquet(path)


# The watermark, a day before the latest event; windows that end by then are given out.
_MARK = "(SELECT epoch_ms(max(ts)) - 86400000 FROM events)"


@query(f"""WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 THEN 1 ELSE 0 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM l)
SELECT user_id, count(*) AS assets, max(value) AS best, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM g GROUP BY user_id, grp HAVING epoch_us(max(ts)) + 21600000000 <= {_MARK} * 1000""")
def stream_moments(t: Tables) -> DataFrame:
    got = _streamed(t, "stream-moments", moments.session_moments)
    return got.select("user_id", "assets", "best", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"""SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2 HAVING (epoch_us(min(ts)) // 86400000000 + 1) * 86400000 <= {_MARK}""")
def stream_levels(t: Tables) -> DataFrame:
    got = _streamed(t, "stream-levels", moments.tumbling_levels)
    return got.select("user_id", F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", "peak")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS x FROM events), n AS (SELECT a.event_id, arg_min(b.event_id, {{'x': b.x, 'e': b.event_id}}) AS follower FROM e a JOIN e b ON a.user_id = b.user_id AND b.x - a.x >= 86400.0 GROUP BY 1),
k AS (SELECT arg_min(event_id, {{'x': x, 'e': event_id}}) AS event_id, user_id FROM e GROUP BY user_id UNION ALL SELECT follower, user_id FROM k JOIN n ON n.event_id = k.event_id) SELECT event_id, user_id FROM k""")
def stream_debounced(t: Tables) -> DataFrame:
    """Events that come at least a day after the last one kept, with each user's last time as the stream's state."""
    got = _streamed(t, "stream-debounced", lambda s: stateful.debounced(s.select("event_id", "user_id", seconds(F.col("ts")).alias("at")), 86_400.0))
    return got.select("event_id", "user_id")


@query(f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events WHERE epoch_us(ts) < {_MARK} * 1000),
l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM l), r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY us, event_id) - 1) // 10 AS part FROM g),
s AS (SELECT user_id, island, part, min(us) AS first_us, max(us) AS last_us, count(*) AS n, max(value) AS best FROM r GROUP BY 1, 2, 3)
SELECT user_id, first_us, last_us, n, best FROM (SELECT *, lead(first_us) OVER (PARTITION BY user_id ORDER BY island, part) AS follower FROM s) WHERE follower IS NOT NULL OR last_us + 21600000001 <= {_MARK} * 1000""")
def stream_capped_moments(t: Tables) -> DataFrame:
    """Each user's sessions by a gap of six hours and of ten rows at most, given out when they are over; what is over leaves no state."""
    timed.with_timers(t.spark)
    return _streamed(t, "stream-capped", lambda s: timed.folded(s, timed.CappedSessions(21_600_000_000, 10))).select("user_id", "first_us", "last_us", "n", "best")
