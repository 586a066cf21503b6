"""Tolerant as-of join: for each click the client's latest order at or before it, at most a tolerance earlier.

A click meets orders by an equi-join on the client with a time range as its second condition; the latest one is taken
by max_by, and clicks without one come back by a left join. An equi-join on the client alone would look at all pairs of a
client's clicks and orders within the tolerance, the square of its rows, so keys are made finer:

* Orders of one client and time are one point before anything is joined, the winner of the ties by max_by on a tie struct,
  with their number.
* A client's time is cut into slices as long as the tolerance (the next power of two of microseconds). Where such a slice holds
  more than `points` points it is halved until none of its parts does. The slice is the salt: clicks of a hot client are dealt over its slices.
* Orders are replicated into the slices behind them that can need them. Of the orders before a slice only the latest can be
  anyone's match there, so one carried point a slice is enough. Carried points come from a tree of slices with up
  to 2^FAN children a node: the last points go up, the latest earlier one comes down, and no group is larger than a node's children.

So a click meets at most points + 1 points whatever its client, no step gathers a client, and nothing is collected
or broadcast but the depth of the tree, one number. The lookups of a slice's depth are salted by replication too, as they have one key for a
client and slice. Slices with very many clicks at few points are left to adaptive execution's splitting, which repeats the points alike.

Defined results: a null client or time never matches, on either side; a null click_id is one click; of copies of a click_id that
differ, the latest counts (null times first), then the greatest client; equal orders are counted each; an empty side gives
no match; further columns are ignored, whatever their names. Times are whole microseconds, also before 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType
from pyspark.sql.window import Window

from . import shared

HOUR = 3_600_000_000
STEP = 4  # halvings of a slice that are tried at once
FAN = 10  # halvings between a slice and its parent in the tree
SALTS = 32  # copies of a lookup's rows


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    t = F.col(column)
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        day, second = F.unix_date(t.cast("date")).cast("long"), F.expr(f"CAST(extract(SECOND FROM `{column}`) * 1000000 AS BIGINT)")
        return (day * 24 + F.hour(t)) * HOUR + F.minute(t).cast("long") * 60_000_000 + second
    return F.unix_micros(t)


def id_digest(column: str) -> Column:
    """The unsigned crc32 of an id's decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def coarse(at: Column, digest: Column, hours: int = 1) -> Column:
    """The time, floored to a multiple of some hours where the digest is odd."""
    return F.when(digest % 2 == 1, at - F.pmod(at, F.lit(hours * HOUR))).otherwise(at)


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, ts_us), one row for each click_id of clicks (click_id, client_id, ts)."""
    rows = clicks.select("click_id", F.struct(coarse(micros(clicks, "ts"), id_digest("click_id")).alias("ts_us"), "client_id").alias("c"))
    return rows.groupBy("click_id").agg(F.max("c").alias("c")).select("click_id", "c.client_id", "c.ts_us")


def orders_of(sales: DataFrame) -> DataFrame:
    """(client_id, at_us, sale_id, priority, total_cents): each row of sales, and its second order where its digest is not divisible by 3."""
    h = id_digest("sale_id")
    first = sales.select("client_id", coarse(micros(sales, "sold_at"), h).alias("at_us"), "sale_id", "priority", F.floor(100 * F.col("total") + 0.5).alias("total_cents"), h.alias("h"))
    second = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = F.when(F.col("h") % 3 != 0, F.array(F.struct("sale_id", "priority"), second)).otherwise(F.array(F.struct("sale_id", "priority")))
    return first.select("client_id", "at_us", "total_cents", F.explode(both).alias("o")).select("client_id", "at_us", "o.sale_id", "o.priority", "total_cents")


def points_of(orders: DataFrame) -> DataFrame:
    """(client_id, at_us, p): the orders of a client and time as one point: time, the winner of the ties, their number."""
    tie = F.struct((-F.col("priority")).alias("p"), "sale_id", "total_cents")  # a null is the least
    points = orders.where("client_id is not null and at_us is not null").groupBy("client_id", "at_us")
    points = points.agg(F.max_by(F.struct("sale_id", "total_cents"), tie).alias("best"), F.count("*").alias("n_tied"))
    return points.select("client_id", "at_us", F.struct("at_us", "best.sale_id", "best.total_cents", "n_tied").alias("p"))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "left") -> DataFrame:
    """rows with the columns of table, whose keys are unique. rows are dealt by a digest of `by`, table is repeated for each salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    repeated = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def slice_depths(points: DataFrame, spans: DataFrame, bits: int, most: int) -> DataFrame:
    """(client_id, top, depth) of the slices of more than `most` points: the least number of halvings after which no part has more."""
    dense = spans.where(F.col("n") > most).select("client_id", "top")
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("at_us", bits - d).alias("slice")) for d in range(STEP, bits, STEP)])
    inside = _looked_up(points.select("client_id", "at_us", F.shiftright("at_us", bits).alias("top")), dense, ["client_id", "top"], "at_us", "inner")
    parts = inside.select("client_id", "top", F.explode(tried).alias("t")).groupBy("client_id", "top", "t").count()
    largest = parts.groupBy("client_id", "top", "t.depth").agg(F.max("count").alias("n"))
    fits = largest.groupBy("client_id", "top").agg(F.min(F.when(F.col("n") <= most, F.col("depth"))).alias("depth"))
    return fits.select("client_id", "top", F.coalesce("depth", F.lit(bits)).alias("depth"))  # a slice of one microsecond has one point


def carried(leaves: DataFrame, before: DataFrame, deepest: int) -> DataFrame:
    """(client_id, depth, slice, p): the latest point before each slice of leaves (client_id, depth, slice, last).

    before: (client_id, top, p), the latest point before a slice of the tolerance's length. Level by level, the last points of
    slices go up to their parents; then what comes before a parent goes down to its first child, and to each other child what comes before it there.
    """
    levels = [leaves.withColumn("bits", F.col("depth"))]
    while deepest > FAN * len(levels):
        up = F.greatest(F.col("bits") - FAN, F.lit(0)).alias("bits")
        parent = F.expr(f"shiftright(slice, bits - greatest(bits - {FAN}, 0))").alias("slice")
        coarser = levels[-1].where(f"bits > {FAN}").select("client_id", "depth", parent, up, "last").groupBy("client_id", "depth", "slice", "bits").agg(F.max("last").alias("last"))
        levels.append(shared.written(coarser, "slices"))
    tops = before.select("client_id", F.lit(0).alias("bits"), F.col("top").alias("slice"), F.col("p").alias("before"))
    above, out = tops, []
    for level in levels[::-1]:
        parent = F.expr(f"shiftright(slice, bits - greatest(bits - {FAN}, 0))")
        children = level.select("client_id", F.greatest(F.col("bits") - FAN, F.lit(0)).alias("up"), parent.alias("parent"), "depth", "bits", "slice", F.col("last").alias("p"))
        heads = above.select("client_id", F.col("bits").alias("up"), F.col("slice").alias("parent"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("bits"), F.lit(None).cast("long").alias("slice"), F.col("before").alias("p"))
        earlier = Window.partitionBy("client_id", "up", "parent").orderBy(F.asc_nulls_first("slice")).rowsBetween(Window.unboundedPreceding, -1)
        found = children.union(heads).withColumn("before", F.last("p", True).over(earlier)).where("depth is not null").select("client_id", "depth", "bits", "slice", "before")
        out.append(found.where("bits = depth"))
        above = found.select("client_id", "bits", "slice", "before").union(tops)
    carried = out[0]
    for more in out[1:]:
        carried = carried.union(more)
    return carried.where("before is not null").select("client_id", "depth", "slice", F.col("before").alias("p"))


def latest(clicks: DataFrame, points: DataFrame, tolerance: int, most: int = 32) -> DataFrame:
    """(click_id, client_id, ts_us, sale_id, at_us, total_cents, n_tied) of the clicks (click_id, client_id, ts_us) that have a point at or before ts_us and at most tolerance microseconds earlier.

    clicks and points are read several times, so they should be tables. most: the points of a slice.
    """
    bits = max(1, (tolerance - 1).bit_length())
    top = lambda c: F.shiftright(c, bits).alias("top")
    keys = ["client_id", "top"]
    spans = shared.written(points.groupBy("client_id", top("at_us")).agg(F.max("p").alias("last"), F.count("*").alias("n")), "spans")
    depths = shared.written(slice_depths(points, spans, bits, most), "depths")
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    at_depth = lambda c: F.expr(f"shiftright({c}, {bits} - depth)").alias("slice")
    depth = F.coalesce("depth", F.lit(0)).alias("depth")
    before = spans.select("client_id", (F.col("top") + 1).alias("top"), F.col("last").alias("p"))
    asking = _looked_up(clicks.where("client_id is not null and ts_us is not null").select("click_id", "client_id", "ts_us", top("ts_us")), depths, keys, "click_id")
    asking = asking.select("click_id", "client_id", "ts_us", depth).withColumn("slice", at_depth("ts_us"))
    offered = _looked_up(points.select("client_id", "at_us", "p", top("at_us")), depths, keys, "at_us").select("client_id", depth, "at_us", "p").withColumn("slice", at_depth("at_us")).select("client_id", "depth", "slice", "p")
    plain = before.join(depths.hint("merge"), keys, "left_anti").select("client_id", F.lit(0).alias("depth"), F.col("top").alias("slice"), "p")
    if deepest:
        asking, offered = shared.written(asking, "asking"), shared.written(offered, "offered")
        seen = asking.where("depth > 0").select("client_id", "depth", "slice").distinct()
        seen = seen.withColumn("last", F.lit(None).cast(points.schema["p"].dataType))
        leaves = offered.where("depth > 0").groupBy("client_id", "depth", "slice").agg(F.max("p").alias("last")).union(seen)
        leaves = shared.written(leaves.groupBy("client_id", "depth", "slice").agg(F.max("last").alias("last")), "slices")
        plain = plain.union(carried(leaves, before.join(depths.hint("merge"), keys, "left_semi"), deepest))
    meets = (F.col("p.at_us") <= F.col("ts_us")) & (F.col("p.at_us") >= F.col("ts_us") - tolerance)
    pairs = asking.join(offered.union(plain).hint("merge"), ["client_id", "depth", "slice"]).where(meets)
    return pairs.groupBy("click_id", "client_id", "ts_us").agg(*[F.max_by(f"p.{c}", "p.at_us").alias(c) for c in ("sale_id", "total_cents", "n_tied")], F.max("p.at_us").alias("at_us"))


def asof_matches(clicks: DataFrame, orders: DataFrame, hours: int = 240, most: int = 32) -> DataFrame:
    """One row for each distinct click of clicks (click_id, client_id, ts_us) with its match among orders (client_id, at_us, sale_id, priority, total_cents): sale_id, lag_us, total_cents, n_tied."""
    clicks, points = shared.written(clicks.select("click_id", "client_id", "ts_us"), "clicks"), shared.written(points_of(orders), "points")
    found = latest(clicks, points, hours * HOUR, most).select(F.col("click_id").alias("id"), "sale_id", F.col("at_us"), "total_cents", "n_tied")
    out = clicks.join(found.hint("merge"), F.col("click_id").eqNullSafe(F.col("id")), "left")
    return out.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("at_us")).alias("lag_us"), "total_cents", F.coalesce("n_tied", F.lit(0).cast("long")).alias("n_tied"))
