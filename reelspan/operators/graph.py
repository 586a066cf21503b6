"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is two joins with per-node minima; no neighbour list is ever gathered. A node of more than `HUB`
neighbours is dealt over several join keys, so that a large component's centre is no task of its own. Every round's
edges are written to shared storage, so a lost executor costs one round at most. A round is three shuffles of small rows (five, if the minima
can't be broadcast); it is the last one when all components are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


HUB = 200  # neighbours in one join key
HUBS_BROADCAST = 200_000  # hubs whose list is broadcast; more of them are joined in the shuffle
SALTS = 16  # join keys of a node where hubs are looked up in the shuffle


def _least(near: DataFrame) -> DataFrame:
    """(a, low, n): the least of each node a and its neighbours, and how many rows of near it has."""
    found = near.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    return scratch.written(found.select("a", F.least("a", "low").alias("low"), "n"), "least")  # read several times


def _with_least(near: DataFrame, least: DataFrame) -> DataFrame:
    """near (a, b) with low, the least of a and its neighbours."""
    least = least.select("a", "low", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    hubs = least.where("parts > 1").select("a", "parts")
    n = hubs.count()
    if not n:
        return near.join(least.drop("parts"), "a")
    if n <= HUBS_BROADCAST:
        found = near.join(F.broadcast(hubs), "a", "left")
    else:  # a hub's neighbours meet its row under several keys
        salted = near.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(1)), F.lit(SALTS)).cast("int"))
        found = salted.join(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"], "left")
    dealt = found.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    each = least.select("a", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(each, ["a", "part"]).drop("part")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(near: DataFrame, least: DataFrame) -> DataFrame:
    """near: edges in both directions. Larger neighbours move to the least of a node's neighbourhood; one row for each edge."""
    return _with_least(near, least).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: (a, b) with a > b, repeats allowed. A node and its smaller neighbours move to the least of these."""
    joined = _with_least(edges, _least(edges))
    moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    edges: columns a and b of one orderable type, in any direction, repeats and loops allowed.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.written(now, "edges")
    while not now.isEmpty():
        near = _both(now)
        least = _least(near)
        if least.where("low < a and n > 1").isEmpty():  # whoever is not the least has one neighbour, so all are stars
            break
        now = scratch.written(_small_star(_large_star(near, least)), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
