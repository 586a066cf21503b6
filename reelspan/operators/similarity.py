"""Similarity joins: exact groups, Hamming pairs by blocks, keepers."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def exact_groups(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """rows with group size, keeper (the least key of its digest) and whether the row is it."""
    sizes = rows.groupBy(digest).agg(F.count("*").alias("group_size"), F.min(key).alias("keeper"))
    return rows.join(sizes, digest).withColumn("is_keeper", F.col(key) == F.col("keeper"))


def block_choices(radius: int, spare: int = 2) -> list[int]:
    """Masks of the choices of `spare` blocks out of radius + spare: hashes within the radius agree under at least one."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(spans, spare)]
    if len(masks) >= 2 ** (64 * spare // n):
        raise ValueError(f"a radius of {radius} bits has no blocks that tell hashes apart: compare within a key instead")
    return [m - (1 << 64) if m >> 63 else m for m in masks]


HOT = 4096  # hashes of one choice of blocks and value that one task compares with each other


def _near_hashes(hashes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """(ha, hb, distance) of the pairs of different hashes (h) within the radius, ha < hb.

    The bits are cut into radius + 2 blocks, of which two must agree, so a random pair meets with a chance of
    choices / 2^(bits of two blocks): 0.6 % at radius 8, a millionth at 3. A pair is kept from its first common choice only. Where many hashes agree in a choice,
    one side is dealt over several keys and the other is repeated for each of them.
    """
    masks = block_choices(radius)
    keyed = hashes.select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value"))
    many = keyed.groupBy("choice", "value").count().where(F.col("count") > hot).select("choice", "value", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    many = scratch.written(many, "hot-blocks")
    if many.isEmpty():
        a, b = (keyed.withColumn("part", F.lit(0)).alias(x) for x in "ab")
    else:
        dealt = keyed.join(many, ["choice", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        a = dealt.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).alias("a")
        b = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    differ = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    near = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.h") < F.col("b.h")) & (F.bit_count(differ) <= radius))
    return near.where(first == F.col("a.choice")).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"), F.bit_count(differ).cast("int").alias("distance"))


def meeting_points(hashes: DataFrame) -> DataFrame:
    """(h, point, least, centre): each hash (h, different ones) and the values that it equals or that are one bit from it, where at least two hashes meet.

    Hashes within two bits meet at a value, and hashes that meet are within two bits. least is the least hash there, centre whether the value is a hash itself, which then is one bit from the others. A hash has 65 values, and at most
    65 hashes meet at one, so this grows with the hashes and not with their pairs.
    """
    flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]))
    near = hashes.select("h", flips.alias("flip")).select("h", F.col("h").bitwiseXOR(F.col("flip")).alias("point"))
    at = Window.partitionBy("point")
    met = near.withColumns({"n": F.count("*").over(at), "least": F.min("h").over(at), "centre": F.max(F.col("h") == F.col("point")).over(at)})
    return met.where("n > 1").drop("n")


def one_bit_pairs(points: DataFrame) -> DataFrame:
    """(ha, hb, distance) of all pairs of hashes that are one bit apart, ha < hb, by their meeting points."""
    return points.where("centre and h < point").select(F.col("h").alias("ha"), F.col("point").alias("hb"), F.lit(1).alias("distance"))


def star_hashes(points: DataFrame) -> DataFrame:
    """(ha, hb, distance): at each meeting point the hashes are linked with its centre, or else with the least one. The links join what all pairs within two bits do, and a component of them has a link of its least distance."""
    hub = F.when(F.col("centre"), F.col("point")).otherwise(F.col("least"))
    return points.where(F.col("h") != hub).select(F.col("h").alias("ha"), hub.alias("hb"), F.when(F.col("centre"), 1).otherwise(2).alias("distance"))


def hamming_links(rows: DataFrame, key: str, bits: str, radius: int, hot: int = HOT) -> DataFrame:
    """(key, class_id, n_links) of each row: the least key of the rows with its hash, and the number of other rows within the radius.

    Rows of one hash are one class and are never paired with each other; a null hash is a class of its own row, without links.
    """
    rows = scratch.written(rows.select(key, bits), "hashed-rows")  # read twice, and a hash may cost a pass over a text
    classes = rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("class_id"), F.count("*").alias("n"))
    classes = scratch.written(classes, "hash-classes")
    near = scratch.written(_near_hashes(classes.select("h"), radius, hot), "near-hashes")
    both = near.select(F.col("ha").alias("h"), F.col("hb").alias("other")).union(near.select(F.col("hb").alias("h"), F.col("ha").alias("other")))
    linked = both.join(classes.select(F.col("h").alias("other"), "n"), "other").groupBy("h").agg(F.sum("n").alias("links"))
    named = scratch.written(classes.join(linked, "h", "left").select("h", "class_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links")), "linked-classes")
    out = rows.select(F.col(key), F.col(bits).alias("h")).join(named, "h", "left")
    return out.select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def hamming_pairs(rows: DataFrame, key: str, bits: str, radius: int) -> DataFrame:
    """(a, b, distance) with a < b of all pairs of 64-bit hashes within the radius, equal ones too: for rows that stand for classes of equal hashes (hamming_links() counts without pairs)."""
    rows = scratch.written(rows.select(key, bits), "hashed-rows")
    hashes = scratch.written(rows.select(F.col(bits).alias("h")).distinct(), "distinct-hashes")
    near = _near_hashes(hashes, radius)
    same = hashes.select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(0).alias("distance"))
    left, right = rows.select(F.col(key).alias("ka"), F.col(bits).alias("ha")), rows.select(F.col(key).alias("kb"), F.col(bits).alias("hb"))
    pairs = near.union(same).join(left, "ha").join(right, "hb").where("distance > 0 or ka < kb")
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "distance")


def _nine_decimals(x: float) -> float:
    """Nine decimals, halves away from zero, by the shortest decimal that a double prints as."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if math.isfinite(x) else x


def _best_of(asked: pa.Table, rows: pa.Table, k: int, step: int = 256) -> tuple[list, list, list]:
    """Queries, rows and cosines of the k best rows of each query; columns (a, v) and (b, v), no null vectors. An unknown cosine (of a zero vector) counts as the greatest.

    Matrix products find what can be among the k best; these are summed again component by component, so a cosine does not depend on the block that a row is in.
    """

    def unit(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        v = np.array(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1)
        norm = np.zeros(len(v))
        for x in v.T:
            norm = norm + x * x
        with np.errstate(invalid="ignore", divide="ignore"):
            return t.column(name).to_numpy(), v / np.sqrt(norm)[:, None]

    (ask, q), (key, v) = unit(asked, "a"), unit(rows, "b")
    out: tuple[list, list, list] = ([], [], [])
    for low in range(0, len(ask), step):
        with np.errstate(invalid="ignore"):
            near = q[low : low + step] @ v.T
        near[np.isnan(near)] = np.inf
        near[ask[low : low + step, None] == key[None, :]] = -np.inf
        least = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])] - 4e-9
        for i, line in enumerate(near):
            at = np.flatnonzero((line >= least[i]) & (line > -np.inf))
            exact = np.zeros(len(at))
            with np.errstate(invalid="ignore"):
                for x, y in zip(q[low + i], v[at].T, strict=True):
                    exact = exact + x * y
            values, which = np.unique(exact, return_inverse=True)
            rounded = np.array([_nine_decimals(float(x)) for x in values])[which]
            order = np.lexsort((key[at], np.where(np.isnan(rounded), -np.inf, -rounded)))[:k]
            out[0].extend([int(ask[low + i])] * len(order))
            out[1].extend(key[at][order].tolist())
            out[2].extend(rounded[order].tolist())
    return out


def top_cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1024, salts: int = 64) -> DataFrame:
    """(a, b, rank) of the k rows of greatest cosine (nine decimals, then least key) to each query but itself: exact, against every row.

    Queries are dealt into blocks: a row goes once to each block, a block to each salt of the rows, so a task holds one block and its salt's share of the rows (16,384 at most on
    average). It compares them by matrix products. The best of each salt come first, so no query's rows meet in one task. Null vectors are like none and come last.
    """
    n, blocks = rows.count(), max(1, -(-queries.count() // block))
    salts = max(salts, -(-n // 16_384))
    kind = rows.schema[key].dataType.simpleString()
    vectors = [df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v")) for df, name in ((queries, "a"), (rows, "b"))]
    (asked, no_asked), (against, no_against) = [(v.where("v is not null"), v.where("v is null")) for v in vectors]

    def best(batch: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best_of(left, right, k) if len(left) and len(right) else ([], [], [])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "cosine": pa.array(found[2], pa.float64())})

    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = asked.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks))).withColumn("salt", every(salts))
    right = against.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts))).withColumn("block", every(blocks))
    some = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(best, "a long, b long, cosine double")
    last = no_against.orderBy("b").limit(k + 1)  # only where a query has fewer than k others
    unlike = asked.crossJoin(F.broadcast(last)).select("a", "b")
    unlike = unlike.union(no_asked.crossJoin(F.broadcast(vectors[1].select("b").orderBy("b").limit(k + 1))).select("a", "b"))
    some = some.union(unlike.where("a <> b").select("a", "b", F.lit(None).cast("double").alias("cosine")))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("cosine"), F.asc("b")))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").cast(kind), F.col("b").cast(kind), "rank")


def nearest(rows: DataFrame, other: DataFrame, on: list[str], at: str, other_at: str, payload: str) -> DataFrame:
    """rows with the payload of the row of other with equal key that is nearest in time (the earlier on ties).

    Two one-sided windows over the union: the last one before and the first one after.
    """
    left = rows.select(*on, F.col(at).alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(other.schema[payload].dataType).alias("_payload"), F.lit(None).cast("double").alias("_from"))
    right = other.select(*on, F.col(other_at).alias("_at"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(payload).alias("_payload"), F.col(other_at).cast("double").alias("_from"))
    both = left.unionByName(right)
    sample = F.when(F.col("_from").isNotNull(), F.struct("_from", "_payload"))
    back = Window.partitionBy(*on).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*on).orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumns({"_before": F.last(sample, True).over(back), "_after": F.first(sample, True).over(ahead)}).where(F.col("_row").isNotNull())
    take_before = F.col("_after").isNull() | (F.col("_at") - F.col("_before._from") <= F.col("_after._from") - F.col("_at"))
    return near.withColumn("_best", F.when(take_before, F.col("_before")).otherwise(F.col("_after"))).select("_row.*", F.col("_best._from").alias("nearest_at"), F.col("_best._payload").alias("nearest"))
