"""Embedding near-duplicates by spherical-cap filters: vectors of a cosine above a threshold, their links and components.

A filter is a direction; a vector belongs to the filters whose direction it exceeds a threshold with. The directions are structured
random product codes: after a random rotation the dimensions are cut into two blocks with a codebook each, and every pair of code words is
one direction, so a vector's filters are list-decoded from the few code words that can still reach the threshold. Several
independent codes are taken, since vectors that fall badly into one do not so into others, and a vector's best filter of each code always counts, so
none is without filters. The number of directions grows with the table, which keeps filters of unlike vectors at some 80 rows at any size.

Vectors meet in their filters twice. First with 24 bytes each: a random-projection sketch of 128 bits tells who has any likely partner there.
Then those alone bring their vectors, and the cosine decides, in double precision. A pair is counted in the least filter that it shares, so it counts once.
A filter of more than `block` rows is cut into blocks, and each pair of blocks is a group of its own, so a large group of near copies is
worked on by many tasks; no pairs are written, just a row for each vector with its number of links and one edge of a spanning forest.

Recall: of random pairs at a cosine of exactly 0.95 in 64 dimensions, 2,000 of 2,000 shared a filter with tables of 10,000 and 51,000 rows, 998 in 1,000 with ten
million; a sketch misses one with a chance below a millionth. What is linked is never below the threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows of a null vec_id, link with nothing (their component is
their vec_id, and they stay); equal vectors are compared once and link with each other; repeated rows are further vectors of the same id, and
where one vec_id has several vectors, their links are added up;
vectors of other lengths do not link; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import shared
from .simhash import _merge

FILTER_ROWS = 64  # vectors of a filter, were they spread evenly
SKETCH_BITS = 128


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their greatest component first, so that no square over- or underflows."""
    v = values / np.abs(values).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class ProductCodes:
    """Filters of vectors of one length. words: code words of a block; share: filters of a code that an average vector exceeds."""

    def __init__(self, length: int, codes: int, words: int, share: float, seed: int) -> None:
        rng = np.random.default_rng([seed, length])
        blocks = min(2, length)
        edges = [length * i // blocks for i in range(blocks + 1)]
        self.spans, self.words, self.size = list(zip(edges, edges[1:], strict=False)), words, words**blocks
        self.codes = []
        for _ in range(codes):
            rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
            books = [rng.standard_normal((words, b - a)) for a, b in self.spans]
            self.codes.append((rotation, [x / np.linalg.norm(x, axis=1, keepdims=True) / math.sqrt(blocks) for x in books]))
        self.sketching = rng.standard_normal((length, SKETCH_BITS))
        x = (np.arange(200_000) + 0.5) / 100_000 - 1  # how the product with a random direction is distributed
        above = np.cumsum(((1 - x * x) ** ((length - 3) / 2))[::-1])
        self.least = float(x[::-1][np.searchsorted(above, above[-1] * min(1.0, share / self.size))])

    def decode_one(self, units: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """decode() of one code."""
        rotation, books = self.codes[number]
        turned = units @ rotation
        scores = [turned[:, a:b] @ book.T for (a, b), book in zip(self.spans, books, strict=True)]
        best = [s.max(axis=1) for s in scores]
        least = np.minimum(self.least, sum(best) - 1e-9)
        row, code, total = np.arange(len(units)), np.full(len(units), number, np.int64), np.zeros(len(units))
        for k, s in enumerate(scores):
            reach = total[:, None] + s[row]
            i, word = np.nonzero(reach >= (least - sum(best[k + 1 :], np.zeros(len(units))))[row][:, None])
            row, code, total = row[i], code[i] * self.words + word, reach[i, word]
        return row, code

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose direction a row exceeds the threshold with, and of the best one of each code."""
        found = [self.decode_one(units, number) for number in range(len(self.codes))]
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def sketch(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.sketching > 0, axis=1).view(np.int64)


@lru_cache(8)
def codes_for(*parameters) -> ProductCodes:
    """A worker's codes; equal parameters give equal codes everywhere."""
    return ProductCodes(*parameters)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and float64 rows of the vectors of each length in an Arrow list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def _sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of a group's two blocks; of one block, all rows twice."""
    i, own = batch.column("i")[0].as_py(), batch.column("own").to_numpy()
    return (np.flatnonzero(own == i), np.flatnonzero(own != i)) if i != batch.column("j")[0].as_py() else (np.arange(len(own)),) * 2


def filtered(classes: DataFrame, codes: int, words: int, share: float, seed: int) -> DataFrame:
    """(filter, rep, k, s0, s1): the filters of each vector of classes (rep, k, v), with its sketch; k tells vectors of one rep apart."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reps, ks = batch.column("rep").to_numpy(), batch.column("k").to_numpy()
        for at, values in _by_length(batch.column("v")):
            units, book = unit(values), codes_for(values.shape[1], codes, words, share, seed)
            row, code = book.decode(units)
            sketch = book.sketch(units)[row]
            filters = code + (np.int64(values.shape[1]) << 46)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (filters, reps[at][row], ks[at][row], sketch[:, 0].copy(), sketch[:, 1].copy())], names=["filter", "rep", "k", "s0", "s1"])

    return shared.arrow_map(classes, work, "filter long, rep long, k long, s0 long, s1 long")


def in_blocks(rows: DataFrame, block: int, salts: int = 32) -> DataFrame:
    """rows with own, the row's block of its filter, and (i, j), a pair of blocks in which it is; a row of a filter cut into n blocks comes n times."""
    large = shared.written(rows.groupBy("filter").count().where(F.col("count") > block).select("filter", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-filters")
    if large.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("own", "i", "j")})
    salt = F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")
    repeated = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cut = rows.withColumn("salt", salt).join(repeated, ["filter", "salt"], "left").drop("salt")
    cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def likely(rows: DataFrame, cosine: float) -> DataFrame:
    """(filter, i, j, own, rep, k) of the rows of in_blocks() with another one in their group whose sketch is near enough for the cosine."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    radius = math.ceil(SKETCH_BITS * p + 6 * math.sqrt(SKETCH_BITS * p * (1 - p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared.key_groups(batches, ["filter", "i", "j"]):
            left, right = _sides(group)
            s = [group.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
            near = sum(np.bitwise_count(x[left][:, None] ^ x[right][None, :]).astype(np.uint8) for x in s) <= radius
            if left is right:
                np.fill_diagonal(near, False)
            found = np.unique(np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]]))
            if len(found):
                yield group.select(["filter", "i", "j", "own", "rep", "k"]).take(pa.array(found))

    dealt = rows.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "rep")
    return dealt.mapInArrow(run, "filter long, i int, j int, own int, rep long, k long")


def _shared(row: np.ndarray, codes: np.ndarray, left: int, right: int) -> np.ndarray:
    """Which of the first `left` rows share a filter with which of the `right` ones behind them."""
    out = np.zeros((left, right), bool)
    _, which, n = np.unique(codes, return_inverse=True, return_counts=True)
    row, column = row[n[which] > 1], (np.cumsum(n > 1) - 1)[which][n[which] > 1]
    for first in range(0, int((n > 1).sum()), 1024):
        some = (column >= first) & (column < first + 1024)
        member = np.zeros((left + right, 1024), np.float32)
        member[row[some], column[some] - first] = 1
        out |= member[:left] @ member[left:].T > 0
    return out


def without_earlier(linked: np.ndarray, code: int, book: ProductCodes, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The links of rows left with rows right that share no filter before this one. Codes are asked in order, each for what is still linked: near copies mostly share a filter of the first."""
    for number in range(code // book.size + 1):
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            break
        row, codes = book.decode_one(np.concatenate([left[rows], right[columns]]), number)
        earlier = codes < code
        linked[np.ix_(rows, columns)] &= ~_shared(row[earlier], codes[earlier], len(rows), len(columns))
    return linked


def links(likely_rows: DataFrame, classes: DataFrame, cosine: float, codes: int, words: int, share: float, seed: int) -> DataFrame:
    """(rep, other, n): the links of a vector counted in a group (n, with copies), and the root of its spanning tree there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared.key_groups(batches, ["filter", "i", "j"]):
            left, right = _sides(group)
            _, values = next(_by_length(group.column("v")))
            units = unit(values)
            linked = units[left] @ units[right].T >= cosine
            if left is right:
                np.fill_diagonal(linked, False)
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows):
                continue
            left, right, linked = left[rows], right[columns], linked[np.ix_(rows, columns)]
            book = codes_for(values.shape[1], codes, words, share, seed)
            code = group.column("filter")[0].as_py() & ((1 << 46) - 1)
            linked = without_earlier(linked, code, book, units[left], units[right])
            a, b = np.nonzero(linked)
            label = _merge(np.arange(len(units)), left[a], right[b])
            copies = group.column("copies").to_numpy()
            n = np.zeros(len(units), np.int64)
            n[left] += linked @ copies[right]
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                n[right] += linked.T @ copies[left]
            some, reps = np.flatnonzero(n), group.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(reps[label[some]]), pa.array(n[some])], names=["rep", "other", "n"])

    # one task for each pair of blocks; rows in the order of rep, so the least index is the least rep
    dealt = likely_rows.join(classes, ["rep", "k"]).repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "rep")
    return dealt.mapInArrow(run, "rep long, other long, n long")


def _digest(vector: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(vector)).alias(f"d{k}") for k in (0, 1)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, codes: int = 16, share: float = 0.5, block: int = 2048, seed: int = 12) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    given = vectors.select("vec_id", (F.col("embedding").cast("array<double>") if wide else F.col("embedding")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = given.where(usable).groupBy("v").agg(F.min(F.col("vec_id").cast("long")).alias("rep"), F.count("*").alias("copies"))
    classes = shared.written(classes.withColumn("k", F.xxhash64("v")), "vectors")
    words = max(4, math.ceil(math.sqrt(classes.count() / FILTER_ROWS)))
    rows = shared.written(filtered(classes, codes, words, share, seed), "filters")
    found = links(likely(in_blocks(rows, block), cosine), classes, cosine, codes, words, share, seed)
    found = shared.written(found, "links")
    roots = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("rep", "copies", *_digest("v")).join(counted, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = shared.written(named.select("d0", "d1", (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("root")), "named")
    out = given.select("vec_id", usable.alias("usable"), *_digest("v")).join(named.withColumn("usable", F.lit(True)), ["d0", "d1", "usable"], "left")
    component = F.coalesce("root", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
