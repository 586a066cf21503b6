"""Near-duplicates of a corpus: SimHash and BK-trees over shards, MinHash buckets for what is beyond their radius, and the exact Jaccard similarity of word shingles.

Two texts link where their sets of `width`-word shingles (ASCII-lower-cased words) have a Jaccard
similarity of `similarity` or more; groups are the connected components of the links.

A set's SimHash is the majority of its shingles' bits. The BK-trees of `simhash` find sets whose SimHashes differ in at most `radius` bits, and such pairs link if the exact similarity says so.
That joins texts with few changes. Two sets at similarity 0.8 differ in some ten bits, more than trees can be searched for at scale, so what the trees leave apart meets in
MinHash buckets, which are looked at where they hold several groups. A set falls
into one bucket for each of `bands` bands of `rows` least hashes: a pair of similarity s shares a
bucket with probability 1 - (1 - s^rows)^bands, 0.9998 at 0.8. Of buckets with the same members
one is looked at.

In a bucket all pairs that are not yet joined are compared. A bucket of more than `bound` sets is hot: it is
dealt over several parts, otherwise in each band, and its leader goes to every part. That joins most of what
belongs together, not all of it, so a hot bucket that is not one group by then is looked at again: its `bound` sets of
most links go to every part, which joins what varies around a common text; and if that leaves several groups, the sets
outside the largest one are compared, in blocks of `bound`, with the whole bucket. Each task
holds two blocks at most, no pair of a bucket is left out, and rows grow faster than the bucket only where the last step is needed.

Defined results: wordless and null texts are one set; a text of fewer words than `width` is one
shingle; repeated rows stay once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import shared, simhash


def shingle_set(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of all word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    ends = starts[width:] if len(words) >= width else [len(joined) + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts[:n], ends, strict=True)), np.uint64, n))


def bucket_keys(hashes: np.ndarray, bands: int = 16, rows: int = 4, seed: int = 42, step: int = 4096) -> list[int]:
    """A signed 64-bit key for each band: the digest of its least hashes."""
    if not len(hashes):
        return []
    r = np.random.default_rng(seed)
    mask, factor = r.integers(0, 1 << 64, (2, bands * rows), np.uint64)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for a in range(0, len(hashes), step):
        np.minimum(least, ((hashes[a : a + step, None] ^ mask) * (factor | np.uint64(1))).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def common_counts(sets: list[np.ndarray], asking: np.ndarray, step: int = 4096) -> np.ndarray:
    """How many hashes each asking set has in common with each set, as products of 0-1 matrices of `step` hashes."""
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    times = np.diff(np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True]))))
    several = np.repeat(times > 1, times)
    owner, column = owner[several], np.repeat(np.cumsum(times > 1) - 1, times)[several]
    out = np.zeros((len(asking), len(sets)), np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, (a, a + step))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[low:high], column[low:high] - a] = 1
        out += (has[asking] @ has.T).astype(np.int64)
    return out


def set_links(sets: list[np.ndarray], similarity: float, labels: list[int] | None = None, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of indices that join just what all pairs of the similarity join.

    Sets of one label are joined already; if asks is given, only pairs with a set that asks count.
    """
    n = len(sets)
    label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    asking = np.arange(n) if asks is None else np.flatnonzero(asks)
    if not len(asking) or not label.any():
        return []
    size = np.array([len(s) for s in sets])
    out = []
    for j, common in zip(asking.tolist(), common_counts(sets, asking), strict=True):
        near = (common > 0) & (common >= similarity * (size + size[j] - common) - 1e-9)
        for i in np.flatnonzero(near & (label != label[j])).tolist():
            if label[i] != label[j]:
                out.append((j, i))
                label[label == label[i]] = label[j]
    return out


def _signed_sets(texts: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc, digest, set_id, fingerprint and buckets of each row of texts (doc, digest, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width, seed) for t in shared.byte_texts(batch.column("text"))]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([bucket_keys(s, bands, rows, seed) for s in sets], pa.list_(pa.int64()))
        prints = np.fromiter(map(simhash.majority_bits, sets), np.uint64, len(sets)).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("digest"), pa.array(ids), pa.array(prints), keys], names=["doc", "digest", "set_id", "fingerprint", "buckets"])

    return shared.arrow_map(texts, work, "doc long, digest long, set_id long, fingerprint long, buckets array<long>")


def _distinct_sets(signed: DataFrame) -> DataFrame:
    """set_id, low (the least doc and digest that has it), fingerprint and buckets of the different sets."""
    found = signed.groupBy("set_id").agg(F.min(F.struct("doc", "digest")).alias("low"), F.first("fingerprint").alias("fingerprint"), F.first("buckets").alias("buckets"))
    return shared.written(found, "shingle-sets")


def _tree_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs of sets (a, b) whose SimHashes are equal or linked by the trees: the least set of each fingerprint stands for it."""
    least = sets.groupBy("fingerprint").agg(F.min("set_id").alias("a"))
    least = shared.written(least, "fingerprints")
    equal = sets.join(least, "fingerprint").where(F.col("a") != F.col("set_id")).select("a", F.col("set_id").alias("b"))
    found = simhash.links(least.select("fingerprint"), radius)
    linked = found.join(least.select(F.col("fingerprint").alias("x"), F.col("a").alias("set_a")), F.col("a") == F.col("x")).select("set_a", "b")
    linked = linked.join(least.select(F.col("fingerprint").alias("x"), F.col("a").alias("set_b")), F.col("b") == F.col("x")).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return shared.written(equal.union(linked).distinct(), "tree-pairs")  # a pair is linked in every shard that it shares


def _members(sets: DataFrame, bound: int) -> DataFrame:
    """(bucket, parts, lead, set_id) of the buckets of two sets and more, one of those with the same members."""
    each = sets.select("set_id", F.explode("buckets").alias("bucket"))
    shared_by = each.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("who"), F.min(F.struct(F.xxhash64("set_id", "bucket"), "set_id")).alias("lead")
    )
    big = F.col("n") > bound
    chosen = shared_by.where("n > 1").groupBy("n", "who", F.when(big, F.col("bucket")).alias("own")).agg(F.min("bucket").alias("bucket"), F.min_by("lead", "bucket").alias("lead"))
    chosen = shared.written(chosen.select("bucket", F.col("lead.set_id").alias("lead"), F.ceil(F.col("n") / bound).cast("int").alias("parts")), "buckets")
    return shared.written(each.join(chosen, "bucket"), "members")


def _hashes(wanted: DataFrame, sets: DataFrame, texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(set_id, hashes) of the sets of wanted (set_id)."""
    asked = sets.join(wanted.distinct(), "set_id", "left_semi").select("set_id", "low.doc", "low.digest")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, width, seed).tobytes() for t in shared.byte_texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(found, pa.binary())], names=["set_id", "hashes"])

    return shared.written(shared.arrow_map(texts.join(asked, ["doc", "digest"]).select("set_id", "text").dropDuplicates(["set_id"]), work, "set_id long, hashes binary"), "candidate-sets")


def _part() -> Column:
    return F.pmod(F.xxhash64("bucket", "set_id"), F.col("parts"))


def _all_parts() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)


def _links(rows: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of labels. rows: (bucket, part, set_id, label, asks); sets meet where bucket and part agree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[int, bool, np.ndarray]]) -> pa.RecordBatch:
            labels, asks, sets = (list(x) for x in zip(*held, strict=True))
            found = set_links(sets, similarity, labels, asks)
            return pa.RecordBatch.from_arrays([pa.array([labels[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list[tuple[int, bool, np.ndarray]] = []
        now = None
        for batch in batches:
            for bucket, part, label, asks, h in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "label", "asks", "hashes")), strict=True):
                if held and now != (bucket, part):
                    yield flush(held)
                    held = []
                now = (bucket, part)
                held.append((label, asks, np.frombuffer(h, np.uint64)))
        if held:
            yield flush(held)

    with_hashes = rows.join(hashes, "set_id").select("bucket", "part", "set_id", "label", "asks", "hashes")
    return shared.written(with_hashes.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "set_id").mapInArrow(work, "a long, b long"), "links")


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """labelled (label, ...) with each label replaced by the least that links join it to."""
    roots = connected_components(links).select(F.col("node").alias("label"), "root")
    return labelled.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _open(hot: DataFrame) -> DataFrame:
    """The rows of hot (bucket, label, ...) whose bucket has several labels, with main, the label of most of its rows, and rest, the number of the others."""
    sizes = hot.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
    several = sizes.agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    return shared.written(hot.join(several, "bucket"), "open-buckets")


def groups(sets: DataFrame, texts: DataFrame, similarity: float, width: int, seed: int, bound: int, radius: int) -> DataFrame:
    """(set_id, label) of each set. sets: (set_id, fingerprint, buckets, low: a doc and digest that has it); texts: (doc, digest, text)."""
    pairs = _tree_pairs(sets, radius)
    members = _members(sets, bound)
    each = F.explode(F.array("a", "b")).alias("set_id")
    hashes = _hashes(members.select("set_id").union(pairs.select(each)), sets, texts, width, seed)
    trees = _links(pairs.select(F.xxhash64("a", "b").alias("bucket"), F.lit(0).cast("long").alias("part"), each, F.lit(True).alias("asks")).withColumn("label", F.col("set_id")), hashes, similarity)
    labelled = shared.written(_relabelled(sets.select("set_id", F.col("set_id").alias("label")), trees), "tree-labels")
    apart = members.join(labelled, "set_id").groupBy("bucket").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("bucket")
    members = shared.written(members.join(apart, "bucket"), "members-apart")
    parts = F.when(F.col("set_id") == F.col("lead"), _all_parts()).otherwise(F.array(_part()))
    first = _links(members.join(labelled, "set_id").select("bucket", F.explode(parts).alias("part"), "set_id", "label", F.lit(True).alias("asks")), hashes, similarity)
    labelled = _relabelled(labelled, first)
    hot = members.where("parts > 1").select("bucket", "parts", "set_id")
    if hot.isEmpty():
        return labelled

    labelled = shared.written(labelled, "labels")
    open_ = _open(hot.join(labelled, "set_id"))
    if open_.isEmpty():
        return labelled
    links = first.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    most = Window.partitionBy("bucket").orderBy(F.coalesce("links", F.lit(0)).desc(), "set_id")  # each partition keeps `bound` rows of a bucket before the shuffle
    central = open_.join(links, "set_id", "left").withColumn("place", F.row_number().over(most)).where(F.col("place") <= bound).select("bucket", "set_id", F.lit(True).alias("central"))
    open_ = shared.written(open_.join(central, ["bucket", "set_id"], "left").withColumn("central", F.coalesce("central", F.lit(False))), "central")
    parts = F.when(F.col("central"), _all_parts()).otherwise(F.array(_part()))
    again = _links(open_.select("bucket", F.explode(parts).alias("part"), "set_id", "label", F.col("central").alias("asks")), hashes, similarity)
    labelled = shared.written(_relabelled(labelled, again), "labels")

    open_ = _open(open_.drop("main", "rest", "label").join(labelled, "set_id"))
    if open_.isEmpty():
        return labelled
    blocks = F.ceil(F.col("rest") / bound)
    block = F.pmod(F.xxhash64("set_id", F.lit(1)), blocks)
    asking = open_.where((F.col("label") != F.col("main")) & ~F.col("central")).select("bucket", "parts", "set_id", "label", block.alias("block"), F.explode(_all_parts()).alias("part"), F.lit(True).alias("asks"))
    asked = open_.select("bucket", "parts", "set_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), _part().alias("part"), F.lit(False).alias("asks"))
    rows = asking.union(asked).select("bucket", (F.col("block") * F.col("parts") + F.col("part")).alias("part"), "set_id", "label", "asks")
    return _relabelled(labelled, _links(rows, hashes, similarity))


def classes(docs: DataFrame, key: Column, similarity: float = 0.8, width: int = 5, bands: int = 16, rows: int = 4, seed: int = 42, bound: int = 256, radius: int = 4) -> DataFrame:
    """(text_key, label) of each different text of docs (doc_id, text): near-duplicates share a label. key: a digest of the text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), key.alias("digest"), "text")
    signed = shared.written(_signed_sets(texts, width, bands, rows, seed), "signed")
    sets = _distinct_sets(signed)
    labels = groups(sets, texts, similarity, width, seed, bound, radius)
    return signed.select(F.col("digest").alias("text_key"), "set_id").distinct().join(labels, "set_id").select("text_key", "label")


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 16, rows: int = 4, seed: int = 42, bound: int = 256, radius: int = 4) -> DataFrame:
    """The rows of docs without those that have an earlier (doc_id, then text digest) near-duplicate; repeated rows stay once."""
    keyed, (digest, doc) = shared.with_keys(docs)
    texts = keyed.select(F.col(doc).alias("doc"), F.col(digest).alias("digest"), "text")
    signed = _signed_sets(texts, width, bands, rows, seed)
    sets = _distinct_sets(signed)
    rooted = sets.select("set_id", "low").join(groups(sets, texts, similarity, width, seed, bound, radius), "set_id")
    stays = rooted.groupBy("label").agg(F.min("low").alias("low")).select(F.col("low.digest").alias(digest), F.col("low.doc").alias(doc))
    return keyed.join(shared.written(stays, "stays"), [digest, doc], "left_semi").dropDuplicates([digest, doc]).select(*docs.columns)
