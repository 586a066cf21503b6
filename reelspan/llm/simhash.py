"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints of word shingles link where they differ in at most `radius` bits. The 64 bits are
cut into `blocks` blocks; two linked fingerprints agree in at least blocks - radius of them, so
each distinct fingerprint goes to one shard for every choice of that many blocks, and every link
lies inside some shard. A shard is one BK-tree: a node's children are keyed by their integer
Hamming distance to it, and a query follows only edges whose key is within the radius of its
own distance. Trees of all shards of a batch are built and searched level by level with numpy.

A shard of more than `tree_bound` fingerprints is split again: the bits outside its chosen blocks are cut into
radius + 1 parts, of which two linked fingerprints agree in at least one, so its fingerprints go to one
smaller shard for each part. As all shards grow with the corpus, this keeps their trees small at any size.
What is still above the bound (a dense ball of near copies) is dealt over several trees of that bound, and its
queries are sent to each of them along the shuffle, never through the driver, so it is worked on by many tasks. Each task reduces its links to a
spanning forest; connected components of the forests' edges give the groups.

Defined results: a null or wordless text has fingerprint 0 and links like any other; copies
share a fingerprint and hence a group; repeated rows give repeated results; a null doc_id never
names a group unless its members have no other; further columns are ignored, whatever their names; an empty
table gives an empty result. Texts are taken whole; a bit that is set in exactly half of the hashes is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import shared

BITS = 64


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of some 64-bit hashes; 0 for none."""
    n = len(hashes)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all shingles of the ASCII-lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ends = starts[width:] if len(words) >= width else [len(joined) + 1]
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts[:n], ends, strict=True)), np.uint64, n)
    return majority_bits(hashes)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """docs with its text column replaced by fingerprint (a long of the same 64 bits)."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + ", fingerprint long"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t, width, seed) for t in shared.byte_texts(batch.column(text))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints.view(np.int64))], names=[*rest, "fingerprint"])

    return shared.arrow_map(docs, work, schema)


def _spans(blocks: int) -> list[tuple[int, int]]:
    """Offset and width of each block; they cover all bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(spans: list[tuple[int, int]]) -> Column:
    """The bits of some spans of a fingerprint, side by side."""
    out = F.lit(0).cast("long")
    for offset, width in spans:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fingerprint", offset).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def shards(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(shard, rest, fingerprint): each fingerprint once for every choice of blocks - radius blocks; rest has its other bits."""
    spans = _spans(blocks)
    keys = []
    for k, chosen in enumerate(combinations(spans, blocks - radius)):
        keys.append(F.struct(F.xxhash64(F.lit(k), _bits(list(chosen))).alias("shard"), _bits([x for x in spans if x not in chosen]).alias("rest")))
    return prints.select(F.explode(F.array(*keys)).alias("k"), "fingerprint").select("k.*", "fingerprint")


def smaller_shards(hot: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(shard, fingerprint): the rows of hot (shard, rest, fingerprint) once for each of radius + 1 parts of rest."""
    width = max(BITS - sum(w for _, w in chosen) for chosen in combinations(_spans(blocks), blocks - radius))
    edges = [width * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned("rest", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return hot.select(F.explode(F.array(*[F.xxhash64("shard", F.lit(i), p) for i, p in enumerate(parts)])).alias("shard"), "fingerprint")


class Forest:
    """BK-trees of many groups at once. values: uint64, distinct in a group; groups: sorted ints."""

    def __init__(self, values: np.ndarray, groups: np.ndarray) -> None:
        self.values = values
        self.roots = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
        self.names = groups[self.roots]
        size = np.diff(np.r_[self.roots, len(groups)])
        at = np.repeat(self.roots, size)  # where each value stands on its way down
        item = np.arange(len(values))
        item, at = item[item != at], at[item != at]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted edge keys (parent * 65 + distance), children
        while len(item):
            edge = at * (BITS + 1) + np.bitwise_count(values[item] ^ values[at]).astype(np.int64)
            keys, first, which = np.unique(edge, return_index=True, return_inverse=True)
            children = item[first]
            self.levels.append((keys, children))
            at = children[which]
            item, at = item[item != at], at[item != at]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query index and node index within the radius, level by level."""
        q = np.flatnonzero(np.isin(groups, self.names))
        node = self.roots[np.searchsorted(self.names, groups[q])]
        for keys, children in [*self.levels, (None, None)]:
            distance = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield q[near], node[near]
            if keys is None or not len(q):
                return
            low = np.searchsorted(keys, node * (BITS + 1) + np.maximum(distance - radius, 0))
            high = np.searchsorted(keys, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right")
            n = high - low
            q = np.repeat(q, n)
            node = children[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs a, b into label, where label[i] is the least index known to be joined with i."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def forest_links(part: np.ndarray, prints: np.ndarray, is_node: np.ndarray, radius: int, visits: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links found by sending all fingerprints of a part through its tree.

    visits bounds the pairs that are looked at at once.
    """
    order = np.lexsort((prints, part))
    part, prints, is_node = part[order], prints[order], is_node[order]
    nodes = np.flatnonzero(is_node)
    tree = Forest(prints[nodes], part[nodes])
    _, first, size = np.unique(part[nodes], return_index=True, return_counts=True) if len(nodes) else (None, None, np.empty(0, int))
    label = np.arange(len(prints))
    if len(nodes):
        at = np.searchsorted(tree.names, part)
        cost = np.where(np.isin(part, tree.names), size[np.minimum(at, len(size) - 1)], 0)
        query = np.flatnonzero(cost + ~is_node > 1)
        turn = np.cumsum(cost[query]) // visits
        for t in np.unique(turn):
            mine = query[turn == t]
            for q, node in tree.search(prints[mine], part[mine], radius):
                label = _merge(label, mine[q], nodes[node])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, tree_bound: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect just what links within the radius connect."""
    first = shards(prints, radius, blocks)
    large = shared.written(first.groupBy("shard").count().where(F.col("count") > tree_bound).select("shard"), "large-shards")
    split = smaller_shards(first.join(large, "shard", "left_semi"), radius, blocks)
    dealt = first.join(large, "shard", "left_anti").select("shard", "fingerprint").union(split)
    hot = split.groupBy("shard").count().where(F.col("count") > tree_bound)
    hot = shared.written(hot.select("shard", F.ceil(F.col("count") / tree_bound).cast("int").alias("trees")), "hot-shards")
    trees = F.coalesce("trees", F.lit(1))
    rows = (
        dealt.join(hot, "shard", "left")
        .withColumn("own", F.pmod(F.xxhash64("fingerprint"), trees).cast("int"))
        .withColumn("tree", F.explode(F.sequence(F.lit(0), trees - 1)))
        .select("shard", "tree", "fingerprint", (F.col("own") == F.col("tree")).alias("is_node"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(columns: list[np.ndarray]) -> pa.RecordBatch:
            shard, tree, prints, is_node = columns
            _, part = np.unique(np.stack([shard, tree]), axis=1, return_inverse=True) if len(shard) else (None, shard)
            a, b = forest_links(part.reshape(-1), prints.view(np.uint64), is_node, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column("shard").to_numpy(), batch.column("tree").to_numpy().astype(np.int64), batch.column("fingerprint").to_numpy(), batch.column("is_node").to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            if not last.all():  # the last tree may go on in the next batch
                cut = int(np.argmax(last))
                yield flush([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield flush(held)

    return rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "fingerprint").mapInArrow(work, "a long, b long")


def groups(prints: DataFrame, radius: int = 4, blocks: int = 6, tree_bound: int = 4096) -> DataFrame:
    """(fingerprint, root) of all distinct fingerprints of prints that have a link."""
    distinct = shared.written(prints.select("fingerprint").distinct(), "fingerprints")
    return connected_components(links(distinct, radius, blocks, tree_bound)).select(F.col("node").alias("fingerprint"), "root")


def near_duplicates(docs: DataFrame, radius: int = 4, blocks: int = 6, width: int = 4, seed: int = 42, tree_bound: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of each row of docs (doc_id, text)."""
    prints = shared.written(fingerprints(docs.select("doc_id", "text"), width=width, seed=seed), "prints")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    rooted = least.join(groups(prints, radius, blocks, tree_bound), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = shared.written(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fingerprint", "component_id")
    named = shared.written(named, "named")  # so that the join below may split a fingerprint of very many copies
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, blocks: int = 6, width: int = 4, seed: int = 42, tree_bound: int = 4096) -> DataFrame:
    """The rows of docs without those that have an earlier (doc_id, then text digest) near-duplicate; repeated rows stay once."""
    keyed, (digest, doc) = shared.with_keys(docs)
    prints = shared.written(fingerprints(keyed.select(F.col(doc).alias("doc"), F.col(digest).alias("digest"), "text"), width=width, seed=seed), "prints")
    least = prints.groupBy("fingerprint").agg(F.min(F.struct("doc", "digest")).alias("low"))
    rooted = least.join(groups(prints, radius, blocks, tree_bound), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    stays = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.digest").alias(digest), F.col("low.doc").alias(doc))
    return keyed.join(shared.written(stays, "stays"), [digest, doc], "left_semi").dropDuplicates([digest, doc]).select(*docs.columns)
