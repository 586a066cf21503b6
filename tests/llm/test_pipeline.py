"""The pipeline's stages on hostile rows, on empty tables, and against brute force."""

from collections import defaultdict
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("reelspan.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from reelspan.llm import secret_scan  # noqa: E402
from reelspan.sources import scratch  # noqa: E402

from .test_operators import DOCS, hostile, prose, table  # noqa: E402, F401

ITEM = "the quick apples and the slow pears met on a bridge over seven rivers of quiet water near the old mill"


def folder(spark, tmp_path, docs, items):
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = scratch.written(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == before
    return out


def test_hostile_rows(spark, hostile, tmp_path):  # noqa: F811
    found = stages(spark, folder(spark, tmp_path, hostile, [(1, ITEM), (None, None)]))
    ids = {name: sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) for name, rows in found.items()}
    assert ids["quality_rules"] == [-1, 1, 2, 2, 3, 7]  # null, empty and short texts go, repeated rows stay
    assert ids["near_dedup"] == [1, 7] == ids["decontamination"] == ids["secret_scan"]
    assert {r.doc_id for r in found["packing"]} == {1, 7} and sum(r.length for r in found["packing"]) == sum({r.doc_id: r.doc_tokens for r in found["packing"]}.values())
    assert next(r for r in found["secret_scan"] if r.doc_id == 7).text == next(r for r in hostile.collect() if r.doc_id == 7).text


def test_empty_tables(spark, tmp_path):
    assert all(rows == [] for rows in stages(spark, folder(spark, tmp_path, table(spark, []), [])).values())


def test_no_benchmark(spark, hostile, tmp_path):  # noqa: F811
    sf_dir = folder(spark, tmp_path, hostile, [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {1, 7}


def test_a_cluster_of_near_copies_leaves_one(spark, tmp_path):
    """Fourteen copies of one text of forty lines, a word changed in each; and fourteen pages that share a few lines, which lose these."""
    lines = [prose(9, 61_000 + k) for k in range(40)]
    rows = []
    for i in range(14):
        own = list(lines)
        own[i] = f"changed{i} " + own[i].split(" ", 1)[1]
        rows.append((i, "\n".join(own), "a"))
    common = [prose(8, 62_000 + k) for k in range(4)]
    rows += [(100 + i, "\n".join(common + [prose(9, 63_000 + 50 * i + k) for k in range(12)]), "a") for i in range(14)]
    found = stages(spark, folder(spark, tmp_path, table(spark, rows), [(1, ITEM)]))
    assert {r.doc_id for r in found["quality_rules"]} == {i for i, _, _ in rows}
    left = {r.doc_id: r.text for r in found["near_dedup"]}
    assert set(left) == {0, *range(100, 114)} and left[0] == rows[0][1]
    assert all(not set(left[i].split("\n")) & set(common) for i in range(100, 114))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def classes_of(texts):
    """The least index of the texts that each one is a near-duplicate of, directly or not."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return dict(zip(texts, label, strict=True))


def test_stages_equal_brute_force(spark, tmp_path):
    """Boilerplate lines, copies, leaks and secrets, each judged by a plain rule written anew."""
    menu = prose(11, 77_000)
    rows = [(i, prose(70, 100 + i) + "\n" + menu, "a") for i in range(14)] + [(20, menu + "\n" + prose(20, 9), "a"), (21, "\n".join([menu] * 9 + [prose(30, 10)]), "a")]
    for k in range(5):
        words = prose(150, 4000 + k).split()
        rows += [(30 + 10 * k + i, " ".join(w if j != 30 * i else f"new{i}" for j, w in enumerate(words)), "b") for i in range(4)]
    rows += [(100, prose(60, 5) + " " + ITEM, "c"), (101, ITEM.upper() + " " + prose(60, 6), "c"), (102, prose(80, 7) + " password = hunter2hunter", "c")]
    found = stages(spark, folder(spark, tmp_path, table(spark, rows), [(1, ITEM)]))

    where, cluster = defaultdict(set), classes_of([t for _, t, _ in rows])
    for _, text, host in rows:
        for line in text.split("\n"):
            where[host, line].add(cluster[text])
    kept = {}
    for i, text, host in rows:
        good = [line for line in text.split("\n") if len(where[host, line]) <= 10]
        left, n = sum(len(x.split()) for x in good), len(text.split())
        w = text.split()
        windows = defaultdict(set)
        for k in range(n - 2):
            windows[tuple(w[k : k + 3])].add(k)
        repeated = {k + d for s in windows.values() if len(s) > 1 for k in s for d in range(3)}
        if n >= 50 and 100 * len(repeated) <= 50 * n and n - left <= 0.5 * n:
            kept[i] = "\n".join(good)
    assert {r.doc_id: r.text for r in found["quality_rules"]} == kept

    sets = {i: {tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(len(w) - 4)} for i, t in kept.items()}
    label = {i: i for i in kept}
    for a, b in combinations(sorted(kept), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    assert {r.doc_id: r.text for r in found["near_dedup"]} == kept and len(set(label.values())) < len(label)

    kept = {i: t for i, t in kept.items() if ITEM not in t.lower()}
    assert {r.doc_id: r.text for r in found["decontamination"]} == kept
    ranks = secret_scan.ranked_words(public_tokenizers.path("byte_bpe_50k.json"))
    kept = {i: secret_scan.redact(t, secret_scan.find_secrets(t, ranks=ranks)) for i, t in kept.items()}
    assert {r.doc_id: r.text for r in found["secret_scan"]} == kept and "hunter2" not in kept[102]
    assert {r.doc_id for r in found["packing"]} == set(kept)


def test_intermediate_tables_are_deleted(spark):
    with scratch.released(spark):
        frame = scratch.written(spark.range(3), "for-a-while")
        path = frame.inputFiles()[0].rpartition("/")[0]
        assert scratch.path_exists(spark, path)
    assert not scratch.path_exists(spark, path)
