"""Steps whose work must not grow with the square of their input, against brute force."""

import random

import pandas as pd
from pyspark.sql import functions as F

from reelspan.llm import near_dedup
from reelspan.operators import duplicates, graph, similarity
from reelspan.streaming import timed


def test_videos_of_near_hashes_are_linked_by_neighbours(spark):
    """Shapes and lengths, known and unknown, of one hash and of near ones: the components and least distances of all pairs, by few links."""
    for seed in range(4):
        r = random.Random(seed)
        shapes = set()
        for _ in range(r.choice([30, 260])):
            h, known = r.choice([0, 1, 3, 1 << 40]), r.random() < (0.6, 0.9, 0.97, 1.0)[seed]
            shapes.add((h, r.choice([1, 2, 3]) if known else r.choice([None, 0, 5]), 7 if known else None, None if r.random() < (0.1, 0.05, 0.02, 0.3)[seed] else r.randrange(900) / 2))
        rows = [(f"p{i:03d}", *x) for i, x in enumerate(sorted(shapes, key=repr))]
        r.shuffle(rows)
        near = [(a, b, (a ^ b).bit_count()) for a in (0, 1, 3, 1 << 40) for b in (0, 1, 3, 1 << 40) if a < b and (a ^ b).bit_count() <= 2]
        classes = spark.createDataFrame(rows, "first string, h long, width int, height int, duration double")
        found = duplicates.neighbour_links(classes, spark.createDataFrame(near, "ha long, hb long, distance int"))
        assert found.count() <= 8 * 4 * len(rows)  # of each row in its own hash and in three pairs

        label, pairs = {x[0]: x[0] for x in rows}, []
        for i, (a, h, w, _, d) in enumerate(rows):
            for b, g, v, _, e in rows[:i]:
                if (h ^ g).bit_count() <= 2 and not (w and v and {w, v} <= {1, 2, 3} and w != v) and (d is None or e is None or abs(d - e) <= 2.0):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if x == high else x for k, x in label.items()}
                    pairs.append((a, (h ^ g).bit_count()))
        best: dict = {}
        for a, d in pairs:
            best[label[a]] = min(d, best.get(label[a], 99))
        roots = {x.node: x.root for x in graph.connected_components(found.select("a", "b")).collect()}
        assert roots == {k: x for k, x in label.items() if x in best}
        rated: dict = {}
        for x in found.collect():
            rated[roots[x.a]] = min(x.distance, rated.get(roots[x.a], 99))
        assert rated == best


RECORDS = "media_set string, path string, digest string, visual long, video boolean, file_type string, bytes long, width int, height int, duration double, created string, modified string"


def recorded(spark, files):
    """Records of (path, hash, video, width, height, duration), without digests."""
    return spark.createDataFrame([("s", path, None, h, video, "f", 1, w, v, d, None, None) for path, h, video, w, v, d in files], RECORDS)


def test_links_of_meeting_hashes_equal_all_pairs(spark):
    """Photos and videos of dense hashes, within one bit and two: the components and least distances of all pairs."""
    for seed, bits in ((0, 2), (1, 2), (2, 2), (3, 1)):
        r = random.Random(seed)
        files = []
        for i in range(160):
            h = r.choice([0, -1, 1 << 40])
            for _ in range(r.choice([0, 1, 2, 2, 3])):
                k = r.choice([0, 1, 2, 3, 62, 63])
                h ^= 1 << k if k < 63 else -(1 << 63)
            known = r.random() < (0.6, 0.95, 0.8, 0.7)[seed]
            d = None if r.random() < (0.1, 0.02, 0.3, 0.05)[seed] else r.randrange((30, 600, 900, 200)[seed]) / 2
            files.append((f"p{i:03d}", h, i % 4 > 0, r.choice([1, 2, 3]) if known else r.choice([None, 0, 5]), 7 if known else None, d))

        label, pairs = {x[0]: x[0] for x in files}, []
        for i, (a, h, video, w, _, d) in enumerate(files):
            for b, g, other, v, _, e in files[:i]:
                apart = ((h ^ g) & (2**64 - 1)).bit_count()
                if video == other and apart <= bits and (not video or not (w and v and {w, v} <= {1, 2, 3} and w != v) and (d is None or e is None or abs(d - e) <= 2.0)):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if x == high else x for k, x in label.items()}
                    pairs.append((a, apart))
        best: dict = {}
        for a, d in pairs:
            best[label[a]] = min(d, best.get(label[a], 99))
        found = duplicates.links(recorded(spark, files), bits, bits).collect()
        roots = {x.node: x.root for x in graph.connected_components(spark.createDataFrame([(x.a, x.b) for x in found], "a string, b string")).collect()}
        assert roots == {k: x for k, x in label.items() if x in best}
        rated: dict = {}
        for x in found:
            rated[roots[x.a]] = min(x.distance, rated.get(roots[x.a], 99))
        assert rated == best and len(best) > 3


def test_links_of_a_frequent_hash_do_not_grow_with_its_neighbours(spark):
    """2,000 lengths of one hash that has thirty near ones: a length of it is not linked in every one of them, and no frame of rows ends with its group."""
    files = [(f"a{i:04d}", 0, True, 640, 480, i / 20) for i in range(2000)] + [(f"b{k:02d}", 1 << k, True, 640, 480, 50.0 + k) for k in range(30)]
    found = duplicates.links(recorded(spark, files), 2, 2)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().replace("(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")
    rows = found.collect()
    assert len(rows) <= 2 * len(files) + 30 * 200  # own ones, and those of the first and last of each two seconds
    assert {x.root for x in graph.connected_components(spark.createDataFrame([(x.a, x.b) for x in rows], "a string, b string")).collect()} == {"a0000"}


def test_hashes_are_worked_out_once(spark):
    """A hash may cost a pass over a text: each row's is worked out once, however often rows are read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(i):
        seen.add(1)
        return i // 2

    for search in (similarity.hamming_links, similarity.hamming_pairs):
        seen.value = 0
        search(spark.range(200).select("id", costly.asNondeterministic()("id").alias("h")), "id", "h", 1).count()
        assert seen.value == 200


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """Edges that are stars cost their own table and that of the minima, no round to see that nothing changes; others are joined as by brute force."""
    tables = []
    monkeypatch.setattr(graph.scratch, "written", lambda df, name, write=graph.scratch.written: (tables.append(name), write(df, name))[1])
    stars = [(100 * i, 100 * i + k) for i in range(20) for k in range(1, 12)] + [(5, 5)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(stars * 2, "a long, b long")).collect()}
    assert tables == ["edges", "least"] and got == {n: 100 * (n // 100) for a, b in stars if a != b for n in (a, b)}

    r = random.Random(5)
    nodes = r.sample(range(10_000), 400)
    edges = [(nodes[i], nodes[max(0, i - r.randrange(1, 9))]) for i in range(1, 400) if i % 40] + [(7_000_000, 7_000_001)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if x == high else x for n, x in label.items()}
    assert {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_a_pair_of_many_shards_is_compared_once(spark):
    """Near fingerprints meet in most of their shards; their sets travel once."""
    sets = spark.createDataFrame([(i, [0, 1, 3, 1 << 40][i % 4]) for i in range(8)], "set_id long, fingerprint long")
    pairs = [tuple(x) for x in near_dedup._tree_pairs(sets, 4).collect()]
    assert len(pairs) == len(set(pairs)) >= 7


class _Calls:
    """A key's state and timers that count the calls made, each a round trip of a streaming worker."""

    def __init__(self):
        self.values, self.calls, self.wakes = [], 0, []

    def getListState(self, name, schema):  # noqa: N802 (Spark's names)
        return self

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 50_000

    def registerTimer(self, at):  # noqa: N802
        self.calls, self.wakes = self.calls + 1, [*self.wakes, at]

    def appendValue(self, value):  # noqa: N802
        self.calls, self.values = self.calls + 1, [*self.values, value]

    def put(self, values):
        self.calls, self.values = self.calls + 1, list(values)

    def clear(self):
        self.put([])

    def get(self):
        self.calls += 1
        return iter(self.values)


def test_a_wake_of_a_key_is_three_calls_for_state():
    """Rows are one call and a timer; a wake reads, writes and sets its timer once, whatever waits; unknown values, open sessions and rows still to come stay as they were."""
    key, state = timed._Ordered(timed.CappedSessions(10_000_000, 3)), _Calls()
    key.init(state)
    frame = pd.DataFrame({"event_id": [4, 2, 9, 7], "at_us": [30_000_000, 20_000_000, 70_000_000, 45_000_000], "value": [None, 2.5, 1.0, None]})
    assert [len(x) for x in key.handleInputRows((1,), iter([frame[:2], frame[2:]]), state)] == [0] and state.calls == 2
    out = [tuple(x) for f in key.handleExpiredTimer((1,), state, None) for x in f.itertuples(index=False)]
    assert out == [(1, 20_000_000, 30_000_000, 2, 2.5)] and state.calls == 5
    assert state.values[0][1:] == (45_000_000, 45_000_000, 1, None) and len(state.values) == 1 and state.wakes == [20_001, 55_001]
