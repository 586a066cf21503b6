"""Media sets, caches, reports, and folds over streams with late rows."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan import __main__ as cli
from reelspan import phases
from reelspan.functions import scalars
from reelspan.operators import selection
from reelspan.plans import QUERIES
from reelspan.sources import manifests, media_sets, reports
from reelspan.streaming import moments, stateful, timed

CONFIG = {"media_sets": {"rafting": {"activity": "River", "folder": "raft"}, "old": {"enabled": False}, "plain": None}}


def test_media_sets(spark, tmp_path):
    assert [m[0] for m in media_sets.media_sets(CONFIG)] == ["rafting", "plain"]
    assert [tuple(r)[:4] for r in media_sets.dimension(spark, CONFIG, True).orderBy("position").collect()] == [("rafting", "River", "default", True), ("old", "old", "default", False), ("plain", "plain", "default", True)]
    assert [(j.media_set, j.folder) for j in media_sets.inventory_jobs(CONFIG, "/t")] == [("rafting", "/t/raft"), ("plain", "/t/plain")]
    assert [j.media_set for j in media_sets.inventory_jobs(CONFIG, "/t", ["old"])] == ["old"]
    with pytest.raises(ValueError, match="nowhere"):
        media_sets.inventory_jobs(CONFIG, "/t", ["nowhere"])
    common = f"file://{tmp_path}/reels/a.csv"
    assert media_sets.scoped_path(spark, common, "rafting") == common
    (tmp_path / "reels" / "rafting").mkdir(parents=True)
    (tmp_path / "reels" / "rafting" / "a.csv").write_text("x")
    assert media_sets.scoped_path(spark, common, "rafting") == f"file://{tmp_path}/reels/rafting/a.csv"
    with pytest.raises(FileNotFoundError, match="run scoring first"):
        media_sets.require(spark, common, "scoring")


def test_cache_computes_misses_only(spark, tmp_path):
    path, asked = f"file://{tmp_path}/cache", []

    def compute(misses):
        asked.append(misses.count())
        return misses.withColumn("score", F.length("name") * 1.0)

    rows = spark.createDataFrame([(1, "a", None), (2, "bb", "x"), (3, "bb", "x"), (4, "bb", None)], "id int, name string, at string")
    for version, want in ((1, [3]), (1, [3, 0]), (2, [3, 0, 3])):
        got = media_sets.through_cache(rows, ["name", "at"], path, version, "score double", compute)
        assert sorted((r.id, r.score) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0)] and asked == want


def test_report(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 1.5).alias("score"), F.lit(2.0).alias("seconds"), (F.col("id") > 9).alias("selected"), F.lit("why").alias("reason"), (F.col("id") % 3).alias("role"))
    text = reports.selection_report(rows, "Reel", ["role"], "rendered")
    assert "| 40 | 30 | 60.0 |" in text and "| 39 | 58.5 | why |" in text and text.count("| why |") == 20 and "## By role" in text
    reports.write_text(spark, text, f"file://{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text() == text
    short = reports.selection_report(rows, "Reel", ["key"], most=4)
    assert "| 26 more | 26 | 52.0 |" in short and "more |" not in text


def test_coercions(spark):
    rows = spark.createDataFrame([("4.0", "Yes"), (" ", "off"), ("x", "perhaps"), (None, None), ("-2.9", "1")], "n string, w string")
    got = rows.select(scalars.safe_float(F.col("n"), 7.0), scalars.safe_int(F.col("n"), 7), scalars.yes_no(F.col("w")), scalars.tenths(F.lit(9.96))).collect()
    assert [tuple(r) for r in got] == [(4.0, 4, True, "10.0"), (7.0, 7, False, "10.0"), (7.0, 7, None, "10.0"), (7.0, 7, None, "10.0"), (-2.9, -2, True, "10.0")]


def streamed(spark, tmp_path, batches, schema, transform, name):
    """What a transformation gives out over micro-batches of one file each, in order."""
    source = tmp_path / f"in-{name}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")
        q = transform(stream).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out-{name}").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out-{name}").collect()]


def test_stateful_folds_equal_batch(spark, tmp_path):
    rows = [(i, i % 3, float(i * 7 % 11 + 10 * (i // 6)), "abcb"[i % 4], float(i * 37 % 100)) for i in range(60)]
    batches = [sorted(rows, key=lambda r: r[2])[a : a + 20] for a in (0, 20, 40)]
    schema = "event_id long, user_id long, at double, kind string, score double"
    got = streamed(spark, tmp_path, batches, schema, lambda s: stateful.debounced(s, 9.0), "debounced")
    again = streamed(spark, tmp_path, batches, schema, lambda s: stateful.without_repetition(s, 2, 90.0), "repetition")
    kept, other = [], []
    for u in range(3):
        mine = sorted(({"event_id": r[0], "user_id": r[1], "at": r[2], "kind": r[3], "score": r[4]} for r in rows if r[1] == u), key=lambda r: (r["at"], r["event_id"]))
        kept += [(r["event_id"], u, r["at"]) for r in selection.spaced(mine, "at", 9.0)]
        recent = []
        for r in mine:
            if r["kind"] not in recent or r["score"] >= 90:
                other.append((r["event_id"], u, r["at"]))
                recent = [*recent, r["kind"]][-2:]
    assert sorted(got) == sorted(kept) and sorted(again) == sorted(other)


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the watermark of an earlier batch changes no window that was given out; sliding windows overlap."""
    hour = lambda h, v: (1, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:30:00", float(v))
    batches = [[hour(1, 5), hour(2, 6), hour(120, 1)], [hour(1, 99), hour(121, 2)], [hour(400, 3)]]
    schema = "user_id long, text string, value double"

    def timed(f):
        return lambda s: f(s.withColumn("ts", F.to_timestamp("text")))

    got = streamed(spark, tmp_path, batches, schema, timed(lambda s: moments.tumbling_levels(s, width="1 day")), "levels")
    assert sorted((str(r[1])[:10], r[3], r[4]) for r in got) == [("2024-01-01", 2, 6.0), ("2024-01-06", 2, 2.0)]
    slid = streamed(spark, tmp_path, batches[:1] + batches[2:], schema, timed(lambda s: moments.tumbling_levels(s, width="2 hours", step="1 hour")), "sliding")
    assert sorted((str(r[1])[11:13], r[3]) for r in slid if str(r[1]).startswith("2024-01-01")) == [("00", 1), ("01", 2), ("02", 1)]
    first = streamed(spark, tmp_path, [[hour(1, 5), hour(2, 6)], [hour(2, 7), hour(3, 5)]], schema, timed(lambda s: moments.first_seen(s, "value")), "first")
    assert sorted(r[2] for r in first) == [5.0, 6.0, 7.0]


def test_phases(spark, tmp_path):
    assert phases.skip_tokens(["a, B", "", "03"]) == {"a", "b", "03"}
    assert phases.is_skipped(phases.BY_COMMAND["quality-scoring"], {"03"}) and not phases.is_skipped(phases.BY_COMMAND["reel-builder"], {"9x"})
    config = {"modules": {"story_builder": {"enabled": True}, "album_builder": {"enabled": False}}}
    tables, out = "/root/testdata/sf0.001", f"file://{tmp_path}/out"
    planned = dict(phases.run(spark, tables, out, config, skip=["inventory,2"]))
    assert planned["inventory"] == planned["duplicate-detection"] == "skipped" and planned["story-builder"] == "planned" and planned["album-builder"] == "disabled"
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="nothing"):
        phases.run(spark, tables, out, config, only=["nothing"])
    assert phases.run(spark, tables, out, config, only=["story-builder"], execute=True) == [("story-builder", "done")]
    beats = manifests.read_manifest(spark, f"{out}/05_story_builder/story_beats", "event_id long, chapter string, beat string")
    assert sorted(map(tuple, beats.collect())) == sorted(map(tuple, QUERIES["story_beats"](spark, tables).select("event_id", "chapter", "beat").collect()))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["phases"]) == 0 and "story-builder" in capsys.readouterr().out
    assert cli.main(["query", "moment_roles", "--tables", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/q"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/q").count() == QUERIES["moment_roles"](spark, "/root/testdata/sf0.001").count()
    assert cli.main(["run", "reel-builder", "--tables", "x", "--out", "y"]) == 0 and "disabled" in capsys.readouterr().out


def test_manifest_by_media_set(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s2", "c")], "media_set string, name string")
    manifests.write_manifest(rows, f"file://{tmp_path}/m", by="media_set")
    assert {r.name for r in manifests.read_manifest(spark, f"file://{tmp_path}/m/media_set=s2", "name string").collect()} == {"b", "c"}


HOUR = 3_600_000_000


def plain_sessions(times, gap, cap):
    out = []
    for at, value in times:
        if out and at - out[-1][1] <= gap and out[-1][2] < cap:
            out[-1] = (out[-1][0], at, out[-1][2] + 1, max(out[-1][3], value))
        else:
            out.append((at, at, 1, value))
    return out


@pytest.mark.parametrize("fold", [timed.Debounce(2 * HOUR), timed.CappedSessions(HOUR, 4)])
def test_timed_folds_equal_batch_and_leave_no_state(spark, tmp_path, fold):
    """Rows that come out of order within the watermark count as if in order, late ones not at all, and keys that fall idle leave nothing."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timed.with_timers(spark)
    r = random.Random(5)
    rows = [(i, i % 7, r.randrange(0, 40 * HOUR) // 1_000_000 * 1_000_000, float(r.randrange(99))) for i in range(260)]
    rows.sort(key=lambda x: x[2] + r.randrange(5 * HOUR))  # at most five hours out of order; the watermark waits a day
    late = [(1000, 1, 3 * HOUR, 999.0), (1001, 2, 0, 999.0)]
    last = [(2000, 100, 400 * HOUR, 1.0)]
    batches = [rows[:90], rows[90:200], rows[200:], [(1999, 101, 200 * HOUR, 1.0)], late, last]
    schema, source, progress = "event_id long, user_id long, at long, value double", tmp_path / "in", []
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"file://{source}/{i}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}").withColumn("ts", F.timestamp_micros("at"))
            q = timed.folded(stream, fold).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(180)
            progress.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(x) for x in spark.read.parquet(f"file://{tmp_path}/out").where("user_id < 100").collect())
    want = []
    for user in range(7):
        own = sorted((at, i, v) for i, u, at, v in rows if u == user)
        if isinstance(fold, timed.Debounce):
            kept = None
            for at, i, _ in own:
                if kept is None or at - kept >= fold.least_us:
                    want.append((user, i, at))
                    kept = at
        else:
            want += [(user, *s) for s in plain_sessions([(at, v) for at, _, v in own], fold.gap_us, fold.cap)]
    assert got == sorted(want)
    assert progress[0] >= 7 and progress[-1] < 7, progress  # of the last, still open key at most
