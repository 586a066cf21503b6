"""The queries against their SQL, the kernels against brute force, sources and streams."""

import random
import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from reelspan.operators import intervals, preservation, selection, sessions, similarity
from reelspan.operators.ranking import numbered
from reelspan.plans import QUERIES, SQL
from reelspan.sources import manifests, media
from reelspan.streaming import moments


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toArrow(), duck.execute(SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    rows = [sorted((tuple(plain(r[c]) for c in columns) for r in t.to_pylist()), key=repr) for t in (ours, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plainly_selected(records, passes, limits, key):
    """The kernel's rules, one by one, without any of its shortcuts."""
    out = []
    for number, p in enumerate(passes):
        rest = [r for r in records if not p.where or r[p.where]]
        rest.sort(key=lambda r: r[key])
        for column in p.order[::-1]:
            rest.sort(key=lambda r: -r[column[1:]] if column[0] == "-" else r[column])
        n = 0
        for r in rest:
            chosen = [x for x, _ in out]
            total = sum(x["duration"] for x in chosen)
            if p.take is not None and n == p.take or p.until_seconds is not None and total >= p.until_seconds:
                break
            bad = any(x[key] == r[key] for x in chosen) or len(chosen) >= limits.most
            bad |= limits.seconds is not None and bool(chosen) and total + r["duration"] > limits.seconds + limits.slack
            bad |= not p.relaxed and any(sum(x[c] == r[c] for x in chosen) >= m for c, m in limits.caps.items())
            bad |= bool(limits.source) and any(x[limits.source] == r[limits.source] and r["start_s"] < x["end_s"] + limits.apart and x["start_s"] < r["end_s"] + limits.apart for x in chosen)
            bad |= bool(limits.similar) and any(bin((x[limits.similar] ^ r[limits.similar]) & (2**64 - 1)).count("1") <= limits.similar_bits for x in chosen)
            if not bad:
                out.append((r, number))
                n += 1
    return [(r[key], number) for r, number in out]


def test_selection_equals_plain_rules():
    r = random.Random(4)
    for _ in range(400):
        rows = [{"k": i, "score": r.randint(0, 9) / 2, "kind": r.choice("abc"), "src": r.choice("xy"), "start_s": (s := float(r.randint(0, 60))), "end_s": s + r.randint(0, 9), "must": r.random() < 0.2, "bits": r.getrandbits(6)} for i in range(30)]
        for x in rows:
            x["duration"] = x["end_s"] - x["start_s"]
        passes = [selection.Pass(r.choice([("-score",), ("start_s",), ("-score", "start_s"), ("kind", "-score")]), r.choice([None, "must"]), r.choice([None, 2, 5]), r.random() < 0.3, r.choice([None, 20.0])) for _ in range(r.randint(1, 4))]
        limits = selection.Limits(r.choice([3, 9, 99]), r.choice([None, 30.0]), r.choice([0.0, 1.0]), r.choice([{}, {"kind": 3}, {"kind": 2, "src": 4}]), r.choice([None, "src"]), r.choice([0.0, 0.25, 4.0]), r.choice([None, "bits"]), 1)
        want = plainly_selected(list(rows), passes, limits, "k")
        r.shuffle(rows)  # whatever the order of the input
        assert [(rows[i]["k"], why) for i, why in selection.select(rows, passes, limits, "k")] == want


def test_folds_equal_plain_rules():
    r = random.Random(6)
    for _ in range(300):
        rows = [{"k": i, "kind": r.choice("abcd"), "score": r.random() * 100, "duration": float(r.randint(1, 9)), "at": float(r.randint(0, 400))} for i in range(r.randint(0, 40))]
        out, gone = [], 0.0
        for x in rows:
            if x["kind"] in [y["kind"] for y in out[-3:]] and x["score"] < 92 and sum(y["duration"] for y in rows) - gone - x["duration"] >= 0.45 * sum(y["duration"] for y in rows):
                gone += x["duration"]
            else:
                out.append(x)
        assert selection.thin(rows, "kind", "score", 92.0, 0.45, 3) == out
        rows.sort(key=lambda x: x["at"])
        kept = selection.spaced(rows, "at", 25.0)
        assert all(b["at"] - a["at"] >= 25 for a, b in zip(kept, kept[1:])) and all(any(0 <= x["at"] - k["at"] < 25 for k in kept) for x in rows)


def test_groups_are_folded_whole(spark):
    rows = spark.range(20_000).select((F.col("id") % 37).alias("g"), F.col("id").alias("v"))
    got = selection.by_group(rows, ["g"], lambda group: [{"g": group[0]["g"], "n": len(group), "total": sum(x["v"] for x in group)}], "g long, n long, total long")
    want = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert selection.by_group(rows.limit(0), ["g"], lambda group: group, "g long, v long").count() == 0


def test_water_fill():
    filled = selection.water_fill({"a": 10, "b": 10, "c": 10}, {"a": 2, "b": 100, "c": 12}, {"a": 1, "b": 1, "c": 3})
    assert abs(sum(filled.values()) - 30) < 0.02 and filled["a"] == 2 and filled["c"] <= 12
    assert selection.water_fill({"a": 5}, {"a": 1}, {"a": 1}) == {"a": 1}
    r = random.Random(3)
    for _ in range(200):
        keys = "abcdef"[: r.randint(1, 6)]
        targets, room, weights = ({k: r.uniform(0, 20) for k in keys} for _ in range(3))
        got = selection.water_fill(targets, room, weights)
        assert all(got[k] <= room[k] + 1e-9 and got[k] >= min(targets[k], room[k]) - 1e-9 for k in keys)
        assert abs(sum(got.values()) - min(sum(targets.values()), sum(room.values()))) < 0.1


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0.0, 5.0), ("a", 4.0, 9.0), ("a", 9.04, 12.0), ("a", 20.0, 21.0), ("b", 0.0, 1.0)], "k string, start_s double, end_s double")
    got = {(r.k, r.start_s, r.end_s) for r in intervals.islands(rows, ["k"], 0.05).collect()}
    assert got == {("a", 0.0, 12.0), ("a", 20.0, 21.0), ("b", 0.0, 1.0)}
    for bucket in (0.7, 3.0, 100.0):  # intervals of many buckets, of some, of one
        assert intervals.overlapping(rows, rows, ["k"], bucket).count() == 7
        assert intervals.overlapping(rows, rows, ["k"], bucket, 0.5).count() == 7
        points = spark.createDataFrame([("a", 4.5), ("a", 12.0), ("a", 13.0), ("b", 0.0)], "k string, at double")
        assert sorted((r["at"], r["start_s"]) for r in intervals.contained(points, rows, ["k"], "at", bucket).select("at", "start_s").collect()) == [(0.0, 0.0), (4.5, 0.0), (4.5, 4.0), (12.0, 9.04)]
    assert intervals.subdivided(rows, F.lit(2.0)).count() == 3 + 3 + 2 + 1 + 1


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(5)]
    values = [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(12)]
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "id long, h long")
    got = {(x.a, x.b, x.distance) for x in similarity.hamming_pairs(frame, "id", "h", 7).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 7}


def test_hamming_refuses_radii_that_compare_all(spark):
    with pytest.raises(ValueError):
        similarity.block_choices(18)


def test_numbered(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert sorted((r.k, r.n) for r in numbered(rows, ["k"], "n").collect()) == [(i, i + 1) for i in range(500)]
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize("block", [1000, 3])
def test_top_cosine_equals_brute_force(spark, block):
    r = random.Random(5)
    vectors = {i: [r.gauss(0, 1) for _ in range(6)] for i in range(60)}
    frame = spark.createDataFrame([(i, v) for i, v in vectors.items()], "id long, v array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    got = {(x.a, x["rank"]): x.b for x in similarity.top_cosine(frame, frame.where("id % 7 = 0"), "id", "v", 4, block).collect()}
    assert got == {(q, k + 1): b for q in range(0, 60, 7) for k, b in enumerate(sorted((i for i in vectors if i != q), key=lambda i: -cosine(vectors[q], vectors[i]))[:4])}


def test_runtime_is_preserved_in_order(spark):
    """Against a plain loop over each media set."""
    r = random.Random(12)
    rules = preservation.SelectionRules(least=4, most=12, percent=20.0, target_ms=60_000)
    rows = [(i, r.choice("ab"), f"n{i:03d}", r.random() < 0.6, r.uniform(1, 20), *[r.uniform(30, 80) for _ in range(6)]) for i in range(80)]
    schema = "id int, media_set string, name string, video boolean, seconds double, quality double, reel double, movie double, capsule double, album double, fit double"
    got = {x.id: x.reason for x in preservation.select_scores(spark.createDataFrame(rows, schema), rules).collect()}
    for name in "ab":
        part = [dict(zip(schema.replace(",", "").split()[::2], row)) for row in rows if row[1] == name]
        for x in part:
            x["uses"] = [u for u, ok in (("album", x["album"] >= 70), ("instagram", x["reel"] >= 72), ("movie", x["movie"] >= 68), ("activity_reel", x["video"] and x["fit"] >= 60 and x["reel"] >= 72 * 0.95), ("time_capsule", x["capsule"] >= 65)) if ok]
        ranked = sorted(part, key=lambda x: (-max(x["quality"], x["reel"], x["movie"], x["capsule"]), x["name"]))
        able = [x for x in ranked if x["quality"] >= (60 if x["video"] else 65) or x["uses"]]
        want = {x["id"]: "selected for " + ",".join(x["uses"]) if x["uses"] else "selected by quality threshold" for x in able[:12]}
        for x in ranked[: max(0, min(12, max(4, round(len(part) * 0.2))) - len(able))]:
            want.setdefault(x["id"], "selected by media-set quota")
        have = sum(int(x["seconds"] * 1000) for x in part if x["id"] in want and x["video"])
        for x in sorted((x for x in part if x["video"]), key=lambda x: (-x["movie"], -x["reel"], -x["fit"], x["name"])):
            if have >= 60_000 or len(want) >= 12:
                break
            if x["id"] not in want and (x["movie"] >= 68 * 0.7 or x["reel"] >= 72 * 0.7):
                want[x["id"]] = "selected to preserve activity video runtime"
                have += int(x["seconds"] * 1000)
        assert all(got[x["id"]] == want.get(x["id"], "below configured quality and purpose thresholds") for x in part)


def test_sessions_cap(spark):
    rows = spark.createDataFrame([(1, float(i)) for i in range(95)] + [(1, 1000.0)], "u int, at double")
    got = sessions.sessionize(rows, ["u"], ["at"], F.col("at"), 300.0, 40).groupBy("session").count().collect()
    assert sorted(r["count"] for r in got) == [1, 15, 40, 40]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\x00\x00\x00"


def jpeg(width, height, date):
    text = date.encode() + b"\0"
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHII", 0x8769, 4, 1, 26) + b"\0\0\0\0" + struct.pack(">H", 1) + struct.pack(">HHII", 0x9003, 2, len(text), 44) + b"\0\0\0\0" + text
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\0\0\0" + b"\xff\xd9"


def movie(width, height, seconds):
    mvhd = struct.pack(">I4s", 108, b"mvhd") + struct.pack(">IIIII", 0, media.MAC_EPOCH + 1_700_000_000, 0, 1000, seconds * 1000) + bytes(80)
    tkhd = struct.pack(">I4s", 92, b"tkhd") + bytes(76) + struct.pack(">II", width << 16, height << 16)
    trak = struct.pack(">I4s", 8 + len(tkhd), b"trak") + tkhd
    return struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 8 + len(mvhd) + len(trak), b"moov") + mvhd + trak


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


def test_headers_anywhere_in_a_file(spark, tmp_path):
    """A movie header behind a megabyte of data, image sizes of a HEIC, dates beyond reason, stray bytes in a JPEG."""
    whole = movie(1280, 720, 7)
    late = whole[:16] + box(b"mdat", bytes(1_200_000)) + whole[16:]
    old = late.replace(struct.pack(">I", media.MAC_EPOCH + 1_700_000_000), struct.pack(">I", 5))
    sizes = b"".join(box(b"ispe", struct.pack(">III", 0, w, h)) for w, h in ((320, 240), (4032, 3024), (160, 120)))
    heic = box(b"ftyp", b"heic" + bytes(4)) + box(b"mdat", bytes(400_000)) + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", sizes)))
    photo = jpeg(640, 480, "2024:05:06 07:08:09")
    stray = photo[:2] + b"\x00\x12" + photo[2:]
    for name, data in {"late.mov": late, "old.mp4": old, "p.heic": heic, "s.jpg": stray, "n.mp4": box(b"ftyp", b"isom" + bytes(4))}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: r for r in media.scan(spark, f"file://{tmp_path}").collect()}
    assert (got["late.mov"].width, got["late.mov"].duration_seconds, got["late.mov"].capture_date_source, got["late.mov"].note) == (1280, 7.0, "metadata", None)
    assert (got["old.mp4"].duration_seconds, got["old.mp4"].capture_date_source) == (7.0, "modified")
    assert (got["p.heic"].width, got["p.heic"].height, got["s.jpg"].width, got["s.jpg"].capture_date_source) == (4032, 3024, 640, "metadata")
    assert got["n.mp4"].note == "dimensions not found; duration not found"


def test_media_scan(spark, tmp_path):
    (tmp_path / "trip").mkdir()
    for name, data in {"a.PNG": png(640, 480), "trip/b.jpg": jpeg(4000, 3000, "2024:05:06 07:08:09"), "trip/c.mp4": movie(1920, 1080, 12), "trip/d.jpg": b"\xff\xd8\xff", "e.txt": b"no", "f.png": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: r for r in media.scan(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.PNG", "trip/b.jpg", "trip/c.mp4", "trip/d.jpg", "f.png"}
    assert (got["a.PNG"].width, got["a.PNG"].height, got["a.PNG"].capture_date_source) == (640, 480, "modified")
    b, c = got["trip/b.jpg"], got["trip/c.mp4"]
    assert (b.width, b.height, b.capture_date.isoformat(), b.capture_date_source) == (4000, 3000, "2024-05-06T07:08:09", "metadata")
    assert (c.width, c.height, c.duration_seconds, c.kind) == (1920, 1080, 12.0, "video")
    assert got["f.png"].note == "unknown format"


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a, \"b\"", "4.0"), ("s2", "c", "x"), ("s2", None, "")], "media_set string, name string, n string")
    manifests.write_manifest(rows, f"file://{tmp_path}/m")
    got = manifests.read_manifest(spark, f"file://{tmp_path}/m", "media_set string, name string, n int, missing double")
    assert {(r.media_set, r.name, r.n, r.missing) for r in got.collect()} == {("s1", 'a, "b"', 4, None), ("s2", "c", None, None), ("s2", None, None, None)}
    text = "a:\n  b: 3\n  c: yes\nd: 'x'\n"
    assert manifests._plain(text) == {"a": {"b": 3, "c": True}, "d": "x"}
    assert manifests.dotted(manifests.read_config(text), "a.b") == 3 and manifests.dotted({}, "a.b", 5) == 5


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, f"2024-01-{1 + i % 20:02d} 0{i % 9}:00:00", float(i)) for i in range(60)], "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    for name, f in {"sessions": moments.session_moments, "levels": moments.tumbling_levels}.items():
        stream = f(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(rows).collect()))


def test_hamming_links_equal_brute_force(spark):
    """Copies, near copies and others, with a bound that makes most choices hot: links are counted, no pairs of copies made."""
    r = random.Random(21)
    base = [r.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(400):
        h = r.choice(base) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            h ^= 1 << r.randrange(64)
        rows.append((i, None if i % 50 == 7 else h - (1 << 64) if h >> 63 else h))
    frame = spark.createDataFrame(rows, "id long, h long")
    want = {}
    for i, h in rows:
        near = [j for j, g in rows if None not in (g, h) and j != i and ((g ^ h) & (2**64 - 1)).bit_count() <= 2]
        want[i] = (min([i, *(j for j in near if rows[j][1] == h)]), len(near))
    for hot in (similarity.HOT, 10):
        assert {x.id: (x.class_id, x.n_links) for x in similarity.hamming_links(frame, "id", "h", 2, hot).collect()} == want


def test_many_queries_meet_salted_rows(spark):
    """Three thousand queries in blocks: no task reads much more than its share, and the neighbours are those of one block."""
    r = random.Random(22)
    frame = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(3000)], "id long, v array<double>")
    asked = frame.where("id < 300")
    one, many = (sorted(map(tuple, similarity.top_cosine(frame, asked, "id", "v", 2, block, 8).collect())) for block in (1024, 40))
    assert one == many and len(one) == 600
    joined = similarity.top_cosine(frame, asked, "id", "v", 2, 40, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in joined


def test_many_hubs_are_split(spark, monkeypatch):
    from reelspan.operators import graph

    monkeypatch.setattr(graph, "HUB", 5)
    edges = [(h, 1000 * h + i) for h in range(1, 9) for i in range(40)] + [(1, 2), (5, 6)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = None
    for most in (200_000, 3):
        monkeypatch.setattr(graph, "HUBS_BROADCAST", most)
        got = sorted(map(tuple, graph.connected_components(frame).collect()))
        want = want or got
        assert got == want and {n: root for n, root in got}[2039] == 1 and len({root for _, root in got}) == 6
