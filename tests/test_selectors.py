"""The selectors against plain rules, over many random groups."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspan.functions import chapters, dates, terms
from reelspan.operators import duplicates, lookup, offers, repetition, selection, selectors, sessions

TAGS = ("water", "speed_action", "face_visible", "lit_tunnel", "scenic", "pool", "action_camera_pov", "water_crossing")


class Plain:
    """Takes rows one by one; every rule looks at all that was taken."""

    def __init__(self):
        self.rows, self.turns = [], []

    def has(self, r):
        return any(x["key"] == r["key"] for x in self.rows)

    def seconds(self, where=lambda x: True):
        return sum(x["seconds"] for x in self.rows if where(x))

    def count(self, where):
        return sum(map(where, self.rows))

    def overlaps(self, r, gap=0.25):
        return any(x["source"] == r["source"] and r["start"] < x["end"] + gap and x["start"] < r["end"] + gap for x in self.rows)

    def take(self, r, turn):
        self.rows.append(r)
        self.turns.append(turn)
        return True


def by_order(rows, *keys):
    """Rows in ascending order of the keys, missing ones last, then by key."""
    flat = lambda r: [y for k in keys for v in [k(r)] for y in ((v is None), 0 if v is None else v)]
    return sorted(rows, key=lambda r: (*flat(r), r["key"]))


def compared(spark, schema, groups, run, plain):
    rows = [r for group in groups for r in group]
    frame = spark.createDataFrame([tuple(r.get(f.split()[0].strip("`")) for f in schema.split(", ")) for r in rows], schema)
    found = defaultdict(list)
    for x in run(frame).collect():
        found[x.g].append((x.pick, x.key, x.turn))
    for group in groups:
        expected = plain(group)
        assert [(k, t) for _, k, t in sorted(found[group[0]["g"]])] == [(r["key"], t) for r, t in zip(expected.rows, expected.turns, strict=True)], group[0]["g"]


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def alike(r, x, further):
    if r["media_set"] != x["media_set"]:
        return False
    close = r["at"] is not None and x["at"] is not None and abs(r["at"] - x["at"]) <= 900
    if r["visual"] and x["visual"] and (distance(r["visual"], x["visual"]) <= 24 or close and distance(r["visual"], x["visual"]) <= 54):
        return True
    if further and close and all(r[c] and x[c] for c in further):
        d = [distance(r[c], x[c]) for c in further]
        return d[1] <= 26 and d[2] <= 26 or d[0] <= 26 and d[3] <= 2
    return False


def photos(r, g, n):
    base = [r.getrandbits(256) for _ in range(4)]
    small = [r.getrandbits(64) for _ in range(4)]

    def near(h, width, most):
        for _ in range(r.randrange(most)):
            h ^= 1 << r.randrange(width)
        return f"{h:x}"

    out = []
    for i in range(n):
        out.append({
            "g": g, "key": i, "media_set": r.randrange(2), "visual": r.choice([None, "", *[near(r.choice(base), 256, 60) for _ in range(6)]]), "p": near(small[0], 64, 40), "w": near(small[1], 64, 40), "a": near(small[2], 64, 40), "c": near(small[3], 64, 6),
            "at": r.choice([None, *[float(r.randrange(8000)) for _ in range(8)]]), "moment": r.randrange(5), "important": r.random() < 0.3, "final": float(r.randrange(8)), "variant": float(r.randrange(8)), "before": r.choice([None, True, False, False]), "seconds": 1.0,
        })
    return out


PHOTO = "g long, key long, media_set long, visual string, p string, w string, a string, c string, at double, moment long, important boolean, final double, variant double, before boolean"


@pytest.mark.parametrize("most", [12, 10_000])
def test_all_good_album(spark, most):
    r = random.Random(most)
    groups = [photos(r, g, r.randrange(1, 40)) for g in range(250)]
    size = selectors.Album("enhanced", 5, 9, most, all_good=True, overlap=0.25)
    further = ("p", "w", "a", "c")

    def plain(group):
        out, limit = Plain(), int(most * 0.25) if most < 10_000 else int(len(group) * 0.25)
        for x in by_order(group, lambda x: x["at"], lambda x: -x["variant"]):
            if len(out.rows) < most and not (x["before"] and out.count(lambda y: bool(y["before"])) >= limit) and not any(alike(x, y, further) for y in out.rows):
                out.take(x, 0)
        return out

    compared(spark, PHOTO, groups, lambda f: selectors.album(f, ["g"], "key", size, selectors.photo_likeness(further=further), [F.col("at"), -F.col("variant")]), plain)


def test_target_album(spark):
    r = random.Random(2)
    groups = [photos(r, g, r.randrange(1, 60)) for g in range(250)]
    size = selectors.Album("small", 9, 7, 30, per_important=2, per_moment=3, moment_share=0.15, per_minute=1)

    def plain(group):
        out = Plain()

        def add(x, turn, caps=True):
            same = lambda y: y["at"] is not None and x["at"] is not None and y["at"] // 60 == x["at"] // 60
            if out.has(x) or any(alike(x, y, ()) for y in out.rows) or caps and (out.count(lambda y: y["moment"] == x["moment"]) >= min(3, int(30 * 0.15)) or out.count(same) >= 1):
                return
            out.take(x, turn)

        for moment in range(5):
            for x in by_order([x for x in group if x["important"] and x["moment"] == moment], lambda x: -x["final"])[:2]:
                add(x, 0)
        for x in by_order([x for x in group if not x["before"]], lambda x: -x["variant"], lambda x: x["at"]):
            if len(out.rows) < 7:
                add(x, 1)
        for x in by_order(group, lambda x: -x["final"], lambda x: x["at"]):
            if len(out.rows) < 9:
                add(x, 2, False)
        return out

    compared(spark, PHOTO, groups, lambda f: selectors.album(f, ["g"], "key", size, selectors.photo_likeness(), [F.col("at")]), plain)


def test_albums_know_those_before_them(spark):
    r = random.Random(4)
    rows = [x | {"before": None} for g in range(30) for x in photos(r, g, 40)]
    frame = spark.createDataFrame([tuple(x[f.split()[0]] for f in PHOTO.split(", ")) for x in rows], PHOTO).drop("before")
    sizes = (selectors.Album("small", 2, 4, 6), selectors.Album("large", 2, 6, 8, apart_from=("small",)), selectors.Album("all", 1, 1, 12, all_good=True, overlap=0.1, apart_from=("small", "large")))
    found = defaultdict(set)
    for x in selectors.albums(frame, ["g"], "key", sizes, selectors.photo_likeness(), [F.col("at")]).collect():
        found[x.album, x.g].add((x.key, x.turn))
    for g in range(30):
        small, large, every = ({k for k, _ in found[n, g]} for n in ("small", "large", "all"))
        assert not {k for k, t in found["large", g] if t == 1} & small and len(every & (small | large)) <= 1 and small


def segments(r, g, n):
    out = []
    for i in range(n):
        start = round(r.uniform(0, 80), 1)
        seconds = r.choice([1.0, 2.5, 4.0])
        source = r.randrange(5)
        tags = [t for t in TAGS if r.random() < 0.25]
        out.append({
            "g": g, "key": i, "source": source, "source_order": 10 - source, "start": start, "end": start + seconds, "seconds": seconds, "bucket": r.choice(["opening", "middle", "middle", "ending"]), "moment": r.randrange(6), "moment_type": r.choice(["a", "b", "c"]), "role": r.choice(["hook", "action", "group_action", "closing", "scenic", "reaction"]),
            "tags": r.choice([None, tags, tags, tags]), "story_order": r.randrange(4), "weak_opening": r.random() < 0.4, "opening_rank": r.randrange(4), "activity": float(r.randrange(5)), "final": float(r.choice([30, 41, 42, 60, 88])), "memory": float(r.randrange(5)), "confidence": float(r.randrange(5)), "score": float(r.randrange(9)),
            "strong": r.random() < 0.6 and g % 7 > 0, "memorable": r.random() < 0.3, "late": r.random() < 0.15, "source_seconds": r.choice([0.0, 60.0, 100.0]), "pays": r.random() < 0.3 and g % 5 > 0, "payoff": float(r.randrange(6)), "price": seconds / 2, "anchor_price": seconds,
        })
    return out


SEGMENT = "g long, key long, source long, source_order long, start double, end double, seconds double, bucket string, moment long, moment_type string, role string, tags array<string>, story_order long, weak_opening boolean, opening_rank long, activity double, final double, memory double, confidence double, score double, strong boolean, memorable boolean, late boolean, source_seconds double, pays boolean, payoff double, price double, anchor_price double"


def tagged(x, tag):
    return tag in (x["tags"] or ())


def test_reel(spark):
    r = random.Random(5)
    groups = [segments(r, g, r.randrange(1, 70)) for g in range(250)]
    plan = selectors.Reel(target=24.0, most=12, least=4, opening=4.0, ending=5.0, required_types=("b", "c"), required_tags=("lit_tunnel", "water"))

    def plain(group):
        out = Plain()
        bucket = lambda b: out.seconds(lambda y: y["bucket"] == b)
        limits = {**selectors.ROLE_LIMITS, "action": 12}

        def add(x, turn, relaxed=False, budgets=True):
            if out.has(x) or out.overlaps(x) or len(out.rows) >= 12:
                return False
            if budgets and (x["bucket"] == "opening" and bucket("opening") + x["seconds"] > 4.75 or x["bucket"] == "ending" and bucket("ending") + x["seconds"] > 5.75):
                return False
            if not relaxed and out.count(lambda y: y["moment"] == x["moment"]) >= 2 or out.count(lambda y: y["source"] == x["source"]) >= 3 or out.count(lambda y: y["role"] == x["role"]) >= limits.get(x["role"], 12):
                return False
            return not (out.seconds() + x["seconds"] > 25.0 and len(out.rows) >= 4) and out.take(x, turn)

        of = lambda b: [x for x in group if x["bucket"] == b]
        for x in by_order(of("opening"), lambda x: x["opening_rank"], lambda x: -x["activity"], lambda x: -x["final"], lambda x: x["story_order"], lambda x: x["start"]):
            if bucket("opening") >= 4.0 or len(out.rows) >= 2:
                break
            if not (bucket("opening") > 0 and x["weak_opening"]):
                add(x, 0)
        for x in by_order([x for x in group if x["role"] == "group_action"], lambda x: -x["final"]):
            if add(x, 1, relaxed=True):
                break
        for turn, kind in enumerate(("b", "c"), 2):
            for x in by_order([x for x in of("middle") if x["moment_type"] == kind], lambda x: -x["activity"], lambda x: -x["final"])[:1]:
                add(x, turn, budgets=False)
        for turn, tag in enumerate(("lit_tunnel", "water"), 4):
            for x in by_order([x for x in of("middle") if tagged(x, tag)], lambda x: -x["final"], lambda x: -x["confidence"])[:1]:
                add(x, turn, True, False)
        for x in by_order(of("ending"), lambda x: -x["memory"], lambda x: -x["activity"], lambda x: -x["final"], lambda x: x["start"])[:2]:
            add(x, 6, True)
        for b, turn, most, budgets in (("middle", 7, 24.0 * 0.6, False), ("ending", 8, 5.0, True)):
            for x in by_order(of(b), lambda x: -x["activity"], lambda x: -x["final"], lambda x: x["story_order"], lambda x: x["start"]):
                if bucket(b) < most and out.seconds() < 24.0:
                    add(x, turn, budgets=budgets)
        for x in by_order(group, lambda x: -x["activity"], lambda x: x["story_order"], lambda x: -x["final"], lambda x: x["start"]):
            if out.seconds() < 24.0:
                add(x, 9)
        if out.seconds() < 0.85 * 24.0 or len(out.rows) < 4:
            for x in by_order(group, lambda x: -x["final"], lambda x: -x["activity"]):
                if out.seconds() < 24.0:
                    add(x, 10, True, False)
        return out

    compared(spark, SEGMENT, groups, lambda f: selectors.reel(f, ["g"], "key", plan), plain)


def plain_layout(x):
    tags = set(x["tags"] or ())
    return next((name for name, sets in selectors.LAYOUTS.items() if all(tags & set(s) for s in sets)), None)


@pytest.mark.parametrize("required", [(), ("speed_action",)])
def test_highlight(spark, required):
    r = random.Random(6)
    groups = [segments(r, g, r.randrange(1, 70)) for g in range(200)]
    coverage = {"water": 1, "lit_tunnel": 3}
    plan = selectors.Highlight(target=30.0, most=14, per_source=2, required_tags=required, coverage=coverage, coverage_gap=8.0, layout_limits={"people_group": 1})

    def plain(group):
        out = Plain()
        rows = [x for x in group if x["strong"]] or group
        best = lambda some: by_order(some, lambda x: -x["score"])

        def add(x, turn, relaxed=True):
            if out.has(x) or out.seconds() >= 30.0 or out.overlaps(x) or len(out.rows) >= 14 or not relaxed and out.count(lambda y: y["source"] == x["source"]) >= 2:
                return False
            kind = plain_layout(x)
            if kind and out.count(lambda y: y["source"] == x["source"] and plain_layout(y) == kind) >= (1 if kind == "people_group" else 2):
                return False
            return out.take(x, turn)

        turn = 0
        for tag in required:
            for x in best([x for x in rows if x["bucket"] == "middle" and tagged(x, tag)])[:1]:
                add(x, turn)
            turn += 1
        seen = set()
        for x in best([x for x in rows if x["memory_flag"]]):
            if x["source"] not in seen and len(seen) < max(8, min(14, round(14 * 0.75))) and add(x, turn):
                seen.add(x["source"])
        turn += 1
        for source in sorted({x["source"] for x in rows}, reverse=True):
            own = [x for x in rows if x["source"] == source]
            for place, (tag, n) in enumerate(coverage.items()):
                some = []
                for x in best([x for x in own if tagged(x, tag)]):
                    if len(some) < n and all(abs(x["start"] - y["start"]) >= 8.0 for y in some):
                        some.append(x)
                for x in by_order(some, lambda x: x["start"]):
                    add(x, turn + place)
            for x in by_order(best(own)[:2], lambda x: x["start"]):
                if required or x["final"] >= 42:
                    add(x, turn + 2, False)
        for x in by_order([x for x in rows if x["late"]], lambda x: x["start"]):
            add(x, turn + 3)
        if out.seconds() < 0.65 * 30.0:
            for x in best(rows):
                add(x, turn + 4)
        return out

    for group in groups:
        for x in group:
            x["memory_flag"] = x["memorable"]
    run = lambda f: selectors.highlight(f.drop("memory").withColumnRenamed("memorable", "memory"), ["g"], "key", plan)
    compared(spark, SEGMENT, groups, run, plain)


@pytest.mark.parametrize("required, most, target, per_source, limits", [((), 6, 900.0, 2, {"people_group": 0, "scenic": 0}), (("speed_action",), 9, 900.0, 1, {}), (("lit_tunnel", "pool"), 8, 12.0, 2, {"motion": 0}), ((), 5, 30.0, 0, {"water_action": 1})])
def test_highlight_of_many_sources(spark, monkeypatch, required, most, target, per_source, limits):
    """Rows that come after so many sources as a highlight has rows are not offered, and no row is missed by that: all rules over all rows take the same."""
    r = random.Random(most)
    coverage = {"water": 1, "scenic": 2}
    plan = selectors.Highlight(target=target, most=most, per_source=per_source, required_tags=required, coverage=coverage, coverage_gap=8.0, layout_limits=limits)
    groups = []
    for g in range(60):
        group = segments(r, g, r.choice([3, 40, 200]))
        spread = r.choice([4, 30, 150])
        for x in group:
            source = r.randrange(spread)
            x |= {"source": None if source == 3 else source, "source_order": None if source == 5 and g % 3 else source // 2, "start": r.choice([x["start"], x["start"] // 40]), "score": r.choice([x["score"], x["score"], -1.5, None if g % 4 == 0 else 3.0]), "memory_flag": x["memorable"]}
            x["end"] = x["start"] + x["seconds"]
        groups.append(group)

    def plain(group):
        out, turn = Plain(), 0
        rows = [x for x in group if x["strong"]] or group
        best = lambda some: by_order(some, lambda x: None if x["score"] is None else -x["score"])

        def add(x, turn, capped=False):
            if out.has(x) or out.seconds() >= target or out.overlaps(x) or len(out.rows) >= most or capped and x["source"] is not None and out.count(lambda y: y["source"] == x["source"]) >= per_source:
                return False
            kind = plain_layout(x)
            return not (kind and out.count(lambda y: y["source"] == x["source"] and plain_layout(y) == kind) >= limits.get(kind, 2)) and out.take(x, turn)

        for tag in required:
            for x in best([x for x in rows if x["bucket"] == "middle" and tagged(x, tag)])[:1]:
                add(x, turn)
            turn += 1
        seen = set()
        for x in best([x for x in rows if x["memory_flag"]]):
            if x["source"] not in seen and len(seen) < max(8, min(most, round(most * 0.75))) and add(x, turn):
                seen.add(x["source"])
        turn += 1
        swept = []
        for source in {x["source"] for x in rows}:
            own = [x for x in rows if x["source"] == source]
            for place, (tag, n) in enumerate(coverage.items()):
                some = []
                for x in best([x for x in own if tagged(x, tag)]):
                    if len(some) < n and all(abs(x["start"] - y["start"]) >= 8.0 for y in some):
                        some.append(x)
                swept += [x | {"turn": turn + place, "place": place} for x in some]
            swept += [x | {"turn": turn + 2, "place": 2} for x in best(own)[:per_source] if required or x["final"] >= 42]
        for x in sorted(swept, key=lambda x: (x["source_order"] is None, x["source_order"] or 0, x["place"], x["start"], x["turn"], x["key"])):
            add(x, x["turn"], x["place"] == 2)
        for x in by_order([x for x in rows if x["late"]], lambda x: x["start"]):
            add(x, turn + 3)
        if out.seconds() < 0.65 * target:
            for x in best(rows):
                add(x, turn + 4)
        return out

    run = lambda f: selectors.highlight(f.drop("memory").withColumnRenamed("memorable", "memory"), ["g"], "key", plan)
    compared(spark, SEGMENT, groups, run, plain)

    if per_source:  # ten rows each of more and more sources: what is offered is of a number of sources, not of all
        offered = []
        monkeypatch.setattr(selectors, "chosen", lambda rows, *a, chosen=selectors.chosen, **k: (offered.append(rows.count()), chosen(rows, *a, **k))[1])
        for sources in (50, 400):
            group = [x | {"source": i // 10, "source_order": i // 10, "strong": True, "score": float(r.randrange(10_000)), "start": r.random() * 1_000, "tags": ["pool"], "final": 60.0} for i, x in enumerate(segments(r, 0, sources * 10))]
            frame = spark.createDataFrame([tuple(x.get(f.split()[0]) for f in SEGMENT.split(", ")) for x in group], SEGMENT)
            run(frame)
        assert offered[-1] < 40 * most and offered[-1] <= 2 * max(offered[:2]), offered


def test_budgeted_timeline(spark):
    r = random.Random(7)
    groups = [segments(r, g, r.randrange(1, 70)) for g in range(250)]
    plan = selectors.Timeline(target=12.0, most=14, per_source=4, required_tags=("lit_tunnel", "scenic"), per_tag=2)

    def plain(group):
        out, spent = Plain(), [0.0]
        ordered = by_order(group, lambda x: x["source_order"], lambda x: x["start"])

        def add(x, turn, price="price", force=False):
            if out.has(x) or len(out.rows) >= 14:
                return
            if not force and (out.count(lambda y: y["source"] == x["source"]) >= 4 or out.rows and spent[0] + x[price] > 12.0 * 1.02):
                return
            spent[0] += x[price]
            out.take(x, turn)

        add(ordered[0], 0, "anchor_price", True)
        pays = [x for x in ordered if x["pays"]]
        latest = [x for x in pays if x["source_order"] == max(y["source_order"] for y in pays)]
        zone = [x for x in latest if x["source_seconds"] > 0 and 0.45 <= x["start"] / max(x["source_seconds"], 0.1) <= 0.86]
        last = max(zone or latest or [ordered[-1]], key=lambda x: (x["payoff"], x["start"], x["end"] - x["start"], x["key"]) if pays else 0)
        add(last, 1, "anchor_price", True)
        best = by_order(group, lambda x: -x["score"])
        for turn, tag in ((2, "lit_tunnel"), (3, "scenic")):
            for x in best:
                if tagged(x, tag) and out.count(lambda y: tagged(y, tag)) < 2:
                    add(x, turn, "anchor_price" if tag == "lit_tunnel" else "price")
        for i in sorted(offers.evenly(len(ordered), min(14, len(ordered)) - len(out.rows))):
            add(ordered[i], 4)
        for x in best:
            add(x, 5)
        return out

    compared(spark, SEGMENT, groups, lambda f: selectors.budgeted(f, ["g"], "key", plan), plain)


def test_least_speed_shows_the_tags(spark):
    r = random.Random(9)
    rows = [x for g in range(20) for x in segments(r, g, 40)]
    frame = spark.createDataFrame([tuple(x[f.split()[0]] for f in SEGMENT.split(", ")) for x in rows], SEGMENT)
    plan = selectors.Timeline(target=6.0, most=20, required_tags=("lit_tunnel", "scenic"), per_tag=3)
    found = selectors.least_speed(frame.drop("price", "anchor_price"), ["g"], "key", plan, (1.0, 2.0, 4.0)).collect()
    single = {s: selectors.budgeted(frame.withColumn("price", F.col("seconds") / s).withColumn("anchor_price", F.col("seconds") / max(1.0, s / 2)), ["g"], "key", plan).collect() for s in (1.0, 2.0, 4.0)}
    tags = {(x["g"], x["key"]): set(x["tags"] or ()) for x in rows}
    for g in range(20):
        enough = [s for s in single if all(sum(t in tags[g, x.key] for x in single[s] if x.g == g) >= min(3, sum(t in v for k, v in tags.items() if k[0] == g)) for t in ("lit_tunnel", "scenic"))]
        speed = min(enough, default=4.0)
        assert {(x.key, x.pick, x.turn) for x in found if x.g == g} == {(x.key, x.pick, x.turn) for x in single[speed] if x.g == g} and {x.speed for x in found if x.g == g} == {speed}


def test_a_timeline_looks_at_the_rows_that_have_a_say(spark):
    """Of a large group few rows are offered, at all speeds, and the timeline is that of all of them; a group with a negative price keeps every row."""
    r = random.Random(12)
    rows = []
    for g in range(2):
        for x in segments(r, g, 3000):
            price = round(r.uniform(1, 40), 2) - (50 if g and x["key"] == 7 else 0)
            rows.append(x | {"source": r.choice([None, *range(900)]), "score": r.choice([None, *(float(k) for k in range(300))]), "seconds": price, "price": price, "anchor_price": 1.5 * price, "source_order": x["key"] % 11})
    frame = spark.createDataFrame([tuple(x[f.split()[0]] for f in SEGMENT.split(", ")) for x in rows], SEGMENT).repartition(7)
    plan = selectors.Timeline(target=200.0, most=12, per_source=2, required_tags=("lit_tunnel", "scenic"), per_tag=3)
    few = selectors._with_a_say(frame, ["g"], "key", plan)
    n = {x.g: x["count"] for x in few.groupBy("g").count().collect()}
    assert n[0] < 600 and n[1] == 3000
    order = Window.partitionBy("g").orderBy("source_order", "start", "key")
    ends = selectors.payoff_anchor(frame, ["g"], "key").withColumn("ends", F.lit(True))
    whole = frame.join(ends, ["g", "key"], "left").join(frame.groupBy("g").agg(F.count("*").alias("count")), "g").withColumn("position", F.row_number().over(order) - 1)
    assert sorted(selectors.budgeted(frame, ["g"], "key", plan).collect()) == sorted(selectors._budgeted(whole, ["g"], "key", plan).collect())


def test_rules_of_tags_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, i, t, 1.0) for i, t in enumerate([["a", "b"], ["a"], ["b", "b"], None, ["c"], ["a", "c"]])], "g long, key long, tags array<string>, seconds double")
    found = offers.chosen(rows, ["g"], "key", [offers.Turn([F.col("key")], ("tags",))], {"tags": offers.TagCap("tags", 1, {"a": 2})})
    assert sorted(x.key for x in found.collect()) == [0, 1, 3, 4]
    assert offers.chosen(rows.limit(0), ["g"], "key", [offers.Turn([F.col("key")], ("tags",), top=1)], {"tags": offers.TagCap("tags", 1)}).count() == 0


def plainly_cut(at, starts, target, cap):
    runs = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]
    while len(runs) < target and max(map(len, runs)) > 1:
        where = max(range(len(runs)), key=lambda k: (len(runs[k]), k))
        run = runs[where]
        n = len(run)
        gap, j = max((at[run[j]] - at[run[j - 1]], j) for j in range(1, n))
        cut = 1 if n <= 2 else j if gap > 5 and max(1, n // 4) <= j <= min(n - 1, n * 3 // 4) else n // 2
        runs[where : where + 1] = [run[:cut], run[cut:]]
    out = []
    for run in runs:
        parts = -(-len(run) // cap)
        out += [run[round(i * len(run) / parts) : round((i + 1) * len(run) / parts)] for i in range(parts)]
    return [run[0] for run in out if run]


def test_runs_are_cut_to_a_target():
    r = random.Random(11)
    for _ in range(1500):
        n = r.randrange(1, 60)
        at = sorted(float(r.randrange(r.choice([5, 300, 3000]))) for _ in range(n))
        starts = sorted({0, *(r.randrange(n) for _ in range(r.randrange(4)))})
        target, cap = r.choice([0, 1, 3, 8, 100]), r.choice([1, 4, 9, 100])
        assert sessions.cuts(np.array(at), starts, target, cap) == plainly_cut(at, starts, target, cap)


def test_split_to_target_over_groups(spark):
    r = random.Random(12)
    rows = [(g, i, r.choice([None, float(r.randrange(4000))])) for g in range(60) for i in range(r.randrange(1, 50))]
    frame = spark.createDataFrame(rows, "g long, key long, at double").withColumn("session", F.floor(F.coalesce("at", F.lit(1e6)) / 1500))
    found = {(x.g, x.key): x.moment for x in sessions.split_to_target(frame, ["g"], "key", "at", "session", 6, 8).collect()}
    assert len(found) == len(rows)
    for g in range(60):
        own = [(k, a) for h, k, a in rows if h == g]
        last = max((a for _, a in own if a is not None), default=0.0)
        own = sorted((last if a is None else a, k, 1e6 if a is None else a) for k, a in own)
        named = [x[2] // 1500 for x in own]
        starts = [i for i in range(len(own)) if i == 0 or named[i] != named[i - 1]]
        begins = plainly_cut([x[0] for x in own], starts, 6, 8)
        assert [found[g, x[1]] for x in own] == [sum(b <= i for b in begins) for i in range(len(own))]


def test_repetition_by_reason(spark):
    r = random.Random(13)
    pool = ["water", "pool", "food", "scenic", "temple", "face_visible", "beach", "mountain", "rain"]
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for g in range(150):
        for i in range(r.randrange(1, 40)):
            tags = r.choice([None, [t for t in pool if r.random() < 0.25], ["beach", "scenic"], ["beach", "scenic", "face_visible"]])
            vector = r.choice([None, [0.0] * 6, [1.0, None], *[[x + r.gauss(0, 0.3) for x in r.choice(base)] for _ in range(5)]])
            rows.append({"g": g, "key": i, "at": float(r.randrange(50)), "seconds": r.choice([None, 1.0, 4.0]), "score": r.choice([None, 10.0, 95.0]), "faceless": r.choice([None, False, False, True]), "vector": vector, "tags": tags})
    schema = "g long, key long, at double, seconds double, score double, faceless boolean, vector array<double>, tags array<string>"
    frame = spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in rows], schema)
    found = {(x.g, x.key): (x.kept, x.why) for x in repetition.judged(frame.select("*", *(c.alias(n) for n, c in repetition.signatures().items())), ["g"], "key").collect()}
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    for g in range(150):
        own = sorted((x for x in rows if x["g"] == g), key=lambda x: (x["at"], x["key"]))
        total = sum(x["seconds"] or 0 for x in own)
        kept, gone = [], 0.0
        for x in own:
            tags = set(x["tags"] or ())
            x["look"] = tags - set(repetition.GENERIC), tags & set(repetition.BACKGROUND), tuple(k for k, v in repetition.LAYOUT.items() if tags & set(v))
            a, b, c = x["look"]
            people = bool(tags & {"face_visible", "people_visible"})
            close = sum(bool(c and c == z and max(share(a, y), share(b, w)) >= 0.72 or people and share(b, w) >= 0.72) for y, w, z in (k["look"] for k in kept[-2:]))
            near = any(repetition.cosine(x["vector"], k["vector"]) >= 0.91 for k in kept[-6:])
            if tags & set(repetition.PRESERVED):
                want = True, "preserved"
            elif x["faceless"]:
                want = False, "faceless"
            elif total - gone - (x["seconds"] or 0) < max(8.0, 0.45 * total):
                want = True, "too_little_left"
            elif close < 2 and not near:
                want = True, "new"
            elif (x["score"] or 0) >= 92:
                want = True, "high_score"
            else:
                want = False, "similar_tags" if close >= 2 else "similar_vector"
            assert found[g, x["key"]] == want
            if want[0]:
                kept.append(x)
            else:
                gone += x["seconds"] or 0
    assert {w for _, w in found.values()} == {"preserved", "faceless", "too_little_left", "new", "high_score", "similar_tags", "similar_vector"}


def test_terms_and_globs(spark):
    texts = [(0, "A walk by the River"), (1, None), (2, ""), (3, "GoPro POV, fast turns"), (4, "x" * 50_000 + " helmet cam"), (5, "nothing"), (6, "turn turn TURN")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts], "k long, t string, words string")
    want = {(i, term) for i, t in texts for term in terms.ALIASES if any(n in (t or "").lower() for n in terms.needles(term))}
    for block in (50_000, 7):  # one automaton, and several
        got = [tuple(x) for x in terms.term_hits(frame, "k", "t", terms.alias_table(spark), block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert terms.term_hits(frame, "k", "t", terms.alias_table(spark).limit(0)).count() == 0
    row = frame.where("k = 3").select(*(terms.says(F.lower("t"), x).alias(x) for x in ("gopro", "mud", "fast_turns"))).first()
    assert tuple(row) == (True, False, True)
    paths = ["trips/Bali/IMG_1.mov", "trips/IMG_22.MOV", "a[1].jpg", "b^&.x", None, "x.y"]
    cases = {"trips/*.mov": [1], "**.mov": [0, 1], "**/img_?.mov": [0], "IMG_": [0, 1], "a[[]1].jpg": [2], "?[!x]y": [5], "?[!.]y": [], "x[.]y": [5], "b[&^]?.x": [3], "[x": []}
    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    for pattern, expected in cases.items():
        assert [x.i for x in table.where(terms.glob(F.col("p"), pattern)).orderBy("i").collect()] == expected, pattern


def test_duplicate_manifest_equals_brute_force(spark):
    """Exact and near copies, videos of unknown and of other shapes, nulls: groups, reasons, keepers and actions by plain rules."""
    r = random.Random(31)
    base = [r.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(220):
        h = r.choice(base) if r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            h ^= 1 << r.randrange(64)
        video = r.random() < 0.5
        known = r.random() < 0.7
        rows.append({"media_set": "s", "path": f"p{i:03d}", "digest": r.choice([None, f"d{i % 40}", f"x{i}", f"x{i}", f"x{i}"]), "visual": None if r.random() < 0.1 else h - (1 << 64) if h >> 63 else h, "video": video, "file_type": "mp4" if video else "jpg", "bytes": r.randrange(5), "width": r.choice([640, 1280]) if known else None, "height": 480 if known else None, "duration": r.choice([None, 1.0, 2.5, 9.0]) if video else None, "created": r.choice([None, "c"]), "modified": "m"})
    schema = "media_set string, path string, digest string, visual long, video boolean, file_type string, bytes long, width int, height int, duration double, created string, modified string"
    frame = spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in rows], schema)

    def link(a, b):
        if a["digest"] is not None and a["digest"] == b["digest"]:
            return 0, 0, duplicates.EXACT
        if a["video"] != b["video"] or None in (a["visual"], b["visual"]):
            return None
        d = ((a["visual"] ^ b["visual"]) & (2**64 - 1)).bit_count()
        if d > (1 if a["video"] else 2):
            return None
        if a["video"] and (None not in (a["width"], b["width"], a["height"], b["height"]) and (a["width"], a["height"]) != (b["width"], b["height"]) or None not in (a["duration"], b["duration"]) and abs(a["duration"] - b["duration"]) > 2.0):
            return None
        return 1, d, duplicates.NEAR_VIDEO if a["video"] else duplicates.NEAR_PHOTO

    pairs = {(i, j): found for i in range(len(rows)) for j in range(i) if (found := link(rows[i], rows[j]))}
    label = list(range(len(rows)))
    for i, j in pairs:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    want = {}
    for root in set(label):
        own = [i for i in range(len(rows)) if label[i] == root]
        if len(own) > 1:
            best = min(v for (i, _), v in pairs.items() if label[i] == root)
            score = lambda x: ((x["width"] or 0) * (x["height"] or 0), x["duration"] or 0.0, x["bytes"], sum(x[k] is not None for k in ("width", "height", "duration", "created", "modified")), x["path"])
            keeper = max((rows[i] for i in own), key=score)["path"]
            for i in own:
                path = rows[i]["path"]
                want[path] = (rows[root]["path"], "keep" if path == keeper else "preserve" if best[2] == duplicates.NEAR_VIDEO else "review", "" if path == keeper else keeper, best[2], best[1])
    got = {x.original_path: (x.group_id, x.action, x.duplicate_path, x.duplicate_type, x.hash_distance) for x in duplicates.manifest(frame, 2, 1).collect()}
    assert got == want and len({v[3] for v in want.values()}) == 3
    assert duplicates.manifest(frame.limit(0), 2, 1).count() == 0


def test_written_dates(spark):
    cases = {
        ("2024-03-01T10:00:00Z", None): "2024-03-01 10:00:00", ("2024-03-01T10:00:00-0800", "UTC"): "2024-03-01 18:00:00", (" 2024-03-01T10:00:00+05:30 ", None): "2024-03-01 04:30:00", ("2024:03:01 10:00:00", "Asia/Kolkata"): "2024-03-01 04:30:00",
        ("03/04/2024 12:05 AM", None): "2024-03-04 00:05:00", ("01.02.2024 03:04:05", "Europe/Berlin"): "2024-02-01 02:04:05", ("20240229", None): "2024-02-29 00:00:00", ("1709290000", None): "2024-03-01 10:46:40", ("1709290000123", None): "2024-03-01 10:46:40.123",
        ("20240230", None): None, ("2024-13-01 00:00:00", None): None, ("n/a", None): None, ("", None): None, (None, None): None, ("2024-01", None): None, ("99999999999", None): None,
    }
    frame = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(cases)], "i int, t string, z string")
    got = [x.v for x in frame.select("i", F.timestamp_micros(dates.instant(F.col("t"), F.col("z"))).cast("string").alias("v")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_lookup_by_path_then_by_name(spark):
    files = spark.createDataFrame([("a/X.mov", 1, None), ("b/y.mov", 2, "t"), ("c/Y.MOV", 3, None), (None, 9, "n"), ("d/z z.mov", None, "u")], "path string, v int, w string")
    said = ["a/X.mov", "q/x.MOV", "x.mov", "b/y.mov", "y.mov", "", None, "no.mov", "z Z.mov"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, said string")
    got = [tuple(x)[2:] for x in lookup.looked_up(rows, "said", files, "path", ["v", "w"]).orderBy("k").collect()]
    x, y = ("a/X.mov", "name", 1, None), ("b/y.mov", "path", 2, "t")
    assert got == [("a/X.mov", "path", 1, None), x, x, y, (None, "ambiguous", None, None), *[(None, "missing", None, None)] * 3, ("d/z z.mov", "name", None, "u")]
    index = {r.name: tuple(r)[1:] for r in lookup.name_index(files, "path", ["v"], ["w"]).collect()}
    assert index == {"x.mov": (1, "a/X.mov", None), "y.mov": (2, "b/y.mov", "t"), "z z.mov": (1, "d/z z.mov", "u")}


def test_chapters_are_filled(spark):
    r = random.Random(41)
    rows = []
    for i in range(300):
        n = r.randrange(1, 9)
        target = [float(r.randrange(20)) for _ in range(n)]
        rows.append((i, target, [r.choice([None, 0.0, float(r.randrange(30))]) for _ in range(n)], [r.choice([0.0, 0.1, 0.5, 2.0]) for _ in range(n)]))
    frame = spark.createDataFrame(rows, "i int, target array<double>, available array<double>, weight array<double>")
    got = {x.i: x.f for x in frame.select("i", chapters.filled(F.col("target"), F.col("available"), F.col("weight")).alias("f")).collect()}
    moved = 0
    for i, target, available, weight in rows:
        names = range(len(target))
        want = selection.water_fill(dict(zip(names, target)), dict(zip(names, [x or 0.0 for x in available])), dict(zip(names, weight)))
        assert all(abs(a - want[k]) < 0.02 for k, a in enumerate(got[i]))
        moved += any(a > t for a, t in zip(got[i], target))
    assert moved > 50
    kinds = spark.createDataFrame([("rapids",), ("meal",), (None,), ("other",)], "m string")
    assert [x[0] for x in kinds.select(chapters.chapter(F.col("m"))).collect()] == ["peak", "people", "reflection", "reflection"]
