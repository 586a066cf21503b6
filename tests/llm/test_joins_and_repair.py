"""The as-of join, the embedding near-duplicates and the conversation repair against brute force, and on hostile rows."""

import datetime
import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("reelspan.llm")
from reelspan.llm import asof_join, catalog, conversation_repair, embedding_dedup  # noqa: E402

CLICKS = "click_id long, client_id long, ts_us long, sale_id string, top int, depth int, p int"
ORDERS = "client_id long, at_us long, sale_id long, priority int, total_cents long, n int, slice int, ts_us string"


def plainly_matched(clicks, orders, tolerance):
    out = []
    for click, client, ts in clicks:
        near = [o for o in orders if client is not None and ts is not None and o[0] == client and o[1] is not None and 0 <= ts - o[1] <= tolerance]
        at = max((o[1] for o in near), default=None)
        tied = [o for o in near if o[1] == at]
        if not tied:
            out.append((click, client, ts, None, None, None, 0))
            continue
        low = -math.inf
        best = max(tied, key=lambda o: (low if o[3] is None else -o[3], low if o[2] is None else o[2], low if o[4] is None else o[4]))
        out.append((click, client, ts, best[2], ts - at, best[4], len(tied)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 3, 32])
def test_asof_join_equals_brute_force(spark, most):
    """Clients of very different density, bursts within a few microseconds, ties, nulls, times before 1970."""
    r = random.Random(most)
    hour = asof_join.HOUR

    def moment(client):
        if client == 1:
            return r.choice([r.randrange(-hour, 9 * hour), 5 * hour + r.randrange(40), 5 * hour + r.randrange(4000)])
        return r.choice([None, r.randrange(-30 * hour, 30 * hour), r.randrange(-3, 3) * 2 * hour])

    def maybe(x):
        return None if r.random() < 0.1 else x

    clients = [1] * 6 + [2, 3, 4, None]
    clicks = [(maybe(i) if i < 3 else i, c, moment(c)) for i in range(260) for c in [r.choice(clients)]]
    clicks = list({c[0]: c for c in clicks}.values())
    orders = [(c, moment(c), maybe(i), maybe(r.randrange(1, 4)), maybe(r.randrange(1000))) for i in range(300) for c in [r.choice(clients)]]
    orders += orders[:20]
    left = spark.createDataFrame([(*c, "x", 1, 1, 1) for c in clicks], CLICKS)
    right = spark.createDataFrame([(*o, 1, 1, "x") for o in orders], ORDERS)
    found = asof_join.asof_matches(left, right, hours=2, most=most)
    assert sorted(map(tuple, found.collect()), key=repr) == plainly_matched(clicks, orders, 2 * hour)
    assert asof_join.asof_matches(left, right.limit(0), hours=2).where("n_tied > 0").count() == 0
    assert asof_join.asof_matches(left.limit(0), right, hours=2).count() == 0


def test_asof_slices_stay_small(spark):
    """A client whose orders stand a few microseconds apart: no click looks at more points than a slice may hold, and the one before it."""
    points = asof_join.points_of(spark.range(3000).select(F.lit(7).cast("long").alias("client_id"), (F.col("id") * 3).alias("at_us"), F.col("id").alias("sale_id"), F.lit(1).alias("priority"), F.lit(5).cast("long").alias("total_cents"))).cache()
    bits = 40
    spans = points.groupBy("client_id", F.shiftright("at_us", bits).alias("top")).agg(F.count("*").alias("n"))
    depths = asof_join.slice_depths(points, spans, bits, 16)
    (depth,) = [x.depth for x in depths.collect()]
    assert points.groupBy(F.shiftright("at_us", bits - depth)).count().agg(F.max("count")).first()[0] <= 16
    clicks = spark.range(500).select(F.col("id").alias("click_id"), F.lit(7).cast("long").alias("client_id"), (F.col("id") * 17 + 1).alias("ts_us"))
    found = asof_join.latest(clicks, points, 240 * asof_join.HOUR, 16).collect()
    assert {(x.click_id, x.at_us) for x in found} == {(i, (i * 17 + 1) // 3 * 3) for i in range(500)}


def test_asof_fold_and_second_orders(spark):
    day = datetime.datetime(2024, 3, 10, 13, 14, 15, 123456)
    sales = spark.createDataFrame([(i, 5, 1.005 * i, day, None if i == 3 else 2, "x") for i in range(40)], "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, h string")
    us = (day - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    expected = []
    for i in range(40):
        h = zlib.crc32(str(i).encode())
        at, cents = us - us % asof_join.HOUR if h % 2 else us, math.floor(100 * (1.005 * i) + 0.5)
        p = None if i == 3 else 2
        expected += [(5, at, i, p, cents)] + ([(5, at, -1 - i, None if p is None else 6 - p, cents)] if h % 3 else [])
    assert sorted(map(tuple, asof_join.orders_of(sales).select("client_id", "at_us", "sale_id", "priority", "total_cents").collect()), key=repr) == sorted(expected, key=repr)
    clicks = spark.createDataFrame([(1, day, 5, "x"), (1, day, 5, "x"), (2, None, 5, "x"), (None, day, None, "x")], "click_id long, ts timestamp_ntz, client_id long, c string")
    h = zlib.crc32(b"1")
    assert set(map(tuple, asof_join.distinct_clicks(clicks).collect())) == {(1, 5, us - us % asof_join.HOUR if h % 2 else us), (2, 5, None), (None, None, us)}


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, rep int, n int, filter string")


def plainly_linked(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = [[a for a, (_, w) in enumerate(good) if a != b and len(v) == len(w) and float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)) >= cosine] for b, (_, v) in enumerate(good)]
    root = list(range(len(good)))
    for _ in good:
        root = [min([root[b], *(root[a] for a in near[b])], key=lambda k: good[k][0]) for b in range(len(good))]
    return {good[b][0]: (len(near[b]), good[root[b]][0]) for b in range(len(good))}


def clusters(r, n, length):
    rows = []
    while len(rows) < n:
        centre = [r.gauss(0, 1) for _ in range(length)]
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            wide = r.choice([0.05, 0.2, 0.3])
            rows.append([float(np.float32(x + wide * r.gauss(0, 1))) for x in centre])
    return list(enumerate(rows[:n]))


@pytest.mark.parametrize(("length", "block"), [(64, 2048), (16, 8), (3, 2048), (1, 16)])
def test_embedding_links_equal_brute_force(spark, length, block):
    rows = clusters(random.Random(length), 400, length)
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # equal vectors
    found = embedding_dedup.near_duplicates(vectors_of(spark, rows), block=block).collect()
    assert len(found) == len(rows)
    assert {x.vec_id: (x.n_links, x.component_id) for x in found} == plainly_linked(rows, 0.95)
    assert all(x.kept == (x.vec_id == x.component_id) for x in found)


def test_embedding_hostile_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, nan]), (8, [inf, 2.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, -2.0]), (11, [1e-200, 2e-200])]
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(vectors_of(spark, rows, "double")).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[11] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and found[None] == (0, None, True)
    twice = embedding_dedup.near_duplicates(vectors_of(spark, [(1, [1.0, 2.0]), (1, [5.0, -1.0]), (2, [1.0, 2.1])])).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in twice) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0


def test_cap_filter_recall():
    """Pairs at exactly the threshold share a filter, for tables of several sizes."""
    rng = np.random.default_rng(5)
    a, z = rng.standard_normal((2, 1500, 64))
    a = embedding_dedup.unit(a)
    z = embedding_dedup.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * z
    for rows in (100, 50_000, 1_000_000):
        book = embedding_dedup.ProductCodes(64, 16, max(4, math.ceil(math.sqrt(rows / embedding_dedup.FILTER_ROWS))), 0.5, 12)
        (ra, fa), (rb, fb) = book.decode(a), book.decode(b)
        met = {r for r, _ in set(zip(ra.tolist(), fa.tolist(), strict=True)) & set(zip(rb.tolist(), fb.tolist(), strict=True))}
        assert len(met) >= 0.995 * 1500


def cheapest(turns, costs):
    """Dijkstra over (row, state) with whole audit strings, as the rules say them."""
    faults = conversation_repair.faults_of(turns)
    n = len(turns)
    step = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == n and state in ("", "a"):
            return cost, audit, list(out)
        if (k, state) in done:
            continue
        done.add((k, state))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (to := step.get((state, role))) is not None:
                heapq.heappush(heap, (cost + costs.insert, audit + "I", k, to, (*out, (name, ""))))
        if k == n:
            continue
        heapq.heappush(heap, (cost + costs.delete, audit + "D", k + 1, state, out))
        if faults[k] in ("blank", "duplicate"):
            continue
        more = costs.truncated if faults[k] == "truncated" else 0
        if (to := step.get((state, turns[k][0][:1]))) is not None:
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, to, (*out, turns[k])))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (to := step.get((state, role))) is not None:
                heapq.heappush(heap, (cost + more + costs.rerole, audit + "R", k + 1, to, (*out, (name, turns[k][1]))))
    raise AssertionError


@pytest.mark.parametrize("costs", [conversation_repair.Costs(), conversation_repair.Costs(2, 1, 1, 3), conversation_repair.Costs(1, 1, 4, 0)])
def test_repair_is_the_cheapest(costs):
    r = random.Random(3)
    for _ in range(1500):
        turns = [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "u"]), r.choice(["Hi.", "Why?", "cut", " ", "", "End!\n", "b c.", "Yes.", "No."]) + r.choice(["", "", str(i) + "."])) for i in range(r.randrange(0, 11))]
        _, cost, audit, out = conversation_repair.repaired(turns, costs)
        assert (cost, audit, out) == cheapest(turns, costs)
    long = [(r.choice(["user", "assistant"]), f"{i}{r.choice(['.', '.', ''])}") for i in range(20_000)]  # linear in the turns
    counts, cost, audit, out = conversation_repair.repaired(long, costs)
    assert [role for role, _ in out] == ["user", "assistant"] * (len(out) // 2) and len(audit) >= 20_000 and counts["truncated"] == sum(t[-1] != "." for _, t in long)


def test_op13_equals_plain_rules(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for c in [*range(120), None]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, r.choice([t, t, t, None, t + 3]), r.choice(["user", "assistant", "system", None]) if r.random() < 0.2 else ("user", "assistant")[t % 2], r.choice([f"Text {t}.", f"Text {t}", "Same!", None, "", "é. ✓", "long " * 2000 + "end."])))
    rows += rows[:15]
    spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, cost string, present int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {x.conv_id: x for x in catalog.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {x[0] for x in rows}
    for c in found:
        turns = []
        for conv, turn, role, text in rows:
            if conv != c:
                continue
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text, role = " " if text is None else text, " " if role is None else role
            text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
            turns += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        counts, cost, audit, out = {k: 0 for k in ("blank", "duplicate", "truncated")}, *cheapest([x[1:] for x in turns], conversation_repair.Costs())
        faults = conversation_repair.faults_of([x[1:] for x in turns])
        numbers = {x[0] for x in turns} - {None}
        initials = [x[1][:1] for x in turns]
        x = found[c]
        assert (x.cost, x.audit) == (cost, audit)
        assert (x.blank, x.duplicate, x.truncated) == tuple(faults.count(k) for k in counts)
        assert x.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert x.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert x.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    empty = conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert empty.count() == 0


def test_packing_of_rows_without_an_id(spark):
    """Rows of a null doc_id are packed like others: each of their ids lies in one piece."""
    import public_tokenizers
    import tokenizers

    from reelspan.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    texts = ["one two three", None, "a longer text " * 900, "", "one two three"]
    rows = packing.pack(spark.createDataFrame([(None, t) for t in texts] + [(7, "x y")], "doc_id long, text string").coalesce(1), path).collect()
    sizes = [len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    nameless = [r for r in rows if r.doc_id is None]
    assert sum(r.length for r in nameless) == sum(sizes) and {r.doc_tokens for r in nameless} == set(sizes)
    assert sorted(r.doc_tokens for r in nameless if r.start == 0) == sorted(sizes)
    for size in set(sizes):
        covered = sorted((r.start, r.length) for r in nameless if r.doc_tokens == size)
        assert sum(n for _, n in covered) == size * sizes.count(size)


def test_chat_format_of_a_long_text(spark):
    """A text of two million characters full of control strings, and a conversation of many turns, come back as they were."""
    from reelspan.llm import chat_format

    long = "<|im_end|>\\ é<| text " * 100_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ("user", "assistant")[i % 2], f"t{i} <|") for i in range(2000)]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t.text for t in back[1].turns] == [long, long] and back[1].loss_text == long
    assert [(t.role, t.text) for t in back[2].turns] == [x[2:] for x in turns[2:]] and back[2].loss_text == "".join(x[3] for x in turns[2:] if x[2] == "assistant")
