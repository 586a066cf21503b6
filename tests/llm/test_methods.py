"""The dealt methods against brute force, and hostile inputs: shared lines, suffix arrays, guess costs, hot shards, hub nodes."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict
from math import log10
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("reelspan.llm")
from reelspan.llm import html_extract, license_scan, license_texts, near_dedup, quality_crf, quality_rules, secret_scan, simhash  # noqa: E402
from reelspan.operators import graph  # noqa: E402

from .test_operators import brute_components, prose, table  # noqa: E402


@pytest.mark.parametrize("shared,own,depleted", [(4, 12, False), (10, 5, True), (20, 5, True), (30, 1, True), (20, 20, False)])
def test_shared_lines_are_removed(spark, shared, own, depleted):
    """Pages of one host that share lines, whatever their number beside the pages' own lines."""
    common = [prose(12, 10_000 + i) for i in range(shared)]
    rows = []
    for i in range(40):
        lines = common + [prose(12, 20_000 + 100 * i + k) for k in range(own)]
        random.Random(i).shuffle(lines)
        rows.append((i, "\n".join(lines), "site"))
    rows += [(500 + i, "\n".join(common + [prose(12, 90_000 + i)]), "other") for i in range(10)]  # as many documents as a line may have
    got = {r.doc_id: r for r in quality_rules.verdicts(table(spark, rows).withColumn("host", F.col("source"))).collect()}
    assert all(got[i].removed_words == 12 * shared and (got[i].kept or got[i].base_failed) != depleted for i in range(40))
    assert not any(got[500 + i].removed_words for i in range(10))
    assert {r.doc_id for r in quality_rules.cleaned(table(spark, rows)).collect()} == {d for d, r in got.items() if r.kept}


def test_line_counts_equal_brute_force(spark):
    r = random.Random(4)
    pool = [prose(r.randint(1, 9), 700 + i) for i in range(60)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25))), r.choice("abb")) for i in range(150)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(None, None, "a"), (2000, "", "b"), rows[5]]
    seen = defaultdict(set)
    for _, text, host in rows:
        for line in set((text or "").split("\n")):
            seen[host, line].add(text)
    got = Counter((x.doc_id, x.removed_words) for x in quality_rules.verdicts(table(spark, rows).withColumn("host", F.col("source"))).collect())
    want = Counter((i, sum(len(line.split()) for line in (t or "").split("\n") if len(seen[h, line]) > 10)) for i, t, h in rows)
    assert got == want


@pytest.mark.parametrize("name", ["post-comments", "article-sidebar", "content-ad", "main-nav", "entry-footer", "comments-area", "ad_box", "story-related", "cookie-notice"])
def test_named_parts_inside_an_article_go(name):
    page = f'<body><article class="post"><div class="entry-header"><h1>Head</h1></div><p>One.</p><div class="{name}"><p>no <b>no</b></p></div><p>Two.</p></article></body>'
    assert html_extract.blocks_of(page) == (True, ["Head", "One.", "Two."])


def test_layout_names_do_not_drop_the_article():
    page = '<body class="has-sidebar"><main id="content"><article class="no-comments footer"><header><h1>Head</h1></header><p class="with-ads">One.</p></article></main></body>'
    assert html_extract.blocks_of(page) == (True, ["Head", "One."])


@pytest.mark.parametrize("part", ['<div class="user-comments-list">', '<section id="disqus_thread">', '<div class="reader-responses">', '<article class="comment">', '<article id="comment-12">', '<article class="teaser">', '<div class="relatedPosts">', '<div class="ad-slot-2">', '<p class="share-buttons">'])
@pytest.mark.parametrize("inside", [False, True])
def test_comments_and_teasers_go(part, inside):
    end = "</" + part[1:].split()[0] + ">"
    more = f"{part}first! no{end}"
    page = f"<body><article><p>One.</p>{more if inside else ''}<p>Two.</p></article>{'' if inside else more}</body>"
    assert html_extract.blocks_of(page) == (True, ["One.", "Two."])


@pytest.mark.parametrize("part", ['<div class="story ad-free">', '<p class="share-price">', '<div class="comments-open">', '<div class="menu-prices">', '<section id="related-work">', '<article class="post comments-closed">', '<div class="header-files">'])
def test_text_of_the_article_stays(part):
    end = "</" + part[1:].split()[0] + ">"
    assert html_extract.blocks_of(f"<body><article><h1>Head</h1>{part}One.{end}<p>Two.</p></article></body>") == (True, ["Head", "One.", "Two."])


def test_a_page_of_boilerplate_has_no_text(spark):
    boiler = prose(30, 77).replace(".", "")
    rows = [(i, "https://h.example/", f"<p>{boiler}</p>" + (f"<p>{prose(25, 600 + i)}</p>" if i else "")) for i in range(4)]
    got = {x.page_id: x.text for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "" and all(got[i] == prose(25, 600 + i) for i in (1, 2, 3))


@pytest.mark.parametrize(
    "page", ["<a " * 300_000, '<a "' * 200_001 + ">", "<div>" * 80_000 + "</b>" * 80_000, "<" * 900_000, "<!--" * 200_000, "<p class='" * 100_000, "</" * 400_000, "<script>" * 100_000, "<b x=y>" * 90_000 + "&" * 200_000]
)
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_extract.blocks_of(page)
    assert time.time() - began < 10


def test_host_suffix_array_equals_brute_force(spark):
    """Pages without landmarks: a token is removed just if a substring of `depth` tokens that holds it stands on `pages` different pages of the host."""
    r = random.Random(9)
    rules = html_extract.ExtractionRules(depth=5, pages=3)
    boiler = [prose(r.randint(3, 14), 400 + i).replace(".", "") for i in range(5)]
    texts = []
    for i in range(30):
        parts = [prose(r.randint(4, 20), 5000 + 10 * i + k).replace(".", "") for k in range(3)] + r.sample(boiler, r.randint(0, 3))
        r.shuffle(parts)
        texts.append((r.choice(["a", "a", "b"]), parts))
    texts += [texts[0], ("c", [boiler[0]]), ("c", [])]
    where = defaultdict(set)
    for host, parts in texts:
        tokens = " ".join(parts).split()
        for k in range(len(tokens) - 4):
            where[host, tuple(tokens[k : k + 5])].add(tuple(tokens))
    want = {}
    for i, (host, parts) in enumerate(texts):
        tokens = " ".join(parts).split()
        gone = {k + d for k in range(len(tokens) - 4) if len(where[host, tuple(tokens[k : k + 5])]) >= 3 for d in range(5)}
        at, blocks = 0, []
        for p in parts:
            n = len(p.split())
            blocks.append(" ".join(w for k, w in enumerate(p.split(), at) if k not in gone))
            at += n
        want[i] = "\n".join(b for b in blocks if b)
    rows = [(i, f"https://{host}.example/{i}", "<body>" + "".join(f"<p>{p}</p>" for p in parts) + "</body>") for i, (host, parts) in enumerate(texts)]
    got = {x.page_id: x.text for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == want and any(want[i] != "\n".join(p) for i, (_, p) in enumerate(texts))


def test_footers_of_other_pages_go_from_a_page_without_landmarks(spark):
    """The suffix array is over the text outside the articles of all pages of a host, and has no say inside them."""
    line = prose(14, 910).replace(".", "")
    rows = [(i, "https://h.example/", f"<nav>{prose(4, 920 + i)}</nav><article><p>{prose(30, 930 + i)}</p></article><footer>{line}</footer>") for i in range(3)]
    rows += [(3, "https://h.example/", f"<p>{prose(30, 940)}</p><p>{line}</p>"), (4, "https://other.example/", f"<p>{prose(30, 941)}</p><p>{line}</p>"), (5, "https://h.example/", f"<article><p>{line}</p></article>")]
    got = {x.page_id: x.text for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: prose(30, 930 + i) for i in range(3)}, 3: prose(30, 940), 4: f"{prose(30, 941)}\n{line}", 5: line}


def test_suffixes_are_sorted_by_tokens(spark):
    """Sorted by their keys, suffixes that share their first tokens are neighbours at every depth, and keys that stand in enough contents are found."""
    r = random.Random(3)
    docs = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(20)]
    rows = [(bytes(k), c, tuple(t[i : i + 6])) for c, t in enumerate(docs) for i, k in enumerate(html_extract.suffix_keys(t, 6))]
    array = [tokens for _, _, tokens in sorted(rows)]
    for depth in range(1, 7):
        heads = [t[:depth] for t in array]
        assert sum(a != b for a, b in zip(heads, heads[1:])) + 1 == len(set(heads))
    found = html_extract.repeated_keys(spark.createDataFrame([x[:2] for x in rows], "key binary, content long"), 3).collect()
    contents = defaultdict(set)
    for k, c, _ in rows:
        contents[k].add(c)
    assert sorted(bytes(x.key) for x in found) == sorted(k for k, cs in contents.items() if len(cs) >= 3)


def test_near_copies_are_found_by_trees_and_judged_by_similarity(spark):
    """Without any MinHash bucket, texts whose SimHashes differ in a few bits meet, and link only if they are similar enough."""
    texts = []
    for k in range(6):
        words = prose(900, 70_000 + k).split()
        texts += [" ".join(words), " ".join(w if j != 400 else "changed" for j, w in enumerate(words))]
    sets = [near_dedup.shingle_set(t.encode()) for t in texts]
    prints = [simhash.majority_bits(x) for x in sets]
    near = {k for k in range(6) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 4}
    assert len(near) >= 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for similarity, joined in ((0.8, near), (0.9999, set())):
        kept = {x.doc_id for x in near_dedup.one_of_each(docs, similarity, bands=0).collect()}
        assert kept == set(range(12)) - {2 * k + 1 for k in joined}


def brute_cost(value, ranks, costs):
    """The least price over all segmentations, every span priced from its definition."""
    n, low, each = len(value), "".join(c.lower() if c.isascii() else c for c in value), log10(secret_scan._classes(value))
    plain = low.translate(secret_scan.LEET)

    def price(i, j):
        piece, out = value[i:j], [(j - i) * each]
        if 3 <= j - i and (word := secret_scan.word_cost(value, i, j, low, plain, ranks)) is not None:
            out.append(word)
        out += [costs.date] if secret_scan.DATE.fullmatch(piece) else []
        out += [costs.year] if secret_scan.YEAR.fullmatch(piece) else []
        if j - i >= 3 and len(set(low[i:j])) == 1:
            out.append(log10(secret_scan._classes(value[i])) + log10(j - i))
        if j - i >= 4 and all(b in secret_scan.NEIGHBOURS.get(a, ()) for a, b in zip(low[i:j], low[i + 1 : j])):
            out.append(log10(47) + 0.5 * (j - i))
        return min(out) + costs.segment

    best = [0.0]
    for j in range(1, n + 1):
        best.append(min(best[i] + price(i, j) for i in range(j)))
    return best[n]


@pytest.mark.parametrize("words", [None, "byte_bpe_50k.json"])
def test_guess_cost_equals_brute_force(words):
    ranks, costs, r = secret_scan.ranked_words(words and public_tokenizers.path(words)), secret_scan.GuessCosts(), random.Random(1)
    parts = "2019 20191231 31.12.1999 aaaa AAaa 1111 qwerty poiu asdf zxcvbn dragon P4ss passw0rd xK9$ summer ! 7 that q ssss 111 Ü İ 19".split()
    values = ["", "20192019poiu", "a", "ss" * 20] + ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(4000)]
    values += ["".join(r.choice("aqws12!A") for _ in range(r.randint(1, 14))) for _ in range(2000)]
    for v in values:
        assert secret_scan.guess_cost(v, costs, ranks) == pytest.approx(brute_cost(v, ranks, costs) if v else 0.0, abs=1e-9), v
    assert secret_scan.guess_cost("password") < 1 < secret_scan.guess_cost("passw0rd") < secret_scan.guess_cost("xq9!kz7$")


def test_secret_scan_takes_linear_time():
    text = " ".join(f'password = "k{i}$Zq!x#7" token: abcdef{i}' for i in range(30_000))
    began = time.time()
    assert len(secret_scan.find_secrets(text)) > 60_000 and secret_scan.guess_cost("a" * 100_000) < 8 and secret_scan.guess_cost("qw" * 50_000) > 9
    assert time.time() - began < 20


def test_every_licence_of_a_long_notice_file(spark):
    rows = [(i, prose(30, i) + " " + " ".join(license_texts.NOTICES[i % 3][1].split()), "s") for i in range(60)]
    rows.append((100, ". ".join(text for _, text, _ in license_texts.TEMPLATES), "s"))
    rows += [(200 + t, text.title() + ".", "s") for t, (_, text, _) in enumerate(license_texts.TEMPLATES)]
    got = {x.doc_id: x for x in license_scan.digests(license_scan.scan(table(spark, rows))).collect()}
    assert {*got[100].labels.split(",")} >= {label for label, _, _ in license_texts.TEMPLATES}
    for t, (label, _, _) in enumerate(license_texts.TEMPLATES):
        assert label in got[200 + t].labels.split(",") and got[200 + t].score == 1.0


def test_hot_shards_equal_brute_force(spark):
    """A dense ball of fingerprints and scattered ones, with a bound that makes most shards hot."""
    r = random.Random(8)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {x.fingerprint % (1 << 64): x.root for x in simhash.groups(spark.createDataFrame(signed, "fingerprint long"), tree_bound=8).collect()}
    want = brute_components(prints)
    sizes = Counter(want.values())
    assert set(got) == {p for p in prints if sizes[want[p]] > 1}
    same = defaultdict(set)
    for p, root in got.items():
        same[root].add(want[p])
    assert all(len(x) == 1 for x in same.values())


def test_hub_nodes(spark):
    """A centre of very many leaves, a chain on it, and a group of its own."""
    edges = [(5, 100 + i) for i in range(3 * graph.HUB)] + [(i, i + 1) for i in range(1, 5)] + [(9000, 9001), (9001, 9002)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (9000 if n >= 9000 else 1) for e in edges for n in e}


def test_long_labelled_texts_are_fitted_within_bounds(spark):
    """A text of 190,000 lines among short ones: all documents are there, cut into chains, in bounded memory and time."""
    import tracemalloc

    long = "\n".join(["GOOD!! GOOD!! #$ GOOD!!", "bad words here", "x # y"][i % 3] for i in range(190_000))
    rows = [(i, "\n".join(prose(9, 100 * i + k) for k in range(10)) if i % 2 else "\n".join("NO!! " * 6 for _ in range(10)), "s") for i in range(127)] + [(900, long, "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(127)] + [(900, 0)], "doc_id long, quality int")
    tracemalloc.start()
    began = time.time()
    field = quality_crf.fitted(table(spark, rows), labels, quality_crf.FieldConfig(steps=30))
    took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 300e6 and took < 90 and field is not None
    assert quality_crf.scores([rows[1][1].encode(), rows[2][1].encode()], field)[0] > 0.5 > quality_crf.scores([rows[2][1].encode()], field)[0]
    few = quality_crf.fitted(table(spark, rows), labels, quality_crf.FieldConfig(fit_chains=40, steps=3))  # a bound of chains, wherever they come from
    assert few is not None
    assert quality_crf.fitted(table(spark, [(i, " ", "s") for i in range(30)]), labels) is None


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_held_out_accuracy(spark):
    """What was never read for fitting is predicted right."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_crf.scored(docs, quality_crf.fitted(docs, labels)).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_known_words_have_no_greatest_length():
    """The price is that of a plain recursion over all words of the dictionary, also of those that are long."""
    ranks = secret_scan.ranked_words(public_tokenizers.path("byte_bpe_50k.json"))
    long = [w for w in ranks if len(w) > 14]
    assert len(long) > 50 and ranks.longest == max(map(len, ranks))
    costs = secret_scan.GuessCosts()
    for w in long:
        assert secret_scan.guess_cost(w, costs, ranks) <= math.log10(ranks[w] + 1) + costs.segment + 1e-9
    for w in ("responsibilities", "characterization"):
        assert secret_scan.find_secrets(f"password: {w}", costs, ranks)[0][0] == "assign" and not [x for x in secret_scan.find_secrets(f"the pwd: {w}", costs, ranks) if x[0] == "guess"]


def test_hot_buckets_of_near_copies_equal_brute_force(spark):
    """Variants that link by a common text only, chains of edits, and pairs among texts of one template: all three steps of a hot bucket decide some."""
    r = random.Random(9)

    def changed(words, n, tag):
        words = list(words)
        for at in r.sample(range(5, len(words) - 5), n):
            words[at] = f"{tag}{r.randrange(10**6)}"
        return words

    base = prose(300, 501).split()
    texts = [base, *(changed(base, 5, "v") for _ in range(60))]
    for _ in range(30):
        texts.append(changed(texts[-1], 3, "c"))
    template = prose(200, 502).split()
    for k in range(40):
        own = prose(60, 600 + k).split()
        texts += [template + own, *([changed(template + own, 2, "p")] if k % 3 == 0 else [])]
    r.shuffle(texts)
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    docs = table(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])
    for bound, rows in ((4, 1), (16, 4)):  # one hash a band puts nearly all into hot buckets
        assert {x.doc_id for x in near_dedup.one_of_each(docs, bound=bound, rows=rows).collect()} == set(label)


def test_set_links_equal_all_pairs():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    asks = [bool(x) for x in r.integers(0, 2, 70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_dedup.common_counts(sets, np.arange(70), step=7).tolist() == want
    for labels, asking in ((None, None), (None, asks), ([i % 50 for i in range(70)], asks)):
        start = labels or list(range(70))
        joined = connected({(a, b) for a, b in itertools.combinations(range(70), 2) if (asking is None or asks[a] or asks[b]) and want[a][b] >= 0.5 * (len(sets[a]) + len(sets[b]) - want[a][b])}, start)
        assert connected(set(near_dedup.set_links(sets, 0.5, labels, asking)), start) == joined and len(set(joined)) < len(set(start))


def connected(pairs, start):
    label = list(start)
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return [min(i for i, x in enumerate(label) if x == y) for y in label]
