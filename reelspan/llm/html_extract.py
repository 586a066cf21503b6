"""Main text of web pages, with a suffix array over each host's pages.

Landmarks of the markup decide first: elements that never hold main text (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, styles, hidden parts, by element, role, or the words of a
class or id) are left out, and where a page has article or main elements only their blocks count. Words of reader comments and teasers decide
wherever they stand in a name, of an article element too; others decide as the first or last word of a name whose other words
only say what sort of box it is. Words of state turn a name round: no-sidebar, ad-free and comments-open are about a page.

The suffix array of a host is over what stands outside the articles of all its pages: the text of menus, footers and other
landmarks, and the undecided text of pages without landmarks. Its suffixes are sorted token by token, up to `depth` tokens (a
token counts by its digest, so the order is another one than that of letters, with the same neighbours in a run); neighbours with a common prefix of `depth`
tokens are a run, and where a run is from `pages` or more pages of different content its tokens are boilerplate. A longer repeat is
the union of its substrings of that length, so sorting any deeper finds nothing more. Covered tokens are removed from undecided text
and the unique runs kept; a page that is covered whole has no text. Pages of equal text are one page. So a line that other pages of the host mark as their footer goes from a page without landmarks too.

The suffix array alone can't give right results: menus and adverts may be unique to a page, and
an article, or a passage of it, may stand on several pages, or in menus; so it has no say inside an article element.

Defined results: a null html is empty; repeated rows give repeated results, and count as one page for
repeats; a null url has the empty host; a prefix on exactly `pages` pages is boilerplate; further columns are
ignored, whatever their names; an empty table gives an empty result; pages are parsed whole, in time linear in
their length, however long and however broken: unknown or unclosed markup never raises.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}  # their content is no markup
RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.IGNORECASE) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SECTIONS = BLOCKS - set("p li dd dt h1 h2 h3 h4 h5 h6 hr option td th tr".split())  # tracked until they end
DROPPED = set("head nav footer aside form noscript template iframe svg canvas object audio video button select dialog menu math".split()) | RAW
MAIN = {"article", "main"}
PAGE = {"html", "body"}
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = set(
    "ad ads advert advertisement sponsor sponsored promo promotion cookie cookies consent notice gdpr nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header respond reply share sharing social related recommended newsletter subscribe subscription "
    "popup modal overlay login signup widget pagination pager skip toolbar disclaimer discussion".split()
)
READER_NAMES = set("comment comments commentlist commenter commenters disqus replies responses".split())  # wherever they stand
TEASER_NAMES = {"teaser", "teasers"}
STATES = set("no not has with without free open closed enabled disabled on off".split())  # has-sidebar is about the page, not of a sidebar
BOX_NAMES = set(
    "box bar block container wrap wrapper wrapping list links link buttons button area section slot unit banner top bottom left right inner outer item items panel icons icon tools tool "
    "site page global post posts article articles entry content body main wide mobile desktop sticky fixed floating primary secondary form row col column columns group stories story news "
    "thread feed reader user users author id text title small large mini big google dfp network media policy message signup email toggle strip zone placeholder holder count counter".split()
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_A-Za-z]+")


@dataclass(frozen=True)
class ExtractionRules:
    depth: int = 10
    pages: int = 3


def _names_dropped(one: str, name: str, inside_main: bool) -> bool:
    """Whether the words of a class or id name what is never main text (an article's own header is).

    Of an article or main element only words of readers and teasers count, with boxes beside them.
    """
    words = [w.lower() for w in WORDS.findall(one)]
    if not words or not STATES.isdisjoint(words):
        return False
    if name in MAIN:
        return words[0] in READER_NAMES | TEASER_NAMES | {"reply"} and all(w in BOX_NAMES | READER_NAMES or w.isdigit() for w in words[1:])
    if not READER_NAMES.isdisjoint(words) or words[0] in TEASER_NAMES or words[-1] in TEASER_NAMES:
        return True
    dropped = [w for w in words if w in DROPPED_NAMES and not (inside_main and w == "header")]
    plain = all(w in DROPPED_NAMES or w in BOX_NAMES or w.isdigit() for w in words)
    return bool(dropped) and plain and (words[0] in dropped or words[-1] in dropped or words[-1].isdigit())


def _dropped(name: str, attrs: str, inside_main: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_main:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for key, value in ATTRIBUTE.findall(attrs):
        key, given = key.lower(), value.strip("\"'")
        value = given.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in PAGE and any(_names_dropped(one, name, inside_main) for one in given.split()):
            return True
    return False


def markup(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The page as text followed by a tag (or None), comments and declarations left out, in time linear in its length.

    A tag's quotes hide a >; after the first tag whose quotes never end, a > ends a tag wherever it stands.
    A < without any > behind it is text.
    """
    at, n, tag, last = 0, len(page), TAG, page.rfind(">")
    start = 0  # of the text not given out yet
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[start:lt], None
            start = at = n if end < 0 else end + 3
            continue
        if lt > last:  # no tag ends any more; a comment that never ends hides the rest
            end = page.find("<!--", lt)
            yield page[start : n if end < 0 else end], None
            return
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?") or mark == "/" and not page[lt + 2 : lt + 3].isalpha():
            yield page[start:lt], None
            start = at = page.find(">", lt) + 1
            continue
        m = tag.match(page, lt) if mark == "/" or mark.isascii() and mark.isalpha() else None
        if m is None and tag is TAG and mark.isascii() and mark.isalpha():
            tag = PLAIN_TAG
            m = tag.match(page, lt)
        if m is None:
            at = lt + 1
            continue
        yield page[start:lt], m
        start = at = m.end()
        name = m["name"].lower()
        if not m["end"] and name in RAW and not m["attrs"].endswith("/"):
            start = at = RAW_END[name].search(page, at).end()
    yield page[start:], None


def blocks_of(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its main text, and the blocks of that text, or else all undecided blocks."""
    marked, main, undecided, _ = parts_of(page)
    return marked, main if marked else undecided


def parts_of(page: str) -> tuple[bool, list[str], list[str], list[str]]:
    """Whether the page marks its main text, and the blocks of that text, of undecided text, and of what landmarks leave out."""
    undecided: list[str] = []
    main: list[str] = []
    left_out: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped here or above, main here or above
    open_names: Counter[str] = Counter()
    marked = False

    def close() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                dropped, inside = stack[-1][1:] if stack else (False, False)
                (left_out if dropped else main if inside else undecided).append(text)
            held.clear()

    def leave() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    for text, m in markup(page):
        if text:
            held.append(text)
        if m is None:
            continue
        name = m["name"].lower()
        dropped, inside = stack[-1][1:] if stack else (False, False)
        if m["end"]:
            if name in BLOCKS:
                close()
            if open_names[name] > 0:
                close()
                while leave() != name:
                    pass
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if name in RAW or name in VOID or m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        if name == "body":
            if dropped:
                close()
            while stack:  # a head that was never closed ends here
                leave()
            dropped = inside = False
        if name in MAIN and dropped and not inside:
            while stack and stack[-1][1]:  # a menu or header that was never closed ends here
                leave()
            dropped = False
        drop = _dropped(name, m["attrs"], inside)
        if name in SECTIONS or drop:
            if drop and not dropped:
                close()
            is_main = inside or name in MAIN or bool(re.search(r"role\s*=\s*[\"']?main\b", m["attrs"]))
            marked |= is_main and not (dropped or drop)
            stack.append((name, dropped or drop, is_main))
            open_names[name] += 1
    close()
    return marked, main, undecided, left_out


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host (digest), marked, blocks, content (digest of the text that makes it a page of its own), outside, shape (of host, content and outside).

    outside: what is not main text, undecided and left out, as two strings of tokens.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marked, blocks, content, outside = [], [], [], []
        for html in batch.column("html").to_pylist():
            is_marked, main, undecided, left_out = parts_of(html or "")
            marked.append(is_marked)
            blocks.append(main if is_marked else undecided)
            content.append(_digest(" ".join(blocks[-1])))
            outside.append([" ".join(undecided), " ".join(left_out)])
        columns = [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(marked, pa.bool_()), pa.array(blocks, pa.list_(pa.string())), pa.array(content, pa.int64()), pa.array(outside, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "marked", "blocks", "content", "outside"])

    host = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)", 1), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), "url", F.xxhash64(F.lower(host)).alias("host"), "html")
    parsed = shared.arrow_map(keyed, work, "page_id long, url string, host long, marked boolean, blocks array<string>, content long, outside array<string>")
    return parsed.withColumn("shape", F.xxhash64("host", "content", "outside"))


TOKEN_BYTES = 6  # of a token's digest in a key of the suffix array


def suffix_keys(tokens: list[str], depth: int) -> list[bytes]:
    """The digests of the first `depth` tokens of each suffix that is as long, side by side: they sort as the suffixes do by tokens."""
    digests = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)).astype(">u8")
    packed = digests.view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :].tobytes()
    return [packed[i : i + depth * TOKEN_BYTES] for i in range(0, (len(tokens) - depth + 1) * TOKEN_BYTES, TOKEN_BYTES)]


def _suffixes(streams: DataFrame, depth: int) -> DataFrame:
    """key (host and first tokens), content, shape and at (counted over both strings of outside) of each suffix of streams (host, content, shape, outside)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for host, content, shape, outside in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "shape", "outside")), strict=True):
            first, front = 0, host.to_bytes(8, "big", signed=True)
            for text in outside:
                tokens = text.split(" ") if text else []
                keys = suffix_keys(tokens, depth)
                if n := len(keys):
                    columns = [pa.array([front + k for k in keys], pa.binary()), pa.array([content] * n, pa.int64()), pa.array([shape] * n, pa.int64()), pa.array(range(first, first + n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "shape", "at"])
                first += len(tokens)

    return shared.arrow_map(streams.select("host", "content", "shape", "outside"), work, "key binary, content long, shape long, at int")


def repeated_keys(suffixes: DataFrame, pages: int) -> DataFrame:
    """The keys of suffixes (key, content) that stand in so many different contents: runs of equal neighbours of the sorted suffix array.

    The array is sorted over ranges of keys, so a run lies in one of them; a task holds its last key and content only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = content = None
        n = 0
        for batch in batches:
            found = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if k != key:
                    n = 0
                elif c == content:
                    continue
                key, content = k, c
                n += 1
                if n == pages:
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])

    array = suffixes.select("key", "content").repartitionByRange("key").sortWithinPartitions("key", "content")
    return array.mapInArrow(work, "key binary")


def without_covered(blocks: list[str], starts: list[int], rules: ExtractionRules) -> list[str]:
    """The blocks without the tokens that the repeated prefixes at starts cover."""
    tokens = [b.split(" ") for b in blocks]
    total = sum(map(len, tokens))
    covered = bytearray(total)
    for a in starts:
        covered[a : a + rules.depth] = b"\1" * min(rules.depth, total - a)
    out, at = [], 0
    for t in tokens:
        kept = [w for w, c in zip(t, covered[at : at + len(t)], strict=True) if not c]
        at += len(t)
        if kept:
            out.append(" ".join(kept))
    return out


def main_text(pages: DataFrame, rules: ExtractionRules = ExtractionRules()) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    parsed = shared.written(_parsed(pages), "parsed-pages")
    undecided = parsed.where("not marked and size(blocks) > 0")
    suffixes = _suffixes(parsed.where("outside[0] <> '' or outside[1] <> ''").dropDuplicates(["shape"]), rules.depth)
    repeated = shared.written(repeated_keys(suffixes, rules.pages), "repeated-prefixes")
    asked = _suffixes(undecided.dropDuplicates(["shape"]), rules.depth)
    starts = asked.join(repeated, "key").groupBy("shape").agg(F.collect_set("at").alias("starts"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks = [without_covered(b, s or [], rules) for b, s in zip(batch.column("blocks").to_pylist(), batch.column("starts").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    decided = shared.arrow_map(undecided.join(starts, "shape", "left").select("page_id", "url", "blocks", "starts"), work, "page_id long, url string, blocks array<string>")
    rest = parsed.where("marked or size(blocks) = 0").select("page_id", "url", "blocks")
    text = F.array_join("blocks", "\n")
    return rest.union(decided).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
