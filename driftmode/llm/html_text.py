"""Main text of web pages by a suffix array for each host.

1. One pass over the HTML cuts it into blocks and puts each into a zone: *main* (inside an article or main element),
   *aside* (inside menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, by element, role or class
   names) or *open* (neither). A page's token stream is its main blocks, or its open ones if it has no main block.
2. The pages of a host are dealt by the digests of their texts into parts of about ``PART_PAGES`` pages or ``PART_BYTES``
   bytes of HTML, so that a host with very many pages is no single task. In each part the streams are concatenated and
   sorted as suffixes; neighbours with ``RUN`` words in common are repeats. Those on half the pages of the part
   (and two at least) are boilerplate there. Equal texts are one page, and so are near copies (``NEAR``): if boilerplate
   covers half of a page, it is compared with the others of which that is true.
3. Boilerplate of a host is what is boilerplate in parts that hold half the host's pages. In a host of one part, that is
   a share of ``SHARE`` exactly.
4. The words that it covers go (but not a few words at the edge of a block that is otherwise unique); what is left of
   each block, the unique runs, is the text. A main block is stated to be the article by the page itself, and articles
   share quotes, licence lines and passages: it goes only as a whole, if boilerplate of ``MAIN_PAGES`` pages or more covers
   every word of it, and never if the article would be left empty.

Blocks have their character references decoded, white space (as in ``str.split``) joined to single spaces
and ends trimmed; empty blocks go; blocks are joined by line breaks.

Defined results: null HTML is empty and gives an empty text; unclosed or stray tags, comments and
unfinished references are tolerated (where the quotes of a tag never close, it and all later ones end at the next ">"),
in time linear in the page's length; pages with the same id are pages of their own; a null URL or one without
host is a host of its own name; columns other than id, URL and HTML are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import partitions, written
from .fm_index import suffix_order
from .near_dup import element_sets, spanning_links

RUN = 8
#: Part of the pages on which boilerplate stands.
SHARE = 0.5
#: Pages on which boilerplate inside a declared article stands.
MAIN_PAGES = 4
#: Similarity of near copies (of sets of 5-word shingles).
NEAR = 0.6
#: Pages and bytes of HTML of a part, about; it has LEAST_PAGES pages if these have more bytes.
PART_PAGES = 512
PART_BYTES = 4 << 20
LEAST_PAGES = 16
#: Bytes of text that a task gathers before it packs them, and bytes of HTML whose texts one task compares, about.
HELD = 24 << 20
TASK_BYTES = 8 << 20

# Elements and names of the HTML standard and common practice.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas noembed noframes xmp".split())
_ASIDE = frozenset("nav aside footer form dialog menu button select option fieldset label head datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_MAIN = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments respond disqus replies related recommended recommendations share sharing social toolbar pagination pager widget widgets login skip paywall".split()
)
_WHOLE_NAMES = frozenset("header site-header page-header main-header top-header aside side search toc".split())

#: Names that a wrapper of an article may have as well, for what else it holds or lacks.
_LAYOUT = frozenset("sidebar sidebars menu menus nav navbar navigation share sharing social ad ads banner widget widgets toolbar breadcrumb breadcrumbs cookie cookies notice notices modal overlay topbar masthead".split())
_STATES = frozenset("has no with without non is not".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag: quotes count after an equals sign.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MORE_THAN_TAG = re.compile(r"[^a-z0-9]+")


def _aside(tag: str, attributes: str, in_main: bool) -> str:
    """The zone of an element that is no main text: "aside", or "layout" if only names say so that a wrapper of the article
    may have as well; or nothing."""
    if tag in _ASIDE or (tag == "header" and not in_main):
        return "aside"
    if tag in _MAIN or tag in ("html", "body") or "=" not in attributes:
        return ""
    zone = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            if value in _ROLES:
                return "aside"
        elif name.lower() in ("class", "id"):
            for one in value.split():
                words = _MORE_THAN_TAG.split(one)
                named = _NAMES.intersection(words)
                if one in _WHOLE_NAMES or (named and not named <= _LAYOUT):
                    return "aside"
                if named and words[0] not in _STATES:
                    zone = "layout" if tag in ("div", "section") else "aside"
    return zone


def _is_main(tag: str, attributes: str) -> bool:
    if tag in _MAIN:
        return True
    return "=" in attributes and any((n.lower(), v.strip("\"'").lower()) in (("role", "main"), ("role", "article"), ("itemprop", "articlebody")) for n, v in _ATTRIBUTE.findall(attributes))


class Scanner:
    """Goes through HTML once, from one piece of markup to the next."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.closes = True  # there may be a ">" further on
        self.sections = True  # there may be an end of a CDATA section
        self.ragged = False  # a tag's quotes don't close: later tags end at the next ">"
        self.unclosed: set[str] = set()  # raw elements of which no end tag is left

    def next(self) -> tuple[int, str, str, bool] | None:
        """(start, name, attributes, closing) of the next markup, which ends at ``at``. Comments and the like have no name, and a
        CDATA section's text for attributes."""
        html, at = self.html, self.at
        while (at := html.find("<", at)) >= 0:
            kind = html[at + 1 : at + 2]
            if kind == "!" and html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                self.at = len(html) if end < 0 else end + 3
                return at, "", "", False
            if kind == "!" and self.sections and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                if end >= 0:
                    self.at = end + 3
                    return at, "", html[at + 9 : end], False
                self.sections = False
            name = _NAME.match(html, at + 1 + (kind == "/"))
            if name is None and kind not in ("!", "?", "/"):
                at += 1
                continue
            rest = _REST.match(html, name.end()) if name and self.closes and not self.ragged else None
            if rest is None:
                self.ragged = self.ragged or name is not None
                end = html.find(">", name.end() if name else at) + 1 if self.closes else 0
                if not end:
                    self.closes = False
                    return None
            else:
                end = rest.end()
            self.at = end
            return (at, name[0].lower(), html[name.end() : end - 1], kind == "/") if name else (at, "", "", False)
        return None

    def skip(self, tag: str) -> None:
        """Pass over what a raw element holds."""
        close = None if tag in self.unclosed else _CLOSERS[tag].search(self.html, self.at)
        end = self.html.find(">", close.end()) + 1 if close else 0
        if end:
            self.at = end
        else:
            self.unclosed.add(tag)
            if tag in _TO_THE_END:
                self.at = len(self.html)


_CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_TO_THE_END = frozenset("script style noscript template iframe textarea".split())
#: Elements that are closed as a rule: a main element inside such an aside is part of it.
_WALLS = frozenset("section div aside footer form".split())


class Zones:
    """The open elements that matter for the zone. Text counts while no aside is open but those around the open main element."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []  # name, zone, and the asides that were passed over before
        self.names: Counter[str] = Counter()
        self.zones: Counter[str] = Counter()
        self.asides = self.passed = 0

    @property
    def shown(self) -> bool:
        return self.asides == self.passed

    def push(self, tag: str, zone: str) -> None:
        self.stack.append((tag, zone, self.passed))
        self.names[tag] += 1
        self.zones[zone] += 1
        if zone in ("main", "wrapped"):
            self.passed = self.asides
        self.asides += zone in ("aside", "wall", "layout")

    def close(self, tag: str) -> None:
        while self.names[tag]:
            name, zone, passed = self.stack.pop()
            self.names[name] -= 1
            self.zones[zone] -= 1
            self.asides -= zone in ("aside", "wall", "layout")
            if zone in ("main", "wrapped"):
                self.passed = passed
            if name == tag:
                return


def blocks_of(html: str) -> tuple[list[str], list[str]]:
    """The main and the open blocks of a page. A main element inside a wrapper with the names of a layout counts if the page
    has no other one and not more open text."""
    main: list[str] = []
    open_: list[str] = []
    wrapped: list[str] = []
    held: list[str] = []
    z = Zones()

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                (wrapped if z.zones["wrapped"] else main if z.zones["main"] else open_).append(text)

    scan, at = Scanner(html), 0
    while (found := scan.next()) is not None:
        start, tag, attributes, closing = found
        if at < start and z.shown:
            held.append(html[at:start])
        if not tag:
            if attributes and z.shown:
                held.append(attributes.replace("&", "&amp;"))
            at = scan.at
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if tag == "body" and not z.names[tag]:
                z = Zones()
            else:
                z.close(tag)
        elif tag in _RAW:
            if not attributes.endswith("/"):
                scan.skip(tag)
        elif tag in _VOID or attributes.endswith("/"):
            pass
        elif _is_main(tag, attributes) and not z.zones["wall"]:
            z.push(tag, "wrapped" if z.zones["layout"] else "main")
        elif tag == "body" and z.asides:
            z = Zones()
        elif zone := _aside(tag, attributes, z.zones["main"] + z.zones["wrapped"] > 0):
            z.push(tag, "wall" if zone == "aside" and tag in _WALLS else zone)
        elif z.names[tag]:
            z.push(tag, "")
        at = scan.at
    if z.shown:
        held.append(html[at:])
    flush()
    if not main and wrapped and sum(map(len, wrapped)) >= sum(map(len, open_)):
        main = wrapped
    return main, open_


def host_of(url: str) -> Column:
    """The host of a URL; a URL without one is a host of its own name."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(host != "", host).otherwise(F.coalesce(F.col(url), F.lit("")))


def text_of(html: str | None) -> tuple[str, bool]:
    """The joined main blocks of a page and True, or the joined open blocks of a page without such and False."""
    main, open_ = blocks_of(html or "")
    return "\n".join(main or open_), bool(main)


_STREAMS = "host string, part bigint, nodes binary, sizes binary, texts binary"


def streams(pages: DataFrame, part_pages: int, part_bytes: int) -> DataFrame:
    """(host, part, nodes, sizes, texts) from (host, url, html): texts of some pages of a part, as one zstandard frame,
    their sizes in bytes and their digests. A task sends equal texts of a host once, so a text that very many pages have
    is no large group."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("size"))
    parts = F.greatest(F.ceil(F.col("n") / part_pages), F.least(F.ceil(F.col("size") / part_bytes), F.ceil(F.col("n") / LEAST_PAGES)))
    # only hosts of several parts: at most one for each PART_PAGES pages; written, so that Spark knows the size when it chooses the join
    several = written(hosts.select("host", parts.alias("parts")).where("parts > 1"), "hosts")

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        held: dict[tuple[str, int], list[tuple[bytes, bytes]]] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            rows = [(h, p, b"".join(n for n, _ in x), np.array([len(t) for _, t in x], "<u8").tobytes(), z.compress(b"".join(t for _, t in x))) for (h, p), x in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), *[pa.binary()] * 3])], [x.split()[0] for x in _STREAMS.split(", ")])

        for batch in batches:
            for part in _text.parts(batch, 1, 1 << 20):
                for host, html, parts in zip(*(c.to_pylist() for c in part.columns)):
                    text = text_of(html)[0].encode(errors="replace")
                    node = hashlib.md5(host.encode() + b"\x00" + text, usedforsecurity=False).digest()
                    if not text or node in seen:
                        continue
                    seen.add(node)
                    held.setdefault((host, int.from_bytes(node[:8], "little") % (parts or 1)), []).append((node, text))
                    size += len(text)
                if size >= HELD:
                    yield packed()
                    held, size = {}, 0
        if held:
            yield packed()

    return pages.join(several, "host", "left").select("host", "html", "parts").mapInArrow(run, _STREAMS)


def window_pages(texts: pa.Array, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, page) of the runs of ``run_words`` words that stand in two pages at least, by the suffix array of the
    pages' words: pages ``page[first[i]:first[i + 1]]``, ascending, have ``window[i]``."""
    tokens, windows, pages = [], [], []
    for block in _text.blocks(texts):
        w = _text.words(block)
        h = w.hashes()
        value, at = _text.windows(h, w.off, run_words)
        own = np.zeros(len(h), np.uint64)
        own[at] = value
        tokens.append(h)
        windows.append(own)
        pages.append(w.row_of() + block.first)
    h, window, page = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (tokens, windows, pages))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    page = page.astype(np.int64)
    n = len(texts)
    # a separator of its own ends each page
    place = np.arange(len(h)) + page
    _, ids = np.unique(h, return_inverse=True)
    seq = np.empty(len(h) + n, np.int64)
    seq[place] = ids + n
    ends = np.ones(len(seq), bool)
    ends[place] = False
    seq[ends] = np.arange(n)
    del h, ids
    order = suffix_order(seq, run_words)
    order = order[~ends[order]]
    word = np.empty(len(seq), np.int64)
    word[place] = np.arange(len(place))
    order = word[order]
    order = order[window[order] != 0]  # a run that goes beyond the page's end is none
    if not len(order):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    value, page = window[order], page[order]
    new = np.append(True, value[1:] != value[:-1])
    group = np.cumsum(new) - 1
    both = np.unique(group * n + page)
    group, page = both // n, both % n
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    count = np.diff(np.append(begin, len(group)))
    kept = count > 1
    return value[new][group[begin[kept]]], np.append(0, np.cumsum(count[kept])), page[np.repeat(kept, count)]


def part_boilerplate(texts: pa.Array, run_words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The pages of a part (near copies are one), its boilerplate windows, and the pages that have each."""
    window, first, page = window_pages(texts, run_words)
    words = np.array([len(t.split()) for t in texts.to_pylist()])
    label = np.arange(len(texts))
    row = np.repeat(np.arange(len(window)), np.diff(first))
    while True:
        pages = len(np.unique(label))
        both = np.unique(row * len(texts) + label[page]) if len(row) else np.zeros(0, np.int64)
        support = np.bincount(both // len(texts), minlength=len(window))
        common = (support >= 2) & (support >= SHARE * pages)
        # near copies have most of their words in common: only pages that are half boilerplate can be such
        covered = np.bincount(page[common[row]], minlength=len(texts))
        some = np.flatnonzero((2 * covered >= np.maximum(words - run_words + 1, 1)) & (covered > 0))
        linked = spanning_links(element_sets(texts.take(pa.array(some)), False), label[some], NEAR) if len(some) > 1 else []
        if not linked:
            return pages, window[common], support[common]
        for a, b in linked:
            x, y = label[some[a]], label[some[b]]
            label[label == max(x, y)] = min(x, y)


def boilerplate(pages: DataFrame, run_words: int, part_pages: int = PART_PAGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(host, windows): the boilerplate of each host that has some, with the pages that each window stands on."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held: dict[bytes, bytes] = {}
        last = None

        def settled() -> pa.RecordBatch:
            # (in an order that doesn't depend on how the rows came)
            texts = pa.array([held[x] for x in sorted(held)], pa.large_binary()).view(pa.large_string())
            pages, window, support = part_boilerplate(texts, run_words) if len(held) > 1 else (1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = len(window) + 1  # a row for the part itself
            values = pa.array(np.append(window.view(np.int64), 0), mask=np.append(np.zeros(n - 1, bool), True))
            return pa.RecordBatch.from_arrays([pa.array([last[0]] * n), values, pa.array(np.append(support, 0).astype(np.int64)), pa.array(np.full(n, pages, np.int64))], ["host", "window", "support", "pages"])

        for batch in batches:
            for host, part, nodes, sizes, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, part) != last:
                    if held:
                        yield settled()
                    held, last = {}, (host, part)
                at = np.append(0, np.cumsum(np.frombuffer(sizes, "<u8").astype(np.int64))).tolist()
                flat = z.decompress(texts)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    held.setdefault(nodes[16 * k : 16 * k + 16], flat[a:b])
        if held:
            yield settled()

    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    rows = streams(pages, part_pages, part_bytes)
    rows = rows.repartition(max(partitions(pages.sparkSession), -(-total // TASK_BYTES)), "host", "part").sortWithinPartitions("host", "part")
    found = written(rows.mapInArrow(run, "host string, window bigint, support bigint, pages bigint"), "parts")
    total = found.where("window is null").groupBy("host").agg(F.sum("pages").alias("total"))
    common = found.where("window is not null").groupBy("host", "window").agg(F.sum("support").alias("support"), F.sum("pages").alias("pages"))
    sure = common.join(total, "host").where((F.col("support") >= 2) & (F.col("pages") >= F.col("total") * SHARE))
    # (a host's boilerplate is a few pages of text at most: windows on half of its pages)
    return written(sure.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("window", "support"))).alias("windows")), "boilerplate")


def spans_of(text: str, windows: list[dict], run_words: int) -> list[dict]:
    """Where the windows stand in a text, in words."""
    w = _text.words(next(_text.blocks(pa.array([text], pa.string()))))
    value, at = _text.windows(w.hashes(), w.off, run_words)
    support = {x["window"]: x["support"] for x in windows}
    return [{"start": k, "end": k + run_words, "pages": support[v]} for v, k in zip(value.view(np.int64).tolist(), at.tolist()) if v in support]


def without_words(text: str, spans: list[dict], run_words: int) -> str:
    """The blocks of a text without the words of the spans; emptied blocks go. Of a run that reaches into a block by
    fewer than ``run_words`` words and doesn't cover it, these words stay."""
    block = next(_text.blocks(pa.array([text], pa.string())))
    w = _text.words(block)
    covered = np.zeros(len(w.start), bool)
    for s in spans:
        covered[s["start"] : s["end"]] = True
    line = np.searchsorted(np.flatnonzero(w.buf == 0x0A), w.start)
    out = []
    for of_line in np.split(np.arange(len(line)), np.flatnonzero(np.diff(line)) + 1):
        gone = covered[of_line]
        if gone.all():
            continue
        change = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            if b - a < run_words:
                gone[a:b] = False
        out.append(b" ".join(w.buf[w.start[i] : w.end[i]].tobytes() for i in of_line[~gone]))
    return b"\n".join(x for x in out if x).decode()


def without_blocks(text: str, spans: list[dict]) -> str:
    """A declared article without the blocks that boilerplate covers from end to end; all of it if no other is left."""
    covered = {k for s in spans if s["pages"] >= MAIN_PAGES for k in range(s["start"], s["end"])}
    at, left = 0, []
    block = next(_text.blocks(pa.array([text], pa.string())))
    w = _text.words(block)
    ends = np.searchsorted(w.start, np.append(np.flatnonzero(w.buf == 0x0A), len(w.buf)))
    for one, end in zip(text.split("\n"), ends.tolist()):
        if end == at or not covered.issuperset(range(at, end)):
            left.append(one)
        at = end
    return "\n".join(left) or text


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run_words: int = RUN, part_pages: int = PART_PAGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. The HTML is read again for the text, which is less than to keep it."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("host", host_of("url"))
    found = boilerplate(own.select("host", "html"), run_words, part_pages, part_bytes)
    kind = pages.schema[id_col].dataType.simpleString()

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.parts(batch, 2, 1 << 20):
                texts = []
                for html, windows in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    text, declared = text_of(html)
                    spans = spans_of(text, windows, run_words) if text and windows else []
                    texts.append(text if not spans else without_blocks(text, spans) if declared else without_words(text, spans, run_words))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    done = own.join(found, "host", "left").select("page_id", "url", "html", "windows").mapInArrow(run, f"page_id {kind}, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
