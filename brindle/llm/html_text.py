"""Main text of web pages: nearest-URL page differencing, with markup as the prior.

A page is cut into lines, one for each block, in page order. Markup gives each line a prior: ``chrome``
(inside menus, headers, footers, sidebars, notices, adverts, forms, reader comments and the like), ``main``
(inside an article or main element, chrome apart) or ``open`` (neither). Chrome lines go. Cutting and aligning take
memory linear in the page; cutting takes linear time, however broken the markup is.

The distinct URL paths of all pages are sorted by host and path; each is paired with the neighbour of
its host whose path shares more leading segments (the one before, if equal). The lines of the two pages
that are not chrome are aligned by longest common subsequence, and shared lines are the template's: they
are deleted, unless their prior is main (articles quote and repeat each other, and nothing of an article
may be dropped). If shared lines have ``NEAR`` of a page's characters or more, the two are copies, which tell
nothing of the template: the neighbour on the other side is taken, and if that is a copy too (or there
is none), nothing is deleted.

Sorting is by range over all pages, so a host of any size is spread; neighbours across partition ends
are found from one row for each end. A null html is empty, a null url has an empty host and path. Pages
of one path use one page of that path (the smallest id) as their neighbours'. Repeated rows give equal
results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import parts_for, settle

#: CHROME by a class or id of a plain container is WRAPPED: a main element inside ends it.
OPEN, MAIN, CHROME, WRAPPED = 0, 1, 2, 3
#: Bits of a table of alignment that are held at a time.
TABLE = 1 << 25
#: Parts into which the pages of one path are dealt.
SALTS = 64
#: The share of a page's characters in shared lines from which the two pages are copies.
NEAR = 0.9
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose lines are chrome wherever they stand; a header is so outside of articles only.
CHROME_ELEMENTS = frozenset("aside button datalist dialog footer form head label menu nav noscript object optgroup option search select textarea title".split())
#: Roles, and ends of class names and ids, that make an element chrome.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie "
    "cookies copyright dialog discussion disqus footer gdpr login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: What holds articles that are not the page's: a main element inside does not end it.
OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments commentlist discussion disqus promo promoted promotion related replies reply respond sponsor sponsored".split()
)
#: Last parts of names that say nothing of their own (comments-area, nav-links), and first parts that speak of another element (has-sidebar).
GENERIC = frozenset("area bar block bottom box button buttons inner item items left link links list posts right section slot top".split())
ABOUT_OTHERS = frozenset("has is no not with without".split())
TEXT_ELEMENTS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
NEVER_CHROME = frozenset(("html", "body", "main"))
#: Whole class names that count inside an article as well: menus, notices, adverts, comments and calls to subscribe or share. Other compounds and
#: all ids say nothing there (a layout is ``sidebar-right``, a recipe ``cookies``); text elements (a paragraph, a heading) are never chrome by a class.
IN_ARTICLES = CHROME_WORDS - frozenset("alert banner complementary contentinfo copyright dialog discussion login respond reply search social toolbar widget widgets".split()) | frozenset(
    "ad-banner ad-slot ad-unit comment-list comments-area cookie-banner cookie-notice newsletter-signup related-articles related-posts share-buttons share-links social-share".split()
)
#: Elements whose content is no text; it ends with their end tag alone.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template svg math iframe noembed noframes xmp canvas audio video".split()}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _own_word(name: str) -> str:
    """The part of a class name or id that says what the element is."""
    parts = [w.lower() for w in _SPLIT.split(name) if w]
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return "" if not parts or parts[0] in ABOUT_OTHERS else parts[-1]


def _prior(name: str, rest: str, inside: int) -> int:
    """The prior inside an element, from that around it."""
    if inside == CHROME or name in CHROME_ELEMENTS or (name == "header" and inside != MAIN):
        return CHROME
    main = name in ("article", "main")
    if rest.strip() and name not in ("html", "body"):
        own = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)}
        if name not in NEVER_CHROME:
            if "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")):
                return CHROME
            if CHROME_WORDS & set(own.get("role", "").lower().split()):
                return CHROME
            if inside == MAIN:
                if name not in TEXT_ELEMENTS and IN_ARTICLES & set(own.get("class", "").lower().split()):
                    return CHROME
            else:
                words = {_own_word(w) for k in ("class", "id") if k in own for w in own[k].split()}
                if words & OTHERS:
                    return CHROME
                if words & CHROME_WORDS:
                    return CHROME if main else WRAPPED
        main = main or own.get("role") == "main" or own.get("itemprop", "").lower() == "articlebody"
    return MAIN if main else inside


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it ends, attributes) of each tag, and the last text with an empty name.

    One walk from ``<`` to ``<``. A tag without ``>`` is text. A quote hides ``>`` up to its end; once one is open to the end of
    the page, quotes hide no more.
    """
    at, last, quotes = 0, page.rfind(">"), {c: page.rfind(c) for c in "\"'"}
    held: list[str] = []
    while (start := page.find("<", at)) >= 0:
        held.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if start > last:  # no tag ends beyond here, but a declaration does at the end
            if page[start + 1 : start + 2] in ("!", "?"):
                at = len(page)
                continue
            held.append("<")
            at = start + 1
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.index(">", start) + 1
            else:
                held.append("<")
                at = start + 1
            continue
        end = m.end()
        while mark := _TAG_MARK.search(page, end):
            c = mark[0]
            end = mark.end()
            if c == ">":
                break
            if c in quotes:
                if mark.start() == quotes[c]:
                    quotes, mark = {}, None
                    break
                end = page.index(c, end) + 1
        if mark is None:
            end = page.index(">", m.end()) + 1 if m.end() <= last else len(page)
            quotes = {}
        name, rest = m[1].lower(), page[m.end() : end - 1]
        closing = page[start + 1] == "/"
        yield "".join(held), name, closing, rest
        held, at = [], end
        if name in RAW and not closing and not (name in ("svg", "math") and rest.endswith("/")):
            found = RAW[name].search(page, end)
            at = found.end() if found else len(page)
    yield "".join([*held, page[at:]]), "", False, ""


#: What keeps an open element from being ended by another of its name.
_FENCES = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
    "p": ("div", "section", "article", "main", "td", "th", "li", "blockquote", "form", "aside", "header", "footer", "nav", "body", "figure", "details"),
}


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, prior) of each block that has text, in page order, in time linear in the page.

    Inline elements do not end a block: chrome inside one (an advert in a sentence) is cut out of it. One that makes text of
    another prior than its block's is a block of its own otherwise.
    """
    lines: list[tuple[str, int]] = []
    held: list[str] = []
    # name, prior, prior of the block, whether the element ends blocks
    stack: list[tuple[str, int, int, bool]] = [("", OPEN, OPEN, True)]
    places: dict[str, list[int]] = {}  # where elements of a name stand on the stack

    def close() -> None:
        if held:
            if own := _SPACE.sub(" ", "".join(held)).strip():
                lines.append((own, min(stack[-1][2], CHROME)))
            held.clear()

    def cut(at: int) -> None:
        for name, *_ in stack[at:]:
            places[name].pop()
        del stack[at:]

    def last(name: str) -> int:
        own = places.get(name)
        return own[-1] if own else 0

    def entry(name: str, rest: str) -> tuple[str, int, int, bool]:
        _, around, block, _ = stack[-1]
        prior = _prior(name, rest, around)
        ends = name in BLOCKS or prior != around and min(prior, CHROME) != CHROME
        return name, prior, prior if ends else block, ends

    for text, name, ends, rest in _tags(page or ""):
        if text:
            _, prior, block, _ = stack[-1]
            held.append(" " if min(prior, CHROME) == CHROME and block < CHROME else html.unescape(text))
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if ends:
            at = last(name)
            if name in BLOCKS or at and any(x[3] for x in stack[at:]):
                close()
            if at:
                cut(at)
            continue
        own = entry(name, rest)
        if own[3]:
            close()
        if name in _FENCES and last(name) > max(map(last, _FENCES[name])):
            cut(last(name))
            own = entry(name, rest)
        if name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append(own)
    close()
    return lines


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each line of b, an integer: bit i is 0 where a[:i + 1] has a longer common subsequence with b so far than a[:i]."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    now, rows = full, []
    for y in b:
        u = now & where.get(y, 0)
        now = ((now + u) | (now - u)) & full
        rows.append(now)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of b and each a[:i]."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = now = (1 << len(a)) - 1
    for y in b:
        u = now & where.get(y, 0)
        now = ((now + u) | (now - u)) & full
    bits = np.unpackbits(np.frombuffer(now.to_bytes(len(a) // 8 + 1, "little"), "u1"), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(1 - bits.astype("i8"))]


def common_places(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of a and b.

    Lines that only one has are left out and common ends are cut off first; what is left is halved until its table fits ``TABLE``
    bits, so memory is linear in the lines.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in at], [y for y in b if y in both]
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            found.add(at[i])
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            found.add(at[j])
        if i == j or k == n:
            continue
        if (j - i) * (n - k) > TABLE and n - k > 1:
            half = (k + n) // 2
            left, right = _lengths(a[i:j], b[k:half]), _lengths(a[i:j][::-1], b[half:n][::-1])
            middle = i + int(np.argmax(left + right[::-1]))
            todo += [(i, middle, k, half), (middle, j, half, n)]
            continue
        rows, x, y = _rows(a[i:j], b[k:n]), j - i, n - k
        while x and y:
            if rows[y - 1] >> (x - 1) & 1:
                x -= 1
                continue
            y -= 1
            if y and not rows[y - 1] >> (x - 1) & 1:
                continue
            x -= 1
            found.add(at[i + x])
    return found


def _near(own: list[tuple[str, int]], shared: set[int]) -> bool:
    return sum(len(own[k][0]) for k in shared) >= NEAR * sum(len(text) for text, _ in own)


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """shared: places, among the lines that are not chrome, of the template's lines."""
    own = [x for x in lines if x[1] != CHROME]
    if _near(own, shared):
        shared = set()
    kept = [text for k, (text, prior) in enumerate(own) if prior == MAIN or k not in shared]
    return "\n\n".join(kept)


def _hash(line: str) -> int:
    """Of a line for alignment, 62 bits."""
    data = line.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 30 ^ zlib.crc32(data[::-1]) >> 2


def _pack(lines: list[tuple[str, int]]) -> bytes:
    """Lines that are not chrome, compressed; no line holds a line feed."""
    return zlib.compress("\n".join(f"{prior}{text}" for text, prior in lines if prior != CHROME).encode("utf-8", "surrogatepass"))


def _unpack(data: bytes) -> list[tuple[str, int]]:
    whole = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(x[1:], int(x[0])) for x in whole.split("\n")] if whole else []


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row per row of ``pages``: key, url, text, and how many lines were shared with the paired page.

    Pages are cut into lines twice: first for the hashes of their lines alone, which are what is sorted
    and paired, then for the text, which is shuffled once, compressed, to meet its neighbours' hashes.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1))).withColumn("path", F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", ""))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[_hash(t) for t, prior in page_lines(h) if prior != CHROME] for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "host", "path", "hashes"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_pack(page_lines(h)) for h in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(packed, pa.binary())], names=["key", "url", "host", "path", "packed"])

    outlines = rows.select("key", "host", "path", "html").mapInArrow(outline, f"key {kind}, host string, path string, hashes array<long>")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    paths = settle(outlines.groupBy("host", "path").agg(F.min_by("hashes", F.struct("key", "hashes")).alias("hashes"), F.collect_set(salt).alias("salts")), "outlines")
    paths = paths.repartitionByRange(parts_for(pages), "host", "path").sortWithinPartitions("host", "path")
    # written, so that the part and place of a path stay what they are
    paths = settle(paths.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "paths")
    entry = F.struct("host", "path", "hashes")
    ends = paths.groupBy("part").agg(F.min_by(entry, "place").alias("head"), F.max_by(entry, "place").alias("tail"))
    by_part = Window.orderBy("part")  # a row for each partition that has rows
    ends = settle(ends.select("part", F.lag("tail").over(by_part).alias("tail"), F.lead("head").over(by_part).alias("head")), "ends")
    within = Window.partitionBy("part").orderBy("place")
    # a row for each salt that pages of the path have: pages of one path, however many, are spread over as many tasks
    near = paths.withColumn("before", F.lag(entry).over(within)).withColumn("after", F.lead(entry).over(within)).join(ends, "part")
    near = near.select("host", "path", "salts", F.coalesce("before", "tail").alias("before"), F.coalesce("after", "head").alias("after"))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(f"{c}.path", f"{c}.hashes"))
    near = near.select("host", "path", F.explode("salts").alias("salt"), same("before").alias("before"), same("after").alias("after"))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts, counts = [], []
                for path, packed, *sides in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    lines = _unpack(packed)
                    shared, own = set(), [_hash(t) for t, _ in lines]
                    for other in sorted((s for s in sides if s), key=lambda s: -_shared_segments(path, s["path"])):
                        shared = common_places(own, other["hashes"])
                        if not _near(lines, shared):
                            break
                    texts.append(main_text(lines, shared))
                    counts.append(len(shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["key", "url", "text", "n_shared_lines"])

    cuts = rows.select("key", "url", "host", "path", "html").mapInArrow(cut, f"key {kind}, url string, host string, path string, packed binary")
    paired = cuts.withColumn("salt", salt).join(near, ["host", "path", "salt"]).select("key", "url", "path", "packed", "before", "after")
    return paired.mapInArrow(difference, f"key {kind}, url string, text string, n_shared_lines long")


def _shared_segments(a: str, b: str) -> int:
    return len(os.path.commonprefix([a.split("/"), b.split("/")]))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract_text(pages)
    return found.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared_lines")
