"""Main text of web pages by markup and nearest-URL page differencing.

A scan turns each page into its lines: text blocks outside menus, forms,
scripts and the like, with a note whether they lie in an explicit article.
Pages are then ordered by host and URL path, so that the pages nearest by path
stand next to each other, and each is aligned with its nearer neighbour by
longest common subsequence.  Lines that both have are the site's, not the
page's, and go.  Neighbours that are mere copies of the page tell nothing and are
passed over.

An explicit article element is trusted by default: its lines stay even if the
neighbour has them, since articles quote each other and repeat stock lines (see
the README for what differencing them costs).  ``trust_articles=False`` applies
the differencing to articles too.

The order is dealt in ranges of the URLs, found from the URL column alone, so a
host may span any number of tasks; the pages at the ends of a range also go to
the next range, to be aligned with but not returned.  The result doesn't depend
on where ranges end.  A page's lines travel compressed, once.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .sequences import lcs

#: Pages of one range, about.
RANGE = 2000
#: Two pages of whose text at least this share is common are copies.
COPY = 0.9
SCHEMA = "page_id long, url string, text string, n_chars long, n_lines int, n_shared int"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\bhidden\b")
_PART = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

# Element and attribute names of HTML, and usual names of page parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_SKIP = frozenset("nav footer aside form script style noscript template button select option textarea iframe svg math canvas object audio video dialog menu head title map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar share sharing social related recommended comment comments "
    "respond reply replies disqus subscribe newsletter signup login search pager pagination copyright widget".split()
)
_PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons container content entry form global group header head holder icons inner item items left line link links list "
    "main message outer page pages panel post posts primary right row secondary section side site slot text title top unit wrap wrapper".split()
)
_CLOSES_P = _BLOCK - frozenset(("li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "optgroup", "legend", "summary"))


def _names_a_part(name: str) -> bool:
    """Whether a class or id is a usual name of a page part, alone or with plain
    words (``site-footer``, ``comment-list``, not ``share-price``)."""
    parts = _PART.findall(name)
    return any(p in _NAMES for p in parts) and all(p in _NAMES or p in _PLAIN or p.isdigit() for p in parts)


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no main text by its name or attributes."""
    if tag in _SKIP or (tag == "header" and not in_article):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name = (m.group(1) or "hidden").lower()
        value = html.unescape(m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6") and any(map(_names_a_part, value.split())):
            return True
    return False


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The page's text blocks outside boilerplate elements, and for each whether
    it lies in an article (2), in the main element (1) or neither (0).

    Character references are decoded, white space inside a block becomes one
    space, blocks without text are none.  Unclosed elements end with their
    parents; an article ends a form that was left open before it.
    """
    out: list[str] = []
    zone: list[int] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool]] = []
    page = page or ""
    skipping = articles = mains = at = 0

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append(text)
                zone.append(2 if articles else 1 if mains else 0)

    def pop() -> None:
        nonlocal skipping, articles, mains
        tag, bad = stack.pop()
        skipping -= bad
        articles -= tag == "article"
        mains -= tag == "main"

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not skipping and m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m.group("tag") or m.group("tag2")
        if not tag:
            if m.group().startswith("<![CDATA[") and not skipping:
                buffer.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group("end") or m.group("end2"):
            if tag in _BLOCK:
                flush()
            if any(t == tag for t, _ in reversed(stack)):
                if tag in _BLOCK or tag in _SKIP or stack[-1][0] == tag:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                else:  # an inline end tag closes no block
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            skipping -= stack[i][1]
                            del stack[i]
                            break
                        if stack[i][0] in _BLOCK:
                            break
            elif tag == "p":
                flush()
            continue
        attrs = m.group("attrs") or m.group("attrs2") or ""
        if tag == "br":
            buffer.append(" ")
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P or tag == "p":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if tag in ("article", "main"):
                while any(t == "form" for t, _ in stack) and skipping:
                    pop()
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "select", "nav", "article", "div") or (tag in ("td", "th") and stack[i][0] == "tr"):
                        break
        if tag in _VOID or attrs.rstrip().endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*+[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        bad = _boilerplate(tag, attrs, articles > 0)
        stack.append((tag, bad))
        skipping += bad
        articles += tag == "article" and not skipping
        if tag == "article" and skipping:
            stack[-1] = ("section", bad)
        mains += tag == "main"
    if at < len(page) and not skipping:
        buffer.append(page[at:])
    flush()
    return out, zone


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path with query, by which pages are ordered."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc.rpartition("@")[2].lower(), parts.path + ("?" + parts.query if parts.query else ""))
    except ValueError:
        return ("", url or "")


def nearness(a: str, b: str) -> int:
    """Length of the common beginning of two paths, whole segments first."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return 1000 * a[:n].count("/") + n


def _keys(batches):
    for batch in batches:
        keys = [url_key(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])], names=["page_id", "host", "path"])


def _order(host: str, path: str, page_id: int | None) -> tuple:
    """Sorts as Spark sorts (host, path, page_id): by UTF-8 bytes, nulls first."""
    return (host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), -(2**64) if page_id is None else page_id)


def _scan(lows: list[tuple], firsts: set, lasts: set):
    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(batch.column(c) for c in range(3))):
                page_id, url = page_id.as_py(), url.as_py()
                host, path = url_key(url)
                found, zone = lines(page.as_py())
                blob = packer.compress(json.dumps([found, zone]).encode())
                key = _order(host, path, page_id)
                at = max(0, bisect_right(lows, key) - 1)
                rows.append((at, host, path, page_id, url, blob, False))
                if key in firsts and at > 0:
                    rows.append((at - 1, host, path, page_id, url, blob, True))
                if key in lasts and at + 1 < len(lows):
                    rows.append((at + 1, host, path, page_id, url, blob, True))
                if len(rows) >= 256:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["range", "host", "path", "page_id", "url", "blob", "guest"])


class _Page:
    __slots__ = ("guest", "host", "lines", "page_id", "path", "range", "url", "zone")

    def __init__(self, row: list, unpack):
        self.range, self.host, self.path, self.page_id, self.url, blob, self.guest = row
        self.lines, self.zone = json.loads(unpack(blob))


def shared_lines(page: list[str], other: list[str]) -> list[int] | None:
    """Positions of the page's lines that the other page has too, in order;
    None if the pages are copies of each other."""
    same = [i for i, _ in lcs(page, other)]
    size = sum(len(page[i]) for i in same)
    if size and size >= COPY * max(sum(map(len, page)), sum(map(len, other))):
        return None
    return same


def main_text(page: _Page, neighbours: list[_Page], trust_articles: bool = True) -> tuple[str, int, int]:
    """Text, number of lines kept, and number of lines shared with the nearest
    neighbour of the same host that is no copy.

    The text is that of the article and of the main element around it; without
    them, the whole page's; less the shared lines, but for a trusted article's.
    """
    near = sorted((n for n in neighbours if n is not None and n.host == page.host), key=lambda n: -nearness(page.path, n.path))
    same: set[int] = set()
    for n in near:
        found = shared_lines(page.lines, n.lines)
        if found is not None:
            same = set(found)
            break
    least = min(1, max(page.zone, default=0))
    kept = [t for i, (t, z) in enumerate(zip(page.lines, page.zone)) if z >= least and (i not in same or (z == 2 and trust_articles))]
    return "\n\n".join(kept), len(kept), len(same)


def _difference(trust_articles: bool):
    names = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())

    def pages(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield _Page(row, unpack)
        yield None

    def near(page: _Page, other: _Page | None) -> bool:
        return other is not None and other.range == page.range and other.host == page.host

    def run(batches):
        # copies next to each other share the page before them and the page after
        out, before, copies = [], None, []
        for after in pages(batches):
            if copies and near(copies[-1], after) and shared_lines(after.lines, copies[-1].lines) is None:
                copies.append(after)
                continue
            for page in copies:
                if page.guest:
                    continue
                text, n, shared = main_text(page, [p for p in (before, after) if near(page, p)], trust_articles)
                out.append((page.page_id, page.url, text, len(text), n, shared))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)
                    out = []
            before, copies = copies[-1] if copies else None, [after]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    return run


def extract(pages: DataFrame, trust_articles: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points), ``n_lines``
    kept and ``n_shared`` with the nearest page, for every row of ``pages``.

    Null or empty html gives an empty text; a null url orders as an empty host;
    null page_ids are carried through; repeated rows are copies of each other
    and give equal rows; other columns are ignored; an empty table gives no
    rows.
    """
    spark = pages.sparkSession
    source = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keys = source.select("page_id", "url").mapInArrow(_keys, "page_id long, host string, path string")
    n = source.select("page_id").count()
    ranges = min(10_000, max(1 + n // RANGE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.struct("host", "path", "page_id")
    dealt = keys.repartitionByRange(ranges, "host", "path", "page_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = sorted((_order(*r["low"]), _order(*r["high"])) for r in dealt.collect())  # two keys per range
    scanned = source.mapInArrow(
        _scan([e[0] for e in ends], {e[0] for e in ends}, {e[1] for e in ends}),
        "range int, host string, path string, page_id long, url string, blob binary, guest boolean",
    )
    order = ("range", "host", "path", "page_id", "url", "guest")
    return scanned.repartition(3 * len(ends) or 1, "range").sortWithinPartitions(*order).mapInArrow(_difference(trust_articles), SCHEMA)
