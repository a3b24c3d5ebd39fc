"""HTML extraction by page differencing.

A page becomes text lines, one for each block element. Pages are put in the order of host, URL path and id; a page is
paired with that neighbour of its host whose path shares the longer beginning with its own (the earlier one on ties). The lines of both are
aligned by longest common subsequence, and shared lines are deleted:

- outside an article, a line that the paired page has too;
- inside an article, where two pages may quote one text, a line that each of the SPREAD nearest pages of the host has too (half of them before and half
  behind the page), and that stands, with others of its kind, before the first or behind the last line of the article's own. Copies of a whole article
  tell nothing about templates and protect it.

Then what markup names as boilerplate goes too, since menus and adverts can be new on every page: navigation, headers, footers, sidebars,
notices, forms and reader comments. A class, id or role names boilerplate when a whole name of it does; inside an article only those of
containers count, so headings and paragraphs stay whatever they are called, unless a class or role calls them adverts.

Tags are read in one pass, so time is linear in the length of a page however broken it is. A stray quote ends with its tag; a tag that never ends takes the rest
of the page, as in browsers, and no part of a tag becomes text.

Lines outside an article stay where neither differencing nor markup deletes them: an article element can be a teaser or
the first of several sections. Null and empty pages give an empty text, an empty table an empty result; a null url is a host of its own;
equal rows stay rows of their own, and other columns are not read. Long pages are aligned with bit rows, of which only some are kept.
"""

from __future__ import annotations

import html
import re
import struct
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import partitions, read_table

# Element names by role, and words in class, id or role that name boilerplate.
UNSEEN = frozenset("script style noscript template iframe svg canvas video audio select textarea title".split())
APART = frozenset("nav header footer aside form button menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar header masthead footer cookie cookies consent notice notices popup modal newsletter subscribe "
    "signup login search share sharing social related recommended comments comment disqus respond reply replies widget "
    "pagination pager skip complementary contentinfo alert toolbar".split()
)
#: Names that may stand beside those words in one name, as in comment-list or top-menu.
BESIDE = frozenset(
    "list section area box wrap wrapper container block inner outer item items bar site page global main thread form button buttons link links slot unit "
    "top bottom left right js copyright legal posts trail primary secondary fixed sticky mobile desktop google dfp region zone holder panel".split()
)
#: Words that name an advert, which count on any element.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
#: Elements whose other names count inside an article, and words that don't count there: they may be an article's own heading.
CONTAINERS = frozenset("div section ul ol dl table span figure".split())
HEADING = frozenset(("header", "masthead"))
#: Elements that an open p ends at, and those that end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_KEY = re.compile(r"[\s/]*(>|[^\s/>][^\s/>=]*)")
_VALUE = re.compile(r"\s*=\s*([\"']?)")
_BARE = re.compile(r"[^\s>]*")
_NAME = re.compile(r"[a-z0-9]+")
_PIECES = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)([^?#]*)")

SHOWN, HELD, DROPPED = 0, 1, 2
#: Pages around a page that a template inside articles must stand on: half before, half behind it.
SPREAD = 4
#: Rows of an alignment that are made again at a time.
KEPT_ROWS = 256


def _boilerplate(name: str, attributes: dict[str, str], zone: int) -> bool:
    """Whether an element's class, role or id names boilerplate: a name made of such words, and of words that go with them, only."""
    named = NAMED if zone != HELD else NAMED - HEADING if name in CONTAINERS else ADVERTS
    for key in ("class", "id", "role"):
        if zone == HELD and name not in CONTAINERS - {"section"} and key == "id":
            continue  # made of its heading
        for value in attributes.get(key, "").split():
            words = [w for w in _NAME.findall(_PIECES.sub(" ", value).lower()) if w.isalpha()]
            if not named.isdisjoint(words) and all(w in named or w in BESIDE for w in words):
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """(start, end, name, is an end tag, attributes, closes itself) of each tag of a page, in one pass; comments have an empty name.

    Quotes open a value right behind ``=`` only, so stray ones end with their tag. A quote that is never closed doesn't count, and a tag that never ends
    takes the rest of the page. The caller may ``send`` a place to go on from.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    at = page.find("<")
    while at >= 0:
        m = _TAG.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                end = end + 3 if end >= 0 else len(page)
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at < last[">"]:
                end = page.find(">", at) + 1
            else:
                at = page.find("<", at + 1)
                continue
            sent = yield at, end, "", False, {}, False
        else:
            end, attributes, alone = m.end(), {}, False
            while True:
                key = _KEY.match(page, end) if end <= last[">"] else None
                if key is None:
                    end = len(page)
                    break
                if key[1] == ">":
                    end, alone = key.end(), key.end() - key.start() > 1 and page[key.end() - 2] == "/"
                    break
                end = key.end()
                value = _VALUE.match(page, end)
                told = ""
                if value:
                    end, quote = value.end(), value[1]
                    if quote and end <= last[quote]:
                        close = page.find(quote, end)
                        told, end = page[end:close], close + 1
                    else:
                        bare = _BARE.match(page, end)
                        told, end = bare[0], bare.end()
                attributes.setdefault(key[1].lower(), html.unescape(told) if "&" in told else told)
            sent = yield at, end, m[1].lower(), page[at + 1] == "/", attributes, alone
        at = page.find("<", end if sent is None else sent)


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) for each block of a page, in order: SHOWN, HELD in its article, or DROPPED by its markup."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    open_tags: list[tuple[str, int]] = []  # names and the zone outside them
    opened: Counter = Counter()  # how many of each name are open
    zone, at, go_on = SHOWN, 0, None
    tags = _tags(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    while True:
        try:
            start, end, name, closing, attributes, alone = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name == "br":
                parts.append(" ")
            if opened[name]:
                k = next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name)
                if name not in INLINE or open_tags[k][1] != zone:
                    flush()
                zone = open_tags[k][1]
                opened.subtract(t for t, _ in open_tags[k:])
                del open_tags[k:]
            continue
        if name in UNSEEN:
            if not alone:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = go_on = page.find(">", close.end()) + 1 or len(page) if close else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            closes = ("p",) if name in ENDS_P else ()
            closes += ENDS_OWN.get(name, ())
            while open_tags and (open_tags[-1][0] in closes or open_tags[-1][0] in INLINE and any(opened[t] for t in closes)):
                gone, zone = open_tags.pop()
                opened[gone] -= 1
        inner = zone
        if zone != DROPPED:
            # A header inside an article is often its heading; outside it is the site's.
            if name in APART and not (name == "header" and zone == HELD) or _boilerplate(name, attributes, zone) and name not in ("html", "body", "article", "main"):
                inner = DROPPED
            elif name in ARTICLE or attributes.get("itemprop", "").lower() == "articlebody":
                inner = HELD
        if inner != zone and name in INLINE:
            flush()
        if not alone:
            open_tags.append((name, zone))
            opened[name] += 1
            zone = inner
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def lcs_shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: common ends first, then what lies in between."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [*range(lo), *range(len(a) - hi, len(a))]
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    if not both:
        return out
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    places: dict[int, int] = {}
    n = 0
    for k in b[lo : len(b) - hi]:
        if k in both:
            places[k] = places.get(k, 0) | 1 << n
            n += 1
    return out + [x[i] for i in _aligned([places[a[i]] for i in x], n)]


def _aligned(places: list[int], n: int) -> list[int]:
    """Rows that a longest common subsequence uses, from each row's bit set of equal columns.

    A row of the table is a number of ``n`` bits: a 0 where the length grows. Rows at the beginning of each stretch of KEPT_ROWS are kept, the others
    made again on the way back, so a long page needs no whole table.
    """
    full = (1 << n) - 1

    def below(row: int, at: int) -> int:
        same = row & places[at]
        return (row + same | row - same) & full

    row, marks = full, []
    for at in range(len(places)):
        if at % KEPT_ROWS == 0:
            marks.append(row)
        row = below(row, at)
    out: list[int] = []
    i, j = len(places), n
    while marks and j:
        first = (len(marks) - 1) * KEPT_ROWS
        rows = [marks.pop()]
        for at in range(first, i):
            rows.append(below(rows[-1], at))
        while i > first and j:
            if rows[i - first] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i - first] >> (j - 1) & 1:  # the row above doesn't grow here: this row's own match
                    out.append(i)
                    j -= 1
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (without www. and m.) and path."""
    m = _HOST.match(url or "")
    if m is None:
        return "", url or ""
    host = re.sub(r"^(?:www|m)\.", "", m[1].lower().split("@")[-1])
    return host, m[2].rstrip("/")


def _pack(zones: list[int], keys: list[int]) -> bytes:
    return struct.pack(f"<{len(keys)}B{len(keys)}q", *zones, *keys)


def _unpack(blob: bytes) -> tuple[bytes, list[int]]:
    n = len(blob) // 9
    return blob[:n], list(struct.unpack(f"<{n}q", blob[n:]))


def _shared_begin(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _ranges(keyed: DataFrame) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First key of each range of (host, path, page_id), and the ranges that a row is also sent to, by its key.

    There are ranges in proportion to the input's splits. The driver gets the first and last SPREAD / 2 keys of each, whatever a range holds.
    """
    n = max(partitions(keyed.sparkSession), keyed.rdd.getNumPartitions()) * 2
    near = SPREAD // 2

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[tuple] = []
        last: list[tuple] = []
        for b in batches:
            rows = list(zip(b["host"], b["path"], b["page_id"].tolist()))
            first += rows[: max(0, near - len(first))]
            last = (last + rows)[-near:]
        keys = [*[(0, *k) for k in first], *[(1, *k) for k in last]]
        yield pd.DataFrame([(first[0][0], first[0][1], first[0][2], *k) for k in keys] if keys else [], columns=["h", "p", "i", "side", "host", "path", "page_id"])

    dealt = keyed.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    found: dict[tuple, tuple[list, list]] = {}
    for r in dealt.mapInPandas(ends, "h string, p string, i long, side int, host string, path string, page_id long").collect():  # a few keys a range
        found.setdefault((r["h"], r["p"], r["i"]), ([], []))[r["side"]].append((r["host"], r["path"], r["page_id"]))
    los = sorted(found)
    sent: dict[tuple, list[int]] = {}
    for k in range(len(los)):
        for step, side in ((-1, 1), (1, 0)):
            other, missing = k + step, near
            while 0 <= other < len(los) and missing > 0:
                keys = found[los[other]][side]
                for key in keys[-missing:] if side else keys[:missing]:
                    if k not in sent.setdefault(key, []):
                        sent[key].append(k)
                missing -= len(keys)
                other += step
    return los, sent


def _own_lines(zones: bytes, keys: list[int], path: str, before: list, after: list) -> list[int]:
    """Positions of the lines that are the page's own. ``before`` and ``after``: neighbours of its host (path, zones, keys), nearest first."""
    pair = min([(-_shared_begin(path, x[0]), k, x) for k, side in enumerate((before, after)) for x in side[:1]], default=None, key=lambda x: x[:2])
    gone = {i for i in lcs_shared(keys, pair[2][2]) if zones[i] == SHOWN} if pair else set()
    article = [i for i, z in enumerate(zones) if z == HELD]
    if article and len(before) + len(after) == SPREAD:
        mine = [keys[i] for i in article]
        spread = set(range(len(mine)))
        for _, z, other in (*before, *after):
            shared = lcs_shared(mine, [k for k, y in zip(other, z) if y == HELD])
            spread &= set(shared) if len(shared) < len(mine) else set()
        lo = next((i for i in range(len(mine)) if i not in spread), len(mine))
        hi = next((i for i in range(len(mine)) if len(mine) - 1 - i not in spread), len(mine))
        gone |= {*article[:lo], *article[len(mine) - hi :]}
    return [i for i, z in enumerate(zones) if z != DROPPED and i not in gone]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html).

    Texts move once, compressed, to the range of their URL. Pages near the border of a range are also sent, without their
    texts, to the ranges whose pages they are neighbours of, so results do not depend on how many ranges there are.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    @F.pandas_udf("host string, path string")
    def parts(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_url(u) for u in url], columns=["host", "path"])

    keyed = pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("page_id"), parts("url").alias("u")).select("page_id", "u.host", "u.path")
    los, sent = _ranges(keyed)
    bounds = spark.sparkContext.broadcast((los, sent))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(3).compress
        los, sent = bounds.value
        for b in batches:
            rows = []
            for page_id, url, page in zip(b["page_id"], b["url"], b["html"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                host, path = split_url(url)
                key = (host, path, -(2**63) if page_id is None else page_id)
                found = page_lines(page)
                lines = _pack([z for z, _ in found], [xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in found])
                text = squeeze("\n".join(t for _, t in found).encode())
                rows.append((max(0, bisect_right(los, key) - 1), 1, host, path, page_id, url, lines, text))
                rows += [(k, 0, host, path, page_id, url, lines, None) for k in sent.get(key, ())]
            yield pd.DataFrame(rows, columns=["block", "own", "host", "path", "page_id", "url", "lines", "text"]).astype({"page_id": "Int64"})

    def differenced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows, one after another, with only their neighbours in memory."""
        import zstandard

        spread, near = zstandard.ZstdDecompressor(), SPREAD // 2
        window: deque = deque(maxlen=SPREAD + 1)

        def finish() -> list[tuple]:
            row = window[near]
            if row is None or not row.own:
                return []
            of = lambda xs: [(x.path, *_unpack(x.lines)) for x in xs if x is not None and x.host == row.host]
            zones, keys = _unpack(row.lines)
            before, after = of([window[k] for k in range(near - 1, -1, -1)]), of([window[k] for k in range(near + 1, SPREAD + 1)])
            lines = spread.decompress(row.text).decode().split("\n") if keys else []
            text = " ".join(lines[i] for i in _own_lines(zones, keys, row.path, before, after))
            return [(None if pd.isna(row.page_id) else int(row.page_id), row.url, text, len(text))]

        window.extend([None] * (SPREAD + 1))
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                window.append(row)
                rows += finish()
            yield _told(rows)
        rows = []
        for _ in range(near):
            window.append(None)
            rows += finish()
        yield _told(rows)

    schema = "block int, own int, host string, path string, page_id long, url string, lines binary, text binary"
    dealt = pages.mapInPandas(parsed, schema).repartitionById(max(1, len(los)), "block").sortWithinPartitions("host", "path", "page_id", "url", "lines", "own")
    return dealt.mapInPandas(differenced, "page_id long, url string, text string, n_chars long")


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
