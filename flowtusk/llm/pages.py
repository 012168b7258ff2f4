"""Main text of web pages: structure first, and nearest-URL differencing where structure is silent.

A page is cut into blocks, the text lines of its block elements. What the markup calls a menu,
header, footer, sidebar, notice, advert, form or comment is out; article and main elements are in.
Lines outside of such elements are open: they count on a page without them, and where articles hold
less than what is open, as teasers do. Where only a part of a name speaks against an element, its
lines are as open ones; of names that tell of readers' comments, the same element on the nearest pages
is enough, whatever it says there. For open lines, the pages of a
host are sorted by path, each page is paired with the neighbour whose path has more in common
with its own, the two pages' lines are aligned by their longest common subsequence, and shared
lines are deleted.

Differencing alone deletes what articles share and keeps menus that differ on every page, so it
only decides where the markup does not.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty
from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
_SELF_CLOSED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>"""
#: Comments, elements whose content is no text, declarations, tags; a broken tag ends at the next `>`.
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg(?!{_SELF_CLOSED})|iframe|select|title|canvas|annotation-xml|annotation)"""
    rf"""(?=[\s/>]){_ATTRIBUTES}>"""
    rf""".*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_ATTRIBUTES}>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_NAME_WORDS = re.compile(r"[^a-z0-9]+")

#: Elements that begin and end a block, and those without an end tag.
BLOCKS = frozenset((
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are never main text, and words of class, id and role that say the same.
LEFT_OUT = frozenset("aside button dialog fieldset footer form head menu nav".split())
LEFT_OUT_WORDS = frozenset((
    "ad ads adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay sidebar complementary menu nav navbar "
    "navigation breadcrumb breadcrumbs footer contentinfo comment comments commentlist replies respond disqus newsletter "
    "subscribe signup login search form dialog").split())
#: Words that only count outside of an article, where a header is the site's.
OUTER_WORDS = frozenset("header masthead topbar".split())
#: Names of several words that say it as surely as one word that is the whole name.
LEFT_OUT_NAMES = frozenset((
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper google-ad google-ads sponsored-content cookie-banner "
    "cookie-bar cookie-consent cookie-notice cookies-banner gdpr-banner consent-banner alert-banner notification-bar "
    "modal-dialog left-sidebar right-sidebar sidebar-left sidebar-right main-nav main-navigation main-menu nav-bar nav-menu "
    "navigation-menu site-nav site-navigation site-menu site-footer page-footer global-footer footer-nav breadcrumb-nav "
    "comment-form comment-list comment-respond comments-area comments-section comment-section disqus-thread "
    "newsletter-form newsletter-signup sign-up signup-form login-form search-bar search-box search-form").split())
OUTER_NAMES = frozenset("global-header site-header top-bar".split())
#: Elements whose id is often a slug of their own title; an article's classes name its state.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a page's main text and may be named after what surrounds it.
_HOLDERS = frozenset("html body main".split())

OUT, OPEN, MAIN, ARTICLE = range(4)


#: Words of readers' comments. Their text differs on every page, so neighbours are compared by place; and
#: those that are enough at the end or at the beginning of a class of a box or list.
READER_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
_AT_END = frozenset("comment comments reply replies".split())
_AT_BEGIN = frozenset("comment reply".split())
_BOXES = frozenset("div section ul ol li aside".split())

NO, YES, MAYBE = "", "yes", "maybe"


def _left_out(tag: str, attributes: str, inside: bool) -> str:
    """YES if an element is left out: by itself, by a whole name, or by an end of a box's class. If only another part of a
    name speaks against it, it depends on the neighbours: the tag and the name if that is of readers' comments, else
    MAYBE. NO (empty) otherwise. Parts do not count on headings and articles, nor in ids of sections."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return YES
    if tag in _HOLDERS or "=" not in attributes:
        return NO
    found = NO
    for attribute, value in _NAMES.findall(attributes):
        is_id = attribute.lower() == "id"
        if is_id and tag in _HEADINGS:
            continue
        for name in value.strip("\"'").lower().split():
            words = [word for word in _NAME_WORDS.split(name) if word]
            if not words or words[0] in ("has", "with", "no", "is"):
                continue  # about the content, not what it is
            whole, slug = "-".join(words), is_id and tag in ("article", "section")
            if len(words) == 1 and (whole in LEFT_OUT_WORDS or not inside and whole in OUTER_WORDS):
                return YES
            if not slug and (whole in LEFT_OUT_NAMES or not inside and whole in OUTER_NAMES):
                return YES
            if not is_id and tag in _BOXES and (words[-1] in _AT_END or words[0] in _AT_BEGIN):
                return YES
            if found in (NO, MAYBE) and not slug and tag not in _HEADINGS and tag != "article" and (
                    not LEFT_OUT_WORDS.isdisjoint(words) or not inside and not OUTER_WORDS.isdisjoint(words)):
                found = MAYBE if READER_WORDS.isdisjoint(words) else f"{tag}.{whole}"
    return found


class Place(NamedTuple):
    """Where a line stands: its kind, the number of the outermost article, whether a main element holds it,
    and the outermost element around it against which a part of a name speaks."""
    kind: int = OPEN
    article: int = 0
    main: bool = False
    doubt: str = ""


def page_lines(source: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order."""
    return [(place.kind, text) for place, text in placed_lines(source)]


def placed_lines(source: str) -> list[tuple[Place, str]]:
    """(place, text) of each block with text, in page order."""
    lines: list[tuple[Place, str]] = []
    held: list[str] = []
    stack: list[tuple[str, Place]] = []  # open elements that matter, with the place of what they hold
    place, at, articles = Place(), 0, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            lines.append((place, text))
        held.clear()

    for token in _TOKEN.finditer(source):
        if token.start() > at:
            held.append(source[at:token.start()])
        at = token.end()
        tag = token[4]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if token[3]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    place = stack[-1][1] if stack else Place()
                    break
            continue
        if block and stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            stack.pop()
            place = stack[-1][1] if stack else Place()
        if tag in VOID or token[5].endswith("/") and not block:
            continue
        kind, inner = place.kind, place
        judged = _left_out(tag, token[5], kind >= MAIN) if kind != OUT else NO
        if judged == YES:
            inner = place._replace(kind=OUT)
        elif kind != OUT:
            main = place.main or tag == "main" or _ROLE_MAIN.search(token[5]) is not None
            if tag == "article":
                articles += not place.article
                inner = Place(ARTICLE, place.article or articles, main, place.doubt)
            elif kind == OPEN and main:
                inner = Place(MAIN, 0, True, place.doubt)
            if judged and place.doubt in (NO, MAYBE):
                inner = inner._replace(doubt=judged)
        if inner != place or block and tag != "li":
            if inner != place:
                flush()
            stack.append((tag, inner))
            place = inner
    held.append(source[at:])
    flush()
    return lines


def candidates(lines: list[tuple[Place, str]], structure: bool = True) -> tuple[list[str], list[bool]]:
    """The lines that may be main text, and for each whether the markup says so; the others are left
    to differencing.

    A main element excludes what is open. What lies beside articles is left out only if it is open
    and less than the largest article (a teaser is an article too); in a main element it is sure if
    more than that, else differenced. So are lines against which a part of a name speaks.
    """
    chosen = _chosen(lines, structure)
    return [text for _, text, _ in chosen], [sure for _, _, sure in chosen]


def _chosen(lines: list[tuple[Place, str]], structure: bool) -> list[tuple[Place, str, bool]]:
    if not structure:
        return [(Place(), text, False) for _, text in lines]
    sizes, articles = [0] * 4, {0: 0}
    for place, text in lines:
        sizes[place.kind] += len(text)
        if place.kind == ARTICLE:
            articles[place.article] = articles.get(place.article, 0) + len(text)
    outer = MAIN if any(place.main and place.kind >= MAIN for place, _ in lines) else OPEN
    more = sizes[outer] > max(articles.values())
    return [(place, text, not place.doubt and (place.kind == ARTICLE or place.kind == MAIN and more)) for place, text in lines
            if place.kind == ARTICLE or place.kind == outer and (outer == MAIN or more)]


def common_lines(a: Sequence[int], b: Sequence[int], cells: int = 40_000_000) -> list[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`.

    Rows of the usual table are kept as bits of one integer each. Above `cells` bits the longer
    problem is halved where the two parts together are longest, so memory stays bounded.
    """
    begin, end_a, end_b = 0, len(a), len(b)
    while begin < min(end_a, end_b) and a[begin] == b[begin]:
        begin += 1
    while end_a > begin and end_b > begin and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    head, tail = list(range(begin)), list(range(end_a, len(a)))
    x, y = a[begin:end_a], b[begin:end_b]
    if not x or not y:
        return head + tail

    def rows(x: Sequence[int], y: Sequence[int], keep: bool) -> list[int]:
        """After each element of x: bit j is 0 where element j of y makes the subsequence longer."""
        where: dict[int, int] = {}
        for j, value in enumerate(y):
            where[value] = where.get(value, 0) | 1 << j
        full = (1 << len(y)) - 1
        row, kept = full, []
        for value in x:
            hit = row & where.get(value, 0)
            row = ((row + hit) | (row - hit)) & full
            if keep:
                kept.append(row)
        return kept if keep else [row]

    def lengths(row: int, n: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    if len(x) > 1 and len(x) * len(y) > cells:
        half = len(x) // 2
        first = lengths(rows(x[:half], y, False)[0], len(y))
        second = lengths(rows(x[half:][::-1], y[::-1], False)[0], len(y))[::-1]
        cut = int(np.argmax(first + second))
        inner = common_lines(x[:half], y[:cut], cells) + [half + i for i in common_lines(x[half:], y[cut:], cells)]
    else:
        table, inner, j = rows(x, y, True), [], len(y)
        for i in range(len(x) - 1, -1, -1):
            row = table[i] & ((1 << j) - 1)
            before = (table[i - 1] if i else -1) & ((1 << j) - 1)
            if row.bit_count() < before.bit_count():  # x[i] makes it longer: match its last place in y
                j = max(k for k in range(j) if y[k] == x[i]) if y[j - 1] != x[i] else j - 1
                inner.append(i)
        inner.reverse()
    return head + [begin + i for i in inner] + tail


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _parsed(pages: DataFrame, structure: bool) -> DataFrame:
    """Per page: text if structure decides it, else the lines that may be text, whether they surely are and the
    doubtful element each lies in (0: none); hashes of all lines and of all doubtful elements."""
    # Arrow batches: in pandas a null id would turn the ids beside it into floats.
    def parse(batches) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), longs, longs, longs]
        for batch in arrow_slices(batches, "html"):
            rows = []
            for source in batch.column("html").to_pylist():
                lines = placed_lines(source)
                chosen = _chosen(lines, structure)
                own, sure = [text for _, text, _ in chosen], [sure for _, _, sure in chosen]
                hashes = [_hash(text) for _, text in lines]
                marks = sorted({_hash(place.doubt) for place, _ in lines if place.doubt not in (NO, MAYBE)})
                if all(sure):
                    rows.append(("\n".join(own), None, None, None, hashes, marks))
                else:
                    rows.append((None, own, sure, [_hash(place.doubt) if place.doubt not in (NO, MAYBE) else 0 for place, _, _ in chosen], hashes, marks))
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["html"]).columns, *columns],
                                             ["row", "page_id", "url", "text", "open", "sure", "doubts", "lines", "marks"])

    kinds = dict(pages.dtypes)
    return store(pages.mapInArrow(parse, f"row bigint, page_id {kinds['page_id']}, url string, text string, open array<string>, "
                                   "sure array<boolean>, doubts array<bigint>, lines array<bigint>, marks array<bigint>"), "pages")


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leave out unsure lines that the nearest page has too, and lines of a doubtful element that a neighbour has
    as well, whatever it says there: it belongs to the pages' template."""
    for frame in frames:
        texts = []
        for r in frame.itertuples(index=False):
            sides = [(len(os.path.commonprefix([r.path, path])), lines)
                     for path, lines in ((r.path_before, r.lines_before), (r.path_after, r.lines_after)) if path is not None]
            unsure = [i for i, sure in enumerate(r.sure) if not sure]
            own = [_hash(r.open[i]) for i in unsure]
            nearest = max(sides, key=lambda side: side[0])[1] if sides else []
            shared = {unsure[i] for i in common_lines(own, [int(h) for h in nearest])}
            template = {int(mark) for marks in (r.marks_before, r.marks_after) if marks is not None for mark in marks}
            shared |= {i for i, doubt in enumerate(r.doubts) if doubt and int(doubt) in template}
            texts.append("\n".join(text for i, text in enumerate(r.open) if i not in shared))
        yield pd.DataFrame({"row": frame["row"], "text": texts})


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html",
                  structure: bool = True) -> DataFrame:
    """The main text of every row: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by line ends. A null or empty page has no text and is no neighbour. A page without url,
    or alone on its host, has no neighbour and loses no open or doubtful line. Pages of equal path are neighbours in the
    order of page_id; repeated rows are repeated, and share all open lines with each other.
    With `structure` off, only differencing is used. Other columns are not read. Runs jobs.
    """
    named = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
                         F.col(url).alias("url"), text_or_empty(source).alias("html"))
    parsed = _parsed(named, structure)
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    slim = parsed.filter(F.col("url").isNotNull() & (F.size("lines") > 0)).select("row", "page_id", host.alias("host"), path.alias("path"), "lines", "marks")
    placed = with_global_position(slim, ["host", "path", "page_id", "row"])
    side = placed.select("host", "position", "path", "lines", "marks")
    wanted = placed.drop("lines", "marks").join(parsed.filter(F.col("open").isNotNull()).select("row", "open", "sure", "doubts"), "row")
    before, after = (side.toDF("host", "position", *[f"{c}_{name}" for c in ("path", "lines", "marks")])
                     .withColumn("position", F.col("position") + step) for name, step in (("before", 1), ("after", -1)))
    pairs = wanted.join(before, ["host", "position"], "left").join(after, ["host", "position"], "left")
    decided = pairs.select("row", "path", "open", "sure", "doubts", *[f"{c}_{name}" for name in ("before", "after") for c in (
        "path", "lines", "marks")]).mapInPandas(_shared, "row bigint, text string")
    alone = parsed.filter(F.col("open").isNotNull() & F.col("url").isNull()).select("row", F.array_join("open", "\n").alias("text"))
    open_pages = parsed.filter(F.col("open").isNotNull()).select("row", "page_id", "url").join(decided.unionByName(alone), "row")
    result = parsed.filter(F.col("open").isNull()).select("page_id", "url", "text").unionByName(
        open_pages.select("page_id", "url", "text"))
    return result.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
