"""Operator 6: main text of web pages, by differences between nearest pages and by structure.

Each page is cut into lines (the text of one block). All pages are sorted by host and URL path, each is
aligned with the pages before and after it on its host by the longest common subsequence of lines, and lines
that they share are the site's own; lines that a neighbour marks as its article are not asked for. A check by
the page's marks follows: lines in elements that are never content (menus, forms, adverts, comments ...) go even
if they differ, and where a page marks its article, the lines in it stay even if a neighbour has them, and the
others go. Of pages without such a mark the shared lines go.

Differences alone can't give the right text where menus, adverts and footers change from page to
page, or where neighbours carry copies of one article; hence the check.
Pages are sorted over ranges, and the pages at the ends of ranges are compared across the border,
so the result doesn't depend on where ranges end.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import if_small, materialise, tasks

#: The attributes of a tag: a value is quoted only if it begins with a quote. Nothing is tried twice.
_ATTRIBUTES = r"(?>(?:=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*)"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment
    rf"|<(script|style|noscript|template|iframe|textarea|title|xmp|noframes)\b{_ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|\Z)"  # with all it holds
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)"  # a tag
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TELLING = re.compile(r"class|id|role|style|hidden", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements that end a block of text where they begin and end.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose ends are tracked; the others may be left open.
_NESTED = frozenset(
    "address article aside blockquote body button details dialog div dl fieldset figure footer form head header html main menu nav ol search section select svg table ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer dialog menu button search header".split())
#: What stands in these isn't shown as text.
_UNSHOWN = frozenset("head select svg".split())
#: What an element of _NEVER that is left open holds no more.
_TEXT_BEGINS = frozenset("article blockquote h1 h2 h3 h4 h5 h6 main p section".split())
#: Seldom content; but a page may stand in one form.
_SELDOM = frozenset("form fieldset".split())
_COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
_NEVER_NAMES = _COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored banner sidebar cookie cookies "
    "consent notice notices alert popup modal overlay promo promotion newsletter subscribe signup login social share sharing related recommended "
    "breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination pager widget toolbar search complementary contentinfo".split()
)
#: What may stand beside such a word in one name, as in share-buttons; has-sidebar and related-work are other things.
_BESIDE = frozenset(
    "area articles bar block bottom box button buttons container content form global google header icons inline inner item items leaderboard left link links list main "
    "middle mobile page panel post posts primary reader readers right secondary section site slot sticky stories thread title top unit user users visitor wrap wrapper".split()
)


def _is_never(word: str) -> bool:
    """Whether a word is such a name, or one and a word beside it written together."""
    return word in _NEVER_NAMES or any(word[:k] in _NEVER_NAMES and word[k:] in _BESIDE for k in range(2, len(word) - 2))


def _named(attributes: str) -> frozenset[str]:
    """The words of names (whole class names, ids, roles) that are never content; ``hidden`` if the element isn't shown."""
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            for token in value.lower().split():
                words = {w for w in re.split(r"[^a-z]+", token) if len(w) > 1}  # 300x250 has no word
                never = {w for w in words if _is_never(w)}
                if words <= never | _BESIDE:
                    found |= never
    return frozenset(found)


@dataclass(slots=True)
class _Element:
    name: str
    #: Where its tag stands in the page.
    start: int = -1
    #: Whether its end is missed if it isn't there.
    watched: bool = False
    #: Text in it isn't shown; text in it goes, but it stands inside a line; it ends where a block begins or ends.
    unshown: bool = False
    inline: bool = False
    loose: bool = False
    article: bool = False
    main: bool = False
    #: Why it is left out: a place in the list of reasons, or -1; whether it is its own.
    reason: int = -1
    own: bool = False
    #: Blocks that have begun in an inline element and haven't ended.
    depth: int = 0


@dataclass(slots=True)
class _Reason:
    """An element left out: the reason around it, whether it is its tag or its name, and what it holds."""

    around: int
    by_tag: bool
    comments: bool
    holds: bool = False


class _Reader:
    """One reading of a page. ``left_open`` are the starts of elements known to have no end of their own."""

    def __init__(self, page: str, names: bool, left_open: frozenset[int]):
        self.page, self.names, self.left_open = page, names, left_open
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.reasons: list[_Reason] = []
        self.held: list[str] = []
        self.stack: list[_Element] = []
        self.outside = _Element("")
        self.counts: dict[str, int] = {}  # of names on the stack
        self.missed: set[int] = set()
        self.lifted_to = 0  # elements of the stack below have been lifted

    def read(self) -> _Reader:
        at, page = 0, self.page
        for m in _TOKEN.finditer(page):
            top = self._top()
            if m.start() > at and not top.unshown and not top.inline:
                self.held.append(page[at : m.start()])
            at = m.end()
            if m[3] is not None:
                self._tag(m[3].lower(), bool(m[2]), m[4], m.start())
        top = self._top()
        if not top.unshown and not top.inline:
            self.held.append(page[at:])
        self._close()
        self._cut(0)
        return self

    def _top(self) -> _Element:
        return self.stack[-1] if self.stack else self.outside

    def _line_state(self) -> _Element:
        return next((e for e in reversed(self.stack) if not e.inline), self.outside)

    def _close(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                e = self._line_state()
                self.lines.append((text, e.reason, e.article, e.main))

    def _cut(self, k: int, own_end: bool = False) -> None:
        """Elements from place k of the stack on end; the first of them by its own tag if ``own_end``."""
        for i, e in enumerate(self.stack[k:]):
            if e.watched and not (own_end and i == 0):
                self.missed.add(e.start)
            self.counts[e.name] -= 1
        del self.stack[k:]
        self.lifted_to = min(self.lifted_to, k)

    def _tag(self, name: str, is_end: bool, attributes: str, start: int) -> None:
        if name == "br":
            if not self._top().inline:
                self.held.append(" ")
            return
        top, block = self._top(), name in _BLOCKS
        if top.name == "svg" and name != "svg":
            return
        if block:
            self._close()
            self._end_loose(name, is_end)
        if is_end:
            if self.counts.get(name):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k].name == name:
                        if not self.stack[k].inline and not block:
                            self._close() if name != "svg" else None
                        self._cut(k, own_end=True)
                        break
            return
        if name in _VOID or (attributes.rstrip().endswith("/") and (name in _NESTED or not block)):
            return
        opened = start in self.left_open
        if opened and name in _UNSHOWN:
            return
        words: frozenset[str] = frozenset()
        if self.names and name not in ("body", "html", "main") and _TELLING.search(attributes):
            words = _named(attributes)
            if name == "article":
                words &= _COMMENT_NAMES | {"hidden"}
        if name not in _NESTED and not words and not self.counts.get(name):
            return
        self._push(name, words, block, opened, start)

    def _end_loose(self, name: str, is_end: bool) -> None:
        """What ends where a block begins or ends, and what a text ends that was left open."""
        while self.stack and (self._top().loose or (self._top().name == "head" and not is_end)):
            self._cut(len(self.stack) - 1, own_end=True)
        if self._top().inline:
            if not is_end:
                self._top().depth += 1
            elif self._top().depth:
                self._top().depth -= 1
            elif self._top().name != name:  # the element around it ends
                self._cut(len(self.stack) - 1)
        if not is_end and name in _TEXT_BEGINS and self.left_open:
            self._lift()

    def _lift(self) -> None:
        """From here on what was left open on the stack leaves nothing out; each element is seen once."""
        new = {-1: -1}
        for e in self.stack[self.lifted_to :]:
            if e.reason not in new:
                old = self.reasons[e.reason]
                around = new.get(old.around, old.around)
                if e.start in self.left_open and e.own:
                    new[e.reason] = around
                elif around == old.around:
                    new[e.reason] = e.reason
                else:
                    self.reasons.append(_Reason(around, old.by_tag, old.comments, old.holds))
                    new[e.reason] = len(self.reasons) - 1
            e.reason = new[e.reason]
        self.lifted_to = len(self.stack)

    def _push(self, name: str, words: frozenset[str], block: bool, opened: bool, start: int) -> None:
        state = self._top()
        reason = state.reason
        if name in ("article", "main") and not words and reason >= 0 and not self.reasons[reason].comments:
            r = reason
            while r >= 0 and not self.reasons[r].holds:
                self.reasons[r].holds = True
                r = self.reasons[r].around
        by_tag = name in _NEVER and not (name == "header" and state.article)
        inline = name not in _NESTED and not block and (bool(words) or state.inline)
        if by_tag or words or (self.names and name in _SELDOM):
            within = reason >= 0 and self.reasons[reason].comments
            self.reasons.append(_Reason(reason, by_tag, within or not _COMMENT_NAMES.isdisjoint(words)))
            reason = len(self.reasons) - 1
        loose = name == "p" or (name not in _NESTED and opened)
        watched = not loose and (by_tag or name in _UNSHOWN or bool(words))
        article, main = state.article or name == "article", state.main or name == "main"
        self.stack.append(_Element(name, start, watched, state.unshown or name in _UNSHOWN, inline, loose, article, main, reason, reason != state.reason))
        self.counts[name] = self.counts.get(name, 0) + 1

    def kept(self) -> tuple[list[int], bool]:
        """Places of the lines of the article, or of main, or all that aren't left out, and whether marks decide."""
        by_name, by_any = [], []
        for r in self.reasons:
            by_any.append(r.holds and (r.around < 0 or by_any[r.around]))
            by_name.append(r.holds and not r.by_tag and (r.around < 0 or by_name[r.around]))
        clean = [k for k, x in enumerate(self.lines) if x[1] < 0]
        named = [k for k, x in enumerate(self.lines) if x[1] < 0 or by_name[x[1]]]
        lifted = [k for k, x in enumerate(self.lines) if x[1] < 0 or by_any[x[1]]]
        article, main = 2, 3
        for some, mark in ((clean, article), (named, article), (clean, main), (named, main), (lifted, article), (lifted, main)):
            found = [k for k in some if self.lines[k][mark]]
            if found:
                return found, True
        return clean, False


def _reading(page: str, names: bool) -> _Reader:
    first = _Reader(page, names, frozenset()).read()
    return _Reader(page, names, frozenset(first.missed)).read() if first.missed else first


def cut_page(page: str) -> tuple[list[str], list[int], bool]:
    """All lines of a page that are shown, in page order, and what ``lines_of`` tells of them: the places of those that
    can be content, and whether marks decide."""
    found = _reading(page, True)
    places, sure = found.kept()
    if not places:
        found = _reading(page, False)
        places, sure = found.kept()[0], False
    return [x[0] for x in found.lines], places, sure


def lines_of(page: str) -> tuple[list[str], bool]:
    """The lines that can be content, in page order, and whether the page's own marks decide that they are.

    Elements are left out for their tag (menus, footers, sidebars ...), their name (a class, id or role; any
    element may have one), for being a form, or for not being shown. But what holds the only article is not left
    out: an article outside comes first, then one inside a name, then the main part, then one inside a tag;
    an article in an element named for comments is a reader's. If names and forms leave nothing of a page,
    they count for nothing. An element without an end of its own leaves out what comes before the next
    paragraph, heading or article, or, where it is not one that holds blocks, before the next block.
    """
    lines, places, sure = cut_page(page)
    return [lines[k] for k in places], sure


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence (Hunt and Szymanski: in the order of matches)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


_URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", re.IGNORECASE)


def host_and_path(url: str) -> tuple[str, str]:
    """Host without www. and path without query, fragment, ending and last slash."""
    m = _URL.match(url)
    if not m:
        return "", url
    return re.sub(r"^www\.", "", m[1].lower()), re.sub(r"(?:/index)?(?:\.\w{1,5})?/?$", "", m[2])


_LINES = pa.schema(
    [("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("decided", pa.bool_()), ("host", pa.string()), ("path", pa.string()),
     ("lines", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("marks", pa.list_(pa.int64()))]
)
#: ``lines`` are those that can be content, ``places`` where they stand among all lines, ``marks`` hashes of all lines.
_LINES_DDL = "row long, page_id long, url string, decided boolean, host string, path string, lines array<string>, places array<int>, marks array<long>"
#: Rows of a batch that a task gives.
_ROWS = 128


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, _ROWS)):
        yield _batch(some, schema)


def _mark(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                for row in batch.slice(lo, _ROWS).to_pylist():
                    lines, places, sure = cut_page(row["html"] or "")
                    host, path = host_and_path(row["url"] or "")
                    yield {"row": row["row"], "page_id": row["page_id"], "url": row["url"], "decided": sure, "host": host, "path": path,
                           "lines": [lines[k] for k in places], "places": places, "marks": [_mark(x) for x in lines]}

    return _batches(rows(), _LINES)


_MET = pa.schema(
    [("row", pa.int64()), ("decided", pa.bool_()), ("host", pa.string()), ("places", pa.list_(pa.int32())), ("marks", pa.list_(pa.int64())),
     ("part", pa.int32()), ("edge", pa.int32()), ("asked", pa.list_(pa.int64())), ("gone", pa.list_(pa.int32()))]
)
_MET_DDL = "row long, decided boolean, host string, places array<int>, marks array<long>, part int, edge int, asked array<long>, gone array<int>"
_GONE = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32()))])
#: Which end of its range a page stands at; a page alone in its range is both.
FIRST, LAST = 1, 2


def _asked(row: dict) -> list[int]:
    """The lines of a page that its neighbours are asked for: all but those that marks tell to be its article."""
    if not row["decided"]:
        return row["marks"]
    known = set(row["places"])
    return [m for k, m in enumerate(row["marks"]) if k not in known]


def _checked(row: dict, gone: set[int]) -> list[int]:
    """The places that go of those that can be content: what is shared, but for a marked article."""
    return [] if row["decided"] else [k for k in row["places"] if k in gone]


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pages of one range in order of host and path, which lines go because the pages beside them have
    them; two pages and a batch are held. Pages of which none go have no row. The first and last page of the range tell
    which are shared so far, and their lines."""

    def rows() -> Iterator[dict]:
        held: tuple[dict, list[int], set[int], int] | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                for row in batch.slice(lo, _ROWS).to_pylist():
                    asked, gone = _asked(row), set()
                    if held:
                        before, asked_before, gone_before, edge = held
                        if before["host"] == row["host"] and row["host"]:
                            gone_before |= common_lines(before["marks"], asked)
                            gone |= common_lines(row["marks"], asked_before)
                        if edge:
                            yield {**before, "edge": edge, "asked": asked_before, "gone": sorted(gone_before)}
                        elif found := _checked(before, gone_before):
                            yield {**before, "places": [], "marks": [], "edge": 0, "asked": [], "gone": found}
                    held = row, asked, gone, 0 if held else FIRST
        if held:
            row, asked, gone, edge = held
            yield {**row, "edge": edge | LAST, "asked": asked, "gone": sorted(gone)}

    return _batches(rows(), _MET)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages at the ends of ranges against those across the border."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                gone = set(row["gone"])
                for beside, end in ((row["before"], FIRST), (row["after"], LAST)):
                    if beside and row["edge"] & end and beside["host"] == row["host"] and row["host"]:
                        gone |= common_lines(row["marks"], beside["asked"])
                if found := _checked(row, gone):
                    yield {"row": row["row"], "gone": found}

    return _batches(rows(), _GONE)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``df``.

    A null or empty page has the empty text. White space inside a block becomes one blank, blocks
    are joined by a line feed. Pages without a host are compared with none; rows with one id, and
    pages repeated under one URL, are rows of their own, and lines that such neighbours share go
    only if no mark tells that they are content. Other columns are ignored.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    cut = materialise(pages.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut, _LINES_DDL), "page-lines")
    order = ["host", "path", "page_id"]
    # hashes of lines alone are sorted; the lines stay where they are
    ranges = cut.drop("url", "lines").repartitionByRange(tasks(df.sparkSession), *order).sortWithinPartitions(*order)
    ranges = ranges.select("row", "decided", "host", "places", "marks", F.spark_partition_id().alias("part"))
    met = materialise(ranges.mapInArrow(_difference, _MET_DDL), "page-ranges")
    # two pages of each range at most, whatever the number of pages
    across = Window.orderBy("part", "edge")
    beside = F.struct("host", "asked")
    edges = met.where("edge > 0").withColumn("before", F.lag(beside).over(across)).withColumn("after", F.lead(beside).over(across))
    gone = materialise(met.where("edge = 0").select("row", "gone").unionByName(edges.mapInArrow(_at_edges, "row long, gone array<int>")), "page-gone")
    found = cut.join(if_small(gone), "row", "left")
    own = F.filter("lines", lambda x, k: ~F.array_contains("gone", F.get("places", k)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(own), "\n")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
