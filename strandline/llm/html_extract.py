"""Main text of pages by nearest-URL page differencing.

A page becomes text lines, one for each block. Pages stand in the order of host, url path and page_id; each is compared with the NEAR pages before and
after it on its host. Their lines are aligned by a longest common subsequence. A neighbour votes for the lines that it shares; one
that shares all text of either page is a copy, so it says nothing about the site and has no vote. Shared lines are the site's and
go: where no article or main element tells the page's own text, those with half of the votes; inside such an element, where
neighbours also quote passages or carry the same licence line, only those with all 2 * NEAR votes.
Besides, lines go that markup puts outside the main text, shared or not (menus, headers, footers, sidebars, notices, adverts, forms,
comments), and on pages with an article or main element the lines outside it.

Runs of RANGE pages in that order are worked on together, with NEAR pages more at either end, so a host with a third of all pages
is spread over many tasks and no result depends on where runs end. The keys are sorted first, without the html; the ends of runs
are all that the driver sees, as with a range partitioning. Html is shuffled and parsed once (NEAR pages at ends twice).

Character references are decoded, white space inside a block is one space, blocks are joined by a line feed. Null html is empty;
null urls are one host without path; a null page_id sorts first. Repeated rows are copies of each other. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of, path_of

#: Fixed values of HTML: elements that begin and end a block, that hold no text of the page, and that have no end tag.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = set("head script style noscript template iframe object svg math canvas audio video select datalist textarea button title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text, and words in class, id or role that say the same.
OUTSIDE = set("nav footer aside form menu dialog header".split())
OUTSIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adverts?|banner|promo\w*|sponsor\w*|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|aside|footer|foot|header|masthead|topbar|comments?|commentlist|replies|reply|respond|discussion|disqus|share|social|related|recommended|login|signup|search|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-])", re.I)
INSIDE = set("article main".split())
#: Elements whose end an opening tag implies.
CLOSES = {"p": BLOCKS - set("html body".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class _Lines(HTMLParser):
    """Blocks of a page as (text, outside, inside): in an element that is never main text, in an article or main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, silent, outside, inside: each with what stands around it
        self.text: list[str] = []

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            _, _, outside, inside = self.open[-1] if self.open else ("", False, False, False)
            self.lines.append((text, outside, inside))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._break()
        for name in (t for t, starts in CLOSES.items() if tag in starts):
            if self.open and name in (scope := [x[0] for x in self.open[-3:]]) and not any(x in ("ul", "ol", "table", "dl") for x in scope[scope.index(name) + 1 :]):
                self._close(name)
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        _, silent, outside, inside = self.open[-1] if self.open else ("", False, False, False)
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        away = tag in OUTSIDE or hidden or tag not in ("html", "body", "article", "main") and bool(named) and OUTSIDE_WORDS.search(named) is not None
        if inside and tag == "header" and not OUTSIDE_WORDS.search(named):
            away = False  # the heading of the article itself
        self.open.append((tag, silent or tag in SILENT, outside or away, inside or tag in INSIDE and not outside))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "use"):
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        at = max((i for i, x in enumerate(self.open) if x[0] == tag), default=-1)
        if at >= 0:
            self._break()
            del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
            self._close(tag)
        elif any(x[0] == tag for x in self.open):
            at = max(i for i, x in enumerate(self.open) if x[0] == tag)
            if not any(x[0] in BLOCKS for x in self.open[at + 1 :]):
                del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._break()


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """Text lines of a page, each with whether markup puts it outside, and inside, the main text."""
    p = _Lines()
    p.feed(html)
    p.close()
    return p.lines


def common(a: list, b: list) -> tuple[set[int], set[int]]:
    """Places in a and in b of a longest common subsequence: equal ends first, then increasing chains of equal places."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    where: dict = {}
    for j in range(m - high - 1, low - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends, last = [], []  # least end of a chain of each length, and that chain's link
    for i in range(low, n - high):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    x, y = {*range(low), *range(n - high, n)}, {*range(low), *range(m - high, m)}
    link = last[-1] if last else None
    while link:
        x.add(link[0])
        y.add(link[1])
        link = link[2]
    return x, y


#: Neighbours on either side, and pages in a run.
NEAR, RANGE = 2, 4000


def main_text(lines: list[tuple[str, bool, bool]], votes: list[int], voters: int) -> str:
    """Lines that neither markup nor the votes of neighbours take for the site's."""
    marked = any(inside and not outside for _, outside, inside in lines)
    out = []
    for (text, outside, inside), n in zip(lines, votes, strict=True):
        shared = n == 2 * NEAR if marked else n > 0 and 2 * n >= voters
        if not outside and not shared and (inside or not marked):
            out.append(text)
    return "\n".join(out)


class _Page:
    def __init__(self, row: tuple):
        _, self.own, self.host, _, self.id, self.url, html = row
        self.lines = lines_of(html) if html else []
        self.texts = [t for t, _, _ in self.lines]
        self.body = {i for i, (_, outside, _) in enumerate(self.lines) if not outside}
        self.votes, self.voters = [0] * len(self.lines), 0

    def vote(self, shared: set[int]) -> None:
        self.voters += 1
        for i in shared:
            self.votes[i] += 1

    def row(self) -> tuple:
        text = main_text(self.lines, self.votes, self.voters)
        return self.id, self.url, text, len(text)


def meet(a: _Page, b: _Page) -> None:
    """Two neighbours vote for each other's shared lines, unless one has no text of its own beside the other."""
    x, y = common(a.texts, b.texts)
    if a.body - x and b.body - y:
        a.vote(x)
        b.vote(y)


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by run and key to the main text of the run's own."""

    def flush(out: list) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    out: list[tuple] = []
    last: deque[_Page] = deque()
    run = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if row[0] != run:
                out += [p.row() for p in last if p.own]
                last.clear()
                run = row[0]
            page = _Page(row)
            for p in last:
                if p.host == page.host:
                    meet(p, page)
            last.append(page)
            if len(last) > NEAR and (p := last.popleft()).own:
                out.append(p.row())
        yield flush(out)
        out = []
    yield flush([p.row() for p in last if p.own])


ENDS = "part int, place bigint, host string, path string, page_id bigint"


def _ends(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted keys, the first and last NEAR of every run of size."""
        part, place, held = TaskContext.get().partitionId(), 0, []

        def rows(of: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(ENDS_NAMES, (part, *x), strict=True)) for x in of], schema=pa.schema([("part", pa.int32()), ("place", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64())]))

        for batch in batches:
            out = []
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place % size == 0:
                    out += held[-NEAR:]
                    held = []
                (out if place % size < NEAR else held).append((place, *key))
                held = held[-NEAR:]
                place += 1
            yield rows(out)
        yield rows(held)

    return work


ENDS_NAMES = [c.split()[0] for c in ENDS.split(", ")]


def _order(key: tuple) -> tuple:
    host, path, page = key
    return host, path, page is not None, page or 0


def runs_of(ends: list[tuple], size: int) -> tuple[list[tuple], dict]:
    """(part, place, host, path, page_id) of ends to the first key of each run, and for the keys near an end the run beyond it.

    Runs of fewer than NEAR keys join the one before."""
    runs: list[list[tuple]] = []
    number = None
    for part, place, *key in sorted(ends, key=lambda r: (_order(r[2:]), r[0], r[1])):
        if (part, place // size) != number and (not runs or len(runs[-1]) >= NEAR):
            runs.append([])
        number = part, place // size
        runs[-1].append(_order(tuple(key)))
    if len(runs) > 1 and len(runs[-1]) < NEAR:
        runs[-2:] = [runs[-2] + runs[-1]]
    beyond: dict = {}
    for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False)):
        for k in a[-NEAR:]:
            beyond.setdefault(k, set()).add(i + 1)
        for k in b[:NEAR]:
            beyond.setdefault(k, set()).add(i)
    return [r[0] for r in runs], beyond


def _dealt(firsts: list[tuple], beyond: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the run that they belong to, and again for a run that has them as neighbours."""
        for batch in batches:
            at, run, own = [], [], []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                key = _order(key)
                mine = max(0, bisect_right(firsts, key) - 1)
                for r in {mine, *beyond.get(key, ())}:
                    at.append(i)
                    run.append(r)
                    own.append(r == mine)
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(own, pa.bool_()), *(c.take(pa.array(at, pa.int64())) for c in batch.columns)], names=["run", "own", *batch.schema.names])

    return work


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    key = [F.col(c) for c in ("host", "path", "page_id")]
    read = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("page_id").cast("bigint"), "url", "html")
    parts = max(1, -(-pages.count() // (16 * RANGE)))
    ends = read.select(*key).repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(_ends(RANGE), ENDS)
    firsts, beyond = runs_of([tuple(r) for r in ends.collect()], RANGE)
    dealt = read.mapInArrow(_dealt(firsts, beyond), "run int, own boolean, host string, path string, page_id bigint, url string, html string")
    return dealt.repartition(max(1, len(firsts)), "run").sortWithinPartitions("run", *key).select("run", "own", "host", "path", "page_id", "url", "html").mapInArrow(_difference, RESULT)
