"""Main text of web pages by differencing with the page of the nearest URL.

1.  Each page becomes lines, one for each block, marked as inside an article or not.  Scripts, styles, forms
    and what tags or class names call menu, header, footer, sidebar, notice, advert or comment go here.
2.  All pages are ordered by host and path and cut into parts at sampled places, so a host with a third of all
    pages, or one path with many, is many tasks' work.  A page is compared with the nearest page before it of
    its host whose path differs, or without one with the first page after; what the first and last host of a
    part hand to other parts is found by a first pass that moves only hashes of lines.  It is joined in order of
    the parts, first inside blocks of about as many parts as there are blocks, then across a host's blocks, so
    that no task takes more than that many parts of one host, and dealt to the parts beside their pages.
3.  Lines are aligned by longest common subsequence of their hashes, and shared lines are deleted: outside an
    article all of them, inside one only short ones in no heading, paragraph, list or table, because articles
    may quote each other.  What the EVERY nearest pages, none a copy of another, all share with the page is no
    quotation, and goes wherever it stands.  A page that shares most of the text is a copy and is passed over
    for the next that is none; of pages that are copies of each other the nearest is kept, so groups of any
    size are passed over.
    Where the host has none, most pages being its menus or all copies, the lines go that AGREE different
    neighbours all have, if the page has others.
4.  Where a page has articles, its text is theirs; otherwise it is all that is left but lines of links.

Defined cases: null html counts as empty and gives the empty text; a null URL has an empty host and path;
unclosed elements end with the page, an unfinished tag at the end is dropped; rows repeated or with null ids
are pages like any other (a copy has the same path, so it is never compared with itself); an element goes, with all
in it, where an attribute of its own hides it (hidden, aria-hidden, display:none); formulas stay; an empty table
gives an empty result; no column but page_id, url and html is read.
"""

from __future__ import annotations

import html
import copy
import json
import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .url_filter import split_url
from .workspace import Workspace, partitions

#: Characters up to which a shared line inside an article goes.
SHORT = 60
#: Pages of a part, at least; parts of a task, at most; places sampled for each bound between parts.
GROUP_ROWS, PARTS, SAMPLE = 256, 8, 20
#: Neighbours of a page that are kept, none a copy of another.
NEAR = 10
#: Different pages that must have a line where no page of the host is anything but a copy, and for any line of an article.
AGREE, EVERY = 3, 8
#: Bits of the table of a longest common subsequence that are kept.
BITS = 1 << 27
#: Bytes of waiting pages held in memory; more of them wait in a file of the task.
WAITING = 1 << 23

#: Text, inside an article, mostly links, prose.
Line = tuple[str, bool, bool, bool]

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without any text of the page, contents included.
RAW = frozenset("script style noscript template textarea iframe svg select object title head canvas audio video".split())
#: Elements that are not main text.
ASIDE = frozenset("nav header footer aside form menu dialog button".split())
#: Words in class, id or role that say so too; those of the second set hold outside articles only.
ROLES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe share social "
    "comment comments respond reply replies disqus sidebar related recommended breadcrumb breadcrumbs menu nav navbar navigation footer pagination pager widget login signup search complementary contentinfo".split()
)
OUTER_ROLES = frozenset("header masthead topbar toolbar branding".split())
MAIN = frozenset(("article", "main"))
#: Elements whose lines inside an article are its text, shared or not.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption summary".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words that say what an element is at the end of a name too (site-footer), where others say it at the beginning only.
PLACES = frozenset("ad ads banner footer nav navbar navigation menu sidebar comments breadcrumb breadcrumbs pagination pager header masthead topbar toolbar".split())
#: Beginnings of names that speak of a page's other parts.
SPEAKS_OF = frozenset("has no with without is show hide page layout".split())


#: Words that a name may have beside a role and still be no more than that role's place in an article.
FORMS = frozenset(
    "area bar block body bottom box button buttons card column container content count cta embed feed field group heading holder icon icons inline inner input item items left line link links list "
    "main message outer panel post posts right row section sign slot stories tag tags text thread title tool tools top unit up wrap wrapper".split()
)


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), "".join(value))
    return out


def unseen(attributes: dict[str, str]) -> bool:
    """Whether attributes of their own, not words in others, say that an element is not shown."""
    return attributes.get("hidden", "false").lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def roles_of(attributes: dict[str, str], in_article: bool = False) -> set[str]:
    """What class, id and role call an element: each name's first word, and its last if that is a place on the page.

    Inside an article a name must say nothing else: "newsletter-box" does, "share-prices" and "ad-hoc" do not.
    """
    out: set[str] = set()
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            parts = _WORD.findall(name)
            if in_article and not all(p in ROLES or p in PLACES or p in FORMS for p in parts):
                continue
            if parts and parts[0] not in SPEAKS_OF:
                out.add(parts[0])
                if parts[-1] in PLACES:
                    out.add(parts[-1])
    return out


def page_lines(source: str | None) -> list[Line]:
    """(text, inside an article, mostly links, prose) of each block of the page, in order.

    Names are no more than hints: where following them leaves no text at all, they are passed over.
    """
    lines = _read_lines(source, True)
    return lines if body_lines(lines) else _read_lines(source, False) or lines


def _read_lines(source: str | None, named: bool) -> list[Line]:
    out: list[tuple[str, bool, bool, bool]] = []
    parts: list[str] = []
    linked, in_link, main, block = 0, 0, 0, ""
    skip, depth = "", 0  # the element left out just now, and how often it is open
    source = source or ""
    at, end = 0, len(source)

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, main > 0, linked * 5 > len(text) * 4, block in PROSE))
        parts.clear()
        linked = 0

    while at < end:
        token = _TOKEN.match(source, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if not skip and (text == "<" or text[0] != "<"):
                parts.append(text)
                linked += len(text) if in_link else 0
            continue
        name, closing, attributes = name.lower(), token[1] == "/", token[3]
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(name)}\b[^>]*>" + (r"|<body\b" if name == "head" else ""), re.I).search(source, at)
                at = (found.start() if found[0][:5].lower() == "<body" else found.end()) if found else end
            if name in BLOCKS and not skip:
                close()
            continue
        if skip == "p" and not closing and name in BLOCKS:
            skip, depth = "", 0  # a paragraph ends where the next block begins
        if skip:
            if name in MAIN and not closing and skip in ASIDE | {"div", "section", "ul"} and skip not in ("aside", "form"):
                skip, depth = "", 0
            else:
                if name == skip:
                    depth += -1 if closing else 1
                    if depth == 0:
                        skip = ""
                continue
        if name in BLOCKS:
            close()
            if name not in ("br", "hr"):
                block = "" if closing else name
        if name == "a":
            in_link = 0 if closing else 1
        if name in MAIN:
            main = max(0, main + (-1 if closing else 1))
        elif not closing and name not in ("html", "body", "br", "hr", "img", "input", "link", "meta") and not attributes.endswith("/"):
            own = attributes_of(attributes) if attributes.strip() else {}
            roles = roles_of(own, main > 0) if own and named else set()
            if (name in ASIDE and not (name == "header" and main)) or roles & ROLES or (roles & OUTER_ROLES and not main) or unseen(own):
                close()
                skip, depth = name, 1
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes into a of a longest common subsequence."""
    places: dict[int, int] = {}
    twice = False
    for j, x in enumerate(b):
        twice = twice or x in places
        places[x] = j
    found = [i for i, x in enumerate(a) if x in places]
    if twice or len({a[i] for i in found}) < len(found):
        mine = {a[i] for i in found}
        return [found[i] for i in _longest([a[i] for i in found], [x for x in b if x in mine])]
    # Every line once: the longest run of rising places.
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, i in enumerate(found):
        j = places[a[i]]
        k = bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(found[at])
        at = before[at]
    return out[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a the bits of b at which its longest common subsequence with b's prefixes does not grow."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & every
        yield row


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """The lengths of the longest common subsequences of a with every prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _longest(a: list[int], b: list[int]) -> list[int]:
    """Indexes into a of a longest common subsequence, whatever repeats: bits of a row at once, rows kept up to BITS."""
    start, n, m = 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head, tail = list(range(start)), list(range(n, len(a)))
    a, b = a[start:n], b[start:m]
    if not a or not b:
        return head + tail
    if len(a) > 1 and len(a) * len(b) > BITS:  # halves of a meet a cut of b at which both are longest
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        middle = _longest(a[:half], b[:cut]) + [half + i for i in _longest(a[half:], b[cut:])]
        return head + [start + i for i in middle] + tail
    rows = list(_rows(a, b))
    out: list[int] = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(start + i)
            j -= 1
    return head + out[::-1] + tail


class Page(NamedTuple):
    """What others are compared with: the hashes of the page's lines, and the characters of those of its body."""

    path: str
    hashes: list[int]
    sizes: list[int]
    at: int  # in the order of the scan


def body_lines(lines: list[Line]) -> list[int]:
    has_main = any(m for _, m, *_ in lines)
    return [i for i, (_, m, links, _) in enumerate(lines) if (m if has_main else not links)]


def page_of(lines: list[Line], path: str, at: int = 0) -> Page:
    sizes = [0] * len(lines)
    for i in body_lines(lines):
        sizes[i] = len(lines[i][0])
    return Page(path, [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t, *_ in lines], sizes, at)


def copy_of(page: Page, other: Page) -> bool:
    """Whether most of the page's text is in the other."""
    return page.hashes == other.hashes or 2 * sum(page.sizes[i] for i in common_lines(page.hashes, other.hashes)) > sum(page.sizes)


def equal(page: Page, other: Page) -> bool:
    return page.hashes == other.hashes


class Kept:
    """Pages of a host met in order of their paths, of those that are the same only the nearest."""

    def __init__(self, same: Callable[[Page, Page], bool]) -> None:
        self.same = same
        self.here: list[Page] = []  # of this path, nearest first
        self.back: list[Page] = []  # of the paths before
        self.own: list[Page] = []  # the first of the host's first path
        self.opening: list[Page] = []  # the first of the other paths

    def turn(self) -> None:
        self.back = [*self.here, *(b for b in self.back if not any(self.same(h, b) for h in self.here))][:NEAR]
        self.here = []

    def meet(self, page: Page, first: bool) -> None:
        self.here = [page, *(h for h in self.here if not self.same(page, h))][:NEAR]
        start = self.own if first else self.opening
        if len(start) < NEAR and not any(self.same(page, o) for o in start):
            start.append(page)


class Neighbours:
    """Of a host whose pages are met in order of their paths: those a page can be compared with.

    ``near`` are no copies of each other, so that a group of copies takes one place however many they are;
    ``alike`` may be, but are not equal.
    """

    def __init__(self, host: str | None) -> None:
        self.host = host
        self.first: str | None = None
        self.path: str | None = None
        self.near, self.alike = Kept(copy_of), Kept(equal)

    def turn(self, path: str) -> None:
        """The next page has this path."""
        if self.path is None:
            self.first = path
        elif path != self.path:
            self.near.turn()
            self.alike.turn()
        self.path = path

    def meet(self, page: Page) -> None:
        if page.hashes:
            self.near.meet(page, page.path == self.first)
            self.alike.meet(page, page.path == self.first)

    def kept(self) -> list[Page]:
        """Pages that, met in this order, give the same neighbours."""
        return sorted({p.at: p for k in (self.near, self.alike) for p in (*k.own, *k.opening, *k.here, *k.back)}.values(), key=lambda p: p.at)

    def _without(self, *names: str) -> Neighbours:
        out = copy.copy(self)
        out.near, out.alike = copy.copy(self.near), copy.copy(self.alike)
        for k in (out.near, out.alike):
            for name in names:
                setattr(k, name, [])
        return out

    def so_far(self) -> Neighbours:
        """The same, but for what the host's pages open with."""
        return self._without("own", "opening")

    def opening(self) -> Neighbours:
        """What the host's pages open with alone."""
        return self._without("own", "here", "back")


class Shared(NamedTuple):
    nearest: set[int] | None  # lines shared with the nearest page that is no copy
    everywhere: set[int]  # with each of EVERY such pages, none a copy of another
    settled: bool  # no further page would change it


def shared_lines(page: Page, near: Iterable[Page]) -> Shared:
    """The page's lines in the nearest pages that have another path and are no copies of it."""
    others: list[Page] = []
    nearest: set[int] | None = None
    everywhere: set[int] = set()
    for other in near:
        if other.path == page.path or copy_of(page, other) or any(copy_of(other, x) for x in others):
            continue
        shared = set(common_lines(page.hashes, other.hashes))
        everywhere = shared if nearest is None else everywhere & shared
        nearest = shared if nearest is None else nearest
        others.append(other)
        if not everywhere or len(others) == EVERY:
            return Shared(nearest, everywhere, True)
    return Shared(nearest, set(), False)


def lines_of_all(page: Page, alike: Iterable[Page]) -> set[int]:
    """Where every neighbour has most of the page: the lines that AGREE different ones all have, if others remain."""
    others: list[Page] = []
    for other in alike:
        if other.path != page.path and not any(equal(other, x) for x in (page, *others)):
            others.append(other)
    if len(others) < AGREE:
        return set()
    shared = set.intersection(*(set(common_lines(page.hashes, other.hashes)) for other in others[:AGREE]))
    return shared if sum(page.sizes[i] for i in shared) < sum(page.sizes) else set()


def remaining(lines: list[Line], nearest: set[int], everywhere: set[int]) -> str:
    """The page's text without the lines it shares."""
    return "\n".join(lines[i][0] for i in body_lines(lines) if i not in everywhere and not (i in nearest and (not lines[i][1] or (len(lines[i][0]) <= SHORT and not lines[i][3]))))


def main_text(lines: list[Line], hashes: list[int], other: list[int] | None) -> str:
    """The page's text, other being the line hashes of the page it is compared with."""
    page = page_of(lines, "")._replace(hashes=hashes)
    shared = shared_lines(page, [Page("other", other, [], 0)] if other else [])
    return remaining(lines, shared.nearest or set(), shared.everywhere)


class Waiting:
    """Pages that wait for one to be compared with, as many as there are."""

    def __init__(self) -> None:
        self.file, self.n = tempfile.SpooledTemporaryFile(WAITING), 0

    def add(self, row: tuple) -> None:
        pickle.dump(row, self.file, pickle.HIGHEST_PROTOCOL)
        self.n += 1

    def take(self) -> Iterator[tuple]:
        self.file.seek(0)
        for _ in range(self.n):
            yield pickle.load(self.file)
        self.file.close()
        self.__init__()


KEYS = "part int, host string, path string, spread long, digest long"
LINES = f"{KEYS}, kind int, page_id long, url string, lines binary"
LIGHT = f"{KEYS}, hashes array<long>, sizes array<int>"
EDGES = "part int, host string, seq long, path string, hashes array<long>, sizes array<int>"
STATES = "part int, host string, kind int, state binary"
TEXTS = "page_id long, url string, text string, n_chars long"
_KEYS = [("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("spread", pa.int64()), ("digest", pa.int64())]
_LINES = pa.schema([*_KEYS, ("kind", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.binary())])
_LIGHT = pa.schema([*_KEYS, ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
_EDGES = pa.schema([_KEYS[0], _KEYS[1], ("seq", pa.int64()), _KEYS[2], ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
_STATES = pa.schema([_KEYS[0], _KEYS[1], ("kind", pa.int32()), ("state", pa.binary())])
#: Kinds of rows of a part: what was met of its first host in earlier parts, what hosts at its edges open with, pages.
BEFORE, OPENING, PAGE = range(3)
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _place(url: str | None, page: int | None) -> tuple[str, str, int]:
    """Where the page stands: host, path, and a hash that orders the pages of one path."""
    host, path = split_url(url)
    return host, path.rstrip("/"), xxhash.xxh64_intdigest(f"{url}\n{page}") >> 1


def _sample_places(of: int):
    """About one in ``of`` places, chosen by a hash."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p for p in map(_place, b.column("url").to_pylist(), b.column("page_id").to_pylist()) if xxhash.xxh64_intdigest(str(p[2]), 1) % of == 0]
            if found:
                yield _batch(found, pa.schema(_KEYS[1:4]))

    return sample


def _read_pages(bounds: Broadcast, light: bool):
    """light: the hashes and sizes of the lines only, not their text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for page, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                lines = page_lines(source)
                place = _place(url, page)
                keys = (bisect_right(bounds.value, place), *place, xxhash.xxh64_intdigest((source or "").encode("utf-8", "surrogatepass")) >> 1)
                if light:
                    rows.append((*keys, *page_of(lines, "")[1:3]))
                else:
                    rows.append((*keys, PAGE, page, url, pack.compress(json.dumps(lines, ensure_ascii=False).encode("utf-8", "surrogatepass"))))
            if rows:
                yield _batch(rows, _LIGHT if light else _LINES)

    return read


def _find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts in order in; what the first and last host of each part keep out."""
    part: int | None = None
    first = now = Neighbours(None)

    def close() -> Iterator[pa.RecordBatch]:
        rows = [(part, n.host, p.at, p.path, p.hashes, p.sizes) for n in ((first,) if now is first else (first, now)) for p in n.kept()]
        if rows:
            yield _batch(rows, _EDGES)

    n = 0
    for batch in batches:
        for k, host, path, hashes, sizes in zip(*(batch.column(c).to_pylist() for c in ("part", "host", "path", "hashes", "sizes")), strict=True):
            if k != part:
                yield from close()
                part, first = k, Neighbours(host)
                now = first
            elif host != now.host:
                now = Neighbours(host)
            now.turn(path)
            now.meet(Page(path, hashes, sizes, n))
            n += 1
    yield from close()


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a host's block of parts in order in; out what the block as a whole keeps, named by the block."""
    now, block = Neighbours(None), None

    def close() -> Iterator[pa.RecordBatch]:
        rows = [(block, now.host, p.at, p.path, p.hashes, p.sizes) for p in now.kept()]
        if rows:
            yield _batch(rows, _EDGES)

    n = 0
    for batch in batches:
        for k, host, path, hashes, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "host", "path", "hashes", "sizes")), strict=True):
            if (host, k) != (now.host, block):
                yield from close()
                now, block = Neighbours(host), k
            now.turn(path)
            now.meet(Page(path, hashes, sizes, n))
            n += 1
    yield from close()


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a host's block in order of parts in, what is known of the block's host first; out for each part of a
    host that spans several what was met before, and what the host opens with."""
    pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    now, block = Neighbours(None), None
    known: Neighbours | None = None  # the host's opening, where it spans several blocks
    later = False  # whether the host has parts before this block
    parts: list[int] = []

    def state(part: int, kind: int, of: Neighbours) -> pa.RecordBatch:
        return _batch([(part, of.host, kind, pack.compress(pickle.dumps(of, pickle.HIGHEST_PROTOCOL)))], _STATES)

    def close() -> Iterator[pa.RecordBatch]:
        if known or len(parts) > 1:
            opening = known or now.opening()
            for part in parts:
                yield state(part, OPENING, opening)

    n = 0
    for batch in batches:
        for k, host, kind, part, path, hashes, sizes, met in zip(*(batch.column(c).to_pylist() for c in ("block", "host", "kind", "part", "path", "hashes", "sizes", "state")), strict=True):
            if (host, k) != (now.host, block):
                yield from close()
                now, block, known, later, parts = Neighbours(host), k, None, False, []
            if kind == BEFORE:
                now, later = pickle.loads(unpack.decompress(met)), True
            elif kind == OPENING:
                known = pickle.loads(unpack.decompress(met))
            else:
                if not parts or part != parts[-1]:
                    if parts or later:
                        yield state(part, BEFORE, now.so_far())
                    parts.append(part)
                now.turn(path)
                now.meet(Page(path, hashes, sizes, n))
                n += 1
    yield from close()


def _states(ws: Workspace, found: DataFrame, parts: int) -> DataFrame:
    """What parts have to know of others, by the edges found in each."""
    tasks, none = partitions(ws.spark), "cast(null as binary) state"
    found = ws.result(found.withColumn("block", F.expr(f"part div {max(1, isqrt(parts))}")))
    blocks = found.repartition(tasks, "host", "block").sortWithinPartitions("host", "block", "part", "seq").mapInArrow(_fold_blocks, EDGES)
    blocks = blocks.selectExpr("0 block", "host", f"{PAGE} kind", "part", "seq", "path", "hashes", "sizes", none)
    known = blocks.repartition(tasks, "host").sortWithinPartitions("host", "part", "seq").mapInArrow(_join_edges, STATES)
    known = known.selectExpr("part block", "host", "kind", "0 part", "0L seq", "'' path", "array(0L) hashes", "array(0) sizes", "state")
    edges = found.selectExpr("cast(block as int) block", "host", f"{PAGE} kind", "part", "seq", "path", "hashes", "sizes", none).union(known)
    return ws.result(edges.repartition(tasks, "host", "block").sortWithinPartitions("host", "block", "kind", "part", "seq").mapInArrow(_join_edges, STATES))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts in order in, of each part its states first; texts out."""
    before = Neighbours(None)
    hosts: dict[str, Neighbours] = {}
    unpack = zstandard.ZstdDecompressor()
    out: list[tuple] = []
    part: int | None = None
    now = Neighbours(None)
    waiting = Waiting()

    def read_lines(packed: bytes) -> list[Line]:
        return [tuple(x) for x in json.loads(unpack.decompress(packed).decode("utf-8", "surrogatepass"))]

    def give(page: int | None, url: str | None, lines: list[Line], nearest: set[int], everywhere: set[int]) -> Iterator[pa.RecordBatch]:
        text = remaining(lines, nearest, everywhere)
        out.append((page, url, text, len(text)))
        yield from full()

    def full(least: int = 256) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield _batch(out, _TEXTS)
            out.clear()

    def release() -> Iterator[pa.RecordBatch]:
        host = hosts.get(now.host, now)
        for page, url, packed, path, near, alike in waiting.take():
            lines = read_lines(packed)
            this = page_of(lines, path)
            shared = shared_lines(this, [*near, *host.near.opening])
            yield from give(page, url, lines, lines_of_all(this, [*alike, *host.alike.opening]) if shared.nearest is None else shared.nearest, shared.everywhere)

    n = 0
    for batch in batches:
        for k, host, path, kind, page, url, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "host", "path", "kind", "page_id", "url", "lines")), strict=True):
            if k != part:
                yield from release()
                part, before, hosts, now = k, Neighbours(None), {}, Neighbours(None)
            if kind != PAGE:
                met = pickle.loads(unpack.decompress(packed))
                if kind == BEFORE:
                    before = met
                else:
                    hosts[host] = met
                continue
            if host != now.host:
                yield from release()
                now = before if before.host == host else Neighbours(host)
            now.turn(path)
            lines = read_lines(packed)
            this = page_of(lines, path, n)
            shared = shared_lines(this, now.near.back)
            if not shared.settled:
                waiting.add((page, url, packed, path, now.near.back, now.alike.back))
            else:
                yield from give(page, url, lines, shared.nearest, shared.everywhere)
            now.meet(this)
            n += 1
    yield from release()
    yield from full(1)


def extract_text(pages: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """page_id, url, text (the main text, blocks joined by a line break), n_chars for each row of pages."""
    spark = pages.sparkSession
    sc = spark.sparkContext
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    n = rows.count()
    parts = max(1, min(-(-n // group_rows), PARTS * partitions(spark)))
    places = sorted(map(tuple, rows.select("url", "page_id").mapInArrow(_sample_places(max(1, n // (parts * SAMPLE))), "host string, path string, spread long").collect()))  # SAMPLE for each part
    bounds = sc.broadcast([places[len(places) * i // parts] for i in range(1, parts)] if places else [])
    order = ["part", "host", "path", "spread", "digest"]
    ws = Workspace(spark, "html")
    found = rows.mapInArrow(_read_pages(bounds, True), LIGHT).repartition(partitions(spark), "part").sortWithinPartitions(*order).mapInArrow(_find_edges, EDGES)
    states = _states(ws, found, parts).selectExpr("part", "host", "'' path", "0L spread", "0L digest", "kind", "cast(null as long) page_id", "cast(null as string) url", "state lines")
    dealt = rows.mapInArrow(_read_pages(bounds, False), LINES).union(states).repartition(partitions(spark), "part")
    return dealt.sortWithinPartitions("part", "kind", *order[1:], "page_id").mapInArrow(_difference, TEXTS)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
