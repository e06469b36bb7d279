"""Main text of web pages by nearest-URL page differencing, with roles from the markup.

Pages are paired by URL path within their host: in the order of (host, path, id) a page's partner is the nearest one on
either side that is no copy of it, of the two the one with the longer common path. The partners' text lines (blocks) are
aligned by a longest common subsequence, and lines that both share are deleted as boilerplate.

A page that holds nearly all of another's text (``NEARLY``) is a copy and tells nothing about boilerplate: neighbours that
are copies of each other form a run, and the partners of its pages lie outside it. Where a host has only copies, the text
is kept whole, so that pages whose own text is less than a tenth keep their boilerplate.

Differencing alone gives wrong text where menus, adverts or footers differ from page to page, or where partners carry the
same article; so every page is differenced, and roles from the markup of both pages check the outcome. Blocks in
navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and comments are never text, nor
are those outside of an article that the page marks (``article`` or ``main``). A shared line stays text where the partner
has it in a marked article, too; in a page's own article it only goes where the partner marks an article and has the line
in plain blocks outside.

Pairs are made in a range partition of the sorted pages, not in a task for each host; only line hashes move, and the
blocks of pages that lose lines where these are too many to be broadcast.

Defined cases: null pages and pages without text give an empty string; null URLs are of one host of their own; a page
alone in its host has no partner; repeated rows are pages each; of partners with equally long common paths the one before
is taken. Very long pages are taken alone; a table without rows gives none; other columns are never read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import html as H
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Elements and words in class, id or role that mark what is no main text (fixed values).
SKIPPED = frozenset("nav footer aside form script style noscript template textarea select button iframe svg head dialog object menu".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget cookie cookies consent notice banner alert popup modal overlay newsletter subscribe promo promotion sponsor sponsored ad ads advert adverts advertisement advertising adsense share sharing social related recommended comment comments respond disqus reply replies pagination pager skip".split()
)
ARTICLE, PLAIN, NOISE = 0, 1, 2
#: Share of a page's characters outside the markup's noise that a copy of it holds (fixed value).
NEARLY = 0.9
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<(?:/[^>]*>)?|[^<]+""", re.DOTALL)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _marked(attrs: str) -> bool:
    """Whether attributes tell that an element is no main text."""
    if not attrs.strip():
        return False
    low = attrs.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low):
        return True
    for m in _ATTR.finditer(low):
        value = m[2] or m[3] or m[4] or ""
        if m[1] in ("class", "id", "role", "aria-label") and not WORDS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
        if m[1] == "role" and value in ("complementary", "contentinfo", "search", "dialog") or m[1] == "aria-hidden" and value == "true" or m[1] == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's blocks in page order; text has its references decoded and white space joined."""
    out: list[tuple[int, str]] = []
    part: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the role of what is inside
    places: dict[str, list[int]] = {}  # where elements of a name stand in it
    role, at, html = PLAIN, 0, html or ""

    def flush() -> None:
        if part:
            text = " ".join(H.unescape("".join(part)).split())
            if text:
                out.append((role, text))
            part.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def last(names) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    while m := _TOKEN.match(html, at):
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                part.append(m[0])
            continue
        name = name.lower()
        if name in INLINE and not places.get(name) and (m[1] or not _marked(m[3])):
            continue
        if m[1]:
            if name not in INLINE:
                flush()  # a stray end still ends a block
            found = last((name,))
            if found >= 0:
                flush()
                close(found)
                role = stack[-1][1] if stack else PLAIN
            continue
        flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?|</{re.escape(name)}\Z", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # a new one ends an open one
            same = {"td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd"}.get(name, name).split()
            open_ = last(same)
            if open_ > last(("ul", "ol", "table", "dl", "div", "section", "article", "main", "body")):
                close(open_)
            role = stack[-1][1] if stack else PLAIN
        inner = role
        if role != NOISE:
            if name in SKIPPED or name == "header" and role != ARTICLE or name not in ("html", "body") and _marked(m[3]):
                inner = NOISE
            elif name in MAIN:
                inner = ARTICLE
        if not m[3].rstrip().endswith("/") or name in MAIN or name in SKIPPED:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, inner))
            role = inner
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence with ``b``.

    Equal lines at both ends are taken first. Where few lines match, the runs of matches are extended one by one; where
    many do (repeated lines), the two halves of ``a`` are aligned on their own, divided where rows of lengths, 64 places
    and more a step, tell: memory stays linear."""
    shared = [False] * len(a)
    _align(a, b, 0, len(a), 0, len(b), shared)
    return shared


def _align(a: list[int], b: list[int], i: int, n: int, j: int, m: int, shared: list[bool]) -> None:
    """Mark the lines of a[i:n] in a longest common subsequence with b[j:m]."""
    while i < n and j < m and a[i] == b[j]:
        shared[i] = True
        i, j = i + 1, j + 1
    while i < n and j < m and a[n - 1] == b[m - 1]:
        shared[n - 1] = True
        n, m = n - 1, m - 1
    if i == n or j == m:
        return
    where: dict[int, list[int]] = {}
    for k in range(j, m):
        where.setdefault(b[k], []).append(k)
    if sum(len(where.get(a[k], ())) for k in range(i, n)) <= 64 * (n - i + m - j) or n - i == 1:
        _extend(a, where, i, n, shared)
        return
    mid = (i + n) // 2
    front = _lengths(a[i:mid], b[j:m])
    back = _lengths(a[mid:n][::-1], b[j:m][::-1])[::-1]
    cut = j + int((front + back).argmax())
    _align(a, b, i, mid, j, cut, shared)
    _align(a, b, mid, n, cut, m, shared)


def _extend(a: list[int], where: dict[int, list[int]], i: int, n: int, shared: list[bool]) -> None:
    ends: list[int] = []  # least last place in b of a common run of each length
    nodes: list[tuple[int, int]] = []  # (line of a, node before)
    tails: list[int] = []
    for x in range(i, n):
        for k in reversed(where.get(a[x], ())):
            at = bisect_left(ends, k)
            nodes.append((x, tails[at - 1] if at else -1))
            if at == len(ends):
                ends.append(k)
                tails.append(len(nodes) - 1)
            else:
                ends[at], tails[at] = k, len(nodes) - 1
    at = tails[-1] if tails else -1
    while at >= 0:
        x, at = nodes[at]
        shared[x] = True


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a with b[:k], k = 0 .. len(b): a row of the table as one long number,
    whose bits are places where the length does not grow."""
    m = len(b)
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b):
        places.setdefault(x, []).append(k)
    kept: dict[int, int] = {}
    full = (1 << m) - 1
    row = full
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = kept.get(x)
        if mask is None:
            raw = np.zeros(m + 7 >> 3 << 3, np.uint8)
            raw[at] = 1
            mask = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
            if 64 * len(at) > m:  # at most 64 such lines
                kept[x] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m + 7 >> 3, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _line(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes, characters and roles of all blocks, and the texts of those that the markup allows (else null)."""
    for batch in batches:
        for a, b, _, _ in C.slices(batch.column(1)):
            lines, sizes, roles, texts = [], [], [], []
            for page in batch.column(1).slice(a, b - a).to_pylist():
                got = blocks(page)
                said = ARTICLE if any(r == ARTICLE for r, _ in got) else PLAIN
                lines.append([_line(t) for _, t in got])
                sizes.append([0 if r == NOISE else len(t) for r, t in got])
                roles.append([r for r, _ in got])
                texts.append([t if r == said else None for r, t in got])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(batch.column(k).slice(a, b - a) for k in (2, 3, 4)), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["key", "page_id", "url", "path", "lines", "sizes", "roles", "texts"])


_PARSED = "key long, page_id long, url string, path string, lines array<long>, sizes array<int>, roles array<int>, texts array<string>"


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _held(lines: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> tuple[list[bool], int]:
    """Which lines the other page shares, and their characters."""
    shared = [True] * len(lines) if np.array_equal(lines, other) else common_lines(lines.tolist(), other.tolist())
    return shared, int(sizes[np.array(shared, bool)].sum())


def _copies(a: tuple, b: tuple) -> bool:
    """Whether two pages (host, path, lines, sizes, roles) are nearly the same."""
    if a[0] != b[0]:
        return False
    small, large = sorted((int(a[3].sum()), int(b[3].sum())))
    return small >= NEARLY * large and _held(a[2], a[3], b[2])[1] >= NEARLY * large


def _page(r) -> tuple:
    return r.host, r.path, np.asarray(r.lines, np.int64), np.asarray(r.sizes, np.int64), np.asarray(r.roles, np.int64)


def _gone(row: tuple, other: tuple, shared: list[bool]) -> list[bool]:
    """The shared lines that are boilerplate by the roles that both pages tell."""
    within = np.isin(row[2], other[2][other[4] == ARTICLE])
    outside = np.isin(row[2], other[2][other[4] == PLAIN]) & (other[4] == ARTICLE).any()
    return (np.array(shared, bool) & ~within & ((row[4] != ARTICLE) | outside)).tolist()


def _decide(row: tuple, left: Iterator[tuple], right: Iterator[tuple]) -> list[bool]:
    """The lines that go by the partner; left and right give pages outward from the row's run."""
    sides, nearest = (left, right), [next(left, None), next(right, None)]
    total = int(row[3].sum())
    while True:
        near = [(_prefix(row[1], x[1]), -k) for k, x in enumerate(nearest) if x is not None and x[0] == row[0]]
        if not near:
            return [False] * len(row[2])
        k = -max(near)[1]
        shared, held = _held(row[2], row[3], nearest[k][2])
        if not total or held < NEARLY * total:
            return _gone(row, nearest[k], shared)
        nearest[k] = next(sides[k], None)


def _differences(ordered: DataFrame) -> DataFrame:
    """key, gone (array<boolean> over lines) of each page that loses lines against its partner."""
    spark = ordered.sparkSession

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at, run, before = TaskContext.get().partitionId(), 0, 0, None
        for f in frames:
            runs = []
            for r in f.itertuples(index=False):
                row = _page(r)
                run += before is not None and not _copies(before, row)
                runs.append(run)
                before = row
            yield f.assign(part=np.int32(part), at=np.arange(at, at + len(f)), run=np.array(runs, np.int64))
            at += len(f)

    placed = C.materialize(ordered.mapInPandas(number, "key long, host string, path string, lines array<long>, sizes array<int>, roles array<int>, part int, at long, run long"))
    # First and last pages of the outer two runs on either side of each part's borders: eight at most for each part.
    ends = F.struct("host", "path", "lines", "sizes", "roles")
    last = placed.groupBy("part").agg(F.max("run").alias("most"))
    outer = placed.join(F.broadcast(last), "part").where("run < 2 or run > most - 2")
    edge: dict[int, list[tuple]] = {}
    for x in outer.groupBy("part", "run").agg(F.min_by(ends, "at").alias("first"), F.max_by(ends, "at").alias("final")).orderBy("part", "run").collect():
        edge.setdefault(x.part, []).append((_page(x.first), _page(x.final)))
    parts = spark.sparkContext.broadcast(edge)

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = parts.value
        order = sorted(edge)

        def beyond(part: int, step: int) -> Iterator[tuple]:
            """Pages of the parts before (-1) or after (1) a part, outward."""
            k = order.index(part) + step
            while 0 <= k < len(order):
                runs = edge[order[k]][:2] if step > 0 else edge[order[k]][:-3:-1]
                yield from (first if step > 0 else final for first, final in runs)
                k += step

        def close(rows: list[tuple[int, int, tuple]], part: int) -> Iterator[pd.DataFrame]:
            """The pages of one host in a part, as (key, run, page) in order."""
            firsts = [k for k in range(len(rows)) if not k or rows[k - 1][1] != rows[k][1]]
            out = []
            for j, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(rows)], strict=True)):
                for key, _, page in rows[a:b]:
                    left = chain((rows[k - 1][2] for k in reversed(firsts[1 : j + 1])), beyond(part, -1))
                    right = chain((rows[k][2] for k in firsts[j + 1 :]), beyond(part, 1))
                    gone = _decide(page, left, right)
                    if any(g and role != NOISE for g, role in zip(gone, page[4], strict=True)):
                        out.append((key, gone))
            if out:
                yield pd.DataFrame(out, columns=["key", "gone"])

        rows, at = [], None
        for f in frames:
            for r in f.itertuples(index=False):
                if at != (r.part, r.host):
                    if rows:
                        yield from close(rows, at[0])
                    rows, at = [], (r.part, r.host)
                rows.append((int(r.key), r.run, _page(r)))
        if rows:
            yield from close(rows, at[0])

    return placed.repartition("part").sortWithinPartitions("part", "at").mapInPandas(align, "key long, gone array<boolean>")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    path = F.regexp_replace(bare, r"[?#].*$", "")
    keyed = rows.select(F.xxhash64("page_id", "url", "html").alias("key"), "html", "page_id", "url", path.alias("path"))
    parsed = C.materialize(keyed.mapInArrow(_parse, _PARSED))
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = parsed.select("key", F.lower(F.substring_index("path", "/", 1)).alias("host"), "path", "lines", "sizes", "roles", "page_id")
    ordered = lined.repartitionByRange(spread, "host", "path", "page_id", "key").sortWithinPartitions("host", "path", "page_id", "key").drop("page_id")
    gone = C.materialize(_differences(ordered).groupBy("key").agg(F.min("gone").alias("gone")))  # of known size: few rows are broadcast
    told = parsed.select("key", "page_id", "url", "texts").join(gone, "key", "left")
    said = F.filter("texts", lambda x, i: x.isNotNull() & ~F.coalesce(F.get("gone", i), F.lit(False)))
    return told.select("page_id", "url", F.array_join(said, " ").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
