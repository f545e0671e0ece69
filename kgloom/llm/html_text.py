"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines (its blocks of text, with where they stand); pages of a host are paired with the page of nearest
URL path; the two pages' lines are aligned by longest common subsequence, and lines that both share are deleted as the
site's frame. Lines that stand in an explicit article are the page's own even if a copy of the article has another
URL, so differencing spares them; lines in elements that never hold main text (menus, forms, scripts ...) go in any case,
which also covers pages without a partner and adverts that differ from page to page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, parts

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIP = frozenset("head nav footer aside form button select menu dialog svg math object canvas audio video figure-controls label fieldset".split()) | RAW
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html head option optgroup caption td th tr tbody thead tfoot".split())
#: Words in class, id or role that mark what isn't main text.
FRAME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside footer masthead cookie cookies consent gdpr notice notices alert notification popup modal overlay toolbar pagination pager share sharing social related recommended recommendations newsletter subscribe subscription signup login comment comments disqus replies widget widgets complementary contentinfo dialog search skip hidden".split())
#: A quote that is never closed ends with the page; attributes are read once, without going back.
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD_CUT = re.compile(r"[^a-z0-9]+")
#: Where a line stands.
OWN, OPEN, FRAME = 2, 1, 0


def _marked(attrs: str) -> bool:
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role") and m[2]:
            camel = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", html.unescape(m[2].strip("\"'")))
            if not FRAME_WORDS.isdisjoint(WORD_CUT.split(camel.lower())):
                return True
        elif name == "hidden" or (name == "aria-hidden" and (m[2] or "").strip("\"'").lower() == "true"):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of each block of text in page order; place: FRAME, OPEN or OWN (inside an article or main)."""
    page, out, words, stack = page or "", [], [], []  # stack: (name, frame from here, own from here)
    frame = own = 0

    def flush() -> None:
        nonlocal words
        text = " ".join("".join(words).split())
        words = []
        if text:
            out.append((text, FRAME if frame else OWN if own else OPEN))

    def pop(to: int) -> None:
        nonlocal frame, own
        for _, f, o in stack[to:]:
            frame -= f
            own -= o
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            words.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            words.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK or name in RAW or name in SKIP:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "td", "th", "div", "nav", "footer", "aside", "section") and name not in BLOCK and name not in SKIP:
                    break
            continue
        attrs = m[3] or ""
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        if attrs.rstrip().endswith("/") and name in ("svg", "math"):
            continue
        f = int(name in SKIP or (name == "header" and not own) or (name not in ("html", "body", "article", "main") and _marked(attrs)))
        o = int(name in ("article", "main") or "role=\"main\"" in attrs)
        if name == "article" and stack and frame == 0 and _marked(attrs):
            f = 1
        stack.append((name, f, o))
        frame += f
        own += o
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each line of a whether it lies on a longest common subsequence with b: pairs of equal lines and their longest
    increasing run where such pairs are few, else the bit-parallel table, a row of bits for each line of b."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if sum(len(places.get(x, ())) for x in a) > 16 * (len(a) + len(b)):
        return _shared_bits(a, b)
    tops: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tops, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                nodes.append(node)
            else:
                tops[k], nodes[k] = j, node
    on = [False] * len(a)
    node = nodes[-1] if nodes else None
    while node:
        on[node[0]] = True
        node = node[2]
    return on


def _shared_bits(a: list[int], b: list[int]) -> list[bool]:
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    on, row, col = [False] * len(a), len(b), len(a)
    while row and col:  # a zero bit: the prefix of a that ends there is worth one more with this much of b
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        elif row > 1 and not rows[row - 2] >> (col - 1) & 1:
            row -= 1
        else:
            row, col = row - 1, col - 1
            on[col] = True
    return on


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]


def _neighbours(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row, row before or None, row after or None) of a sorted stream."""
    before = now = None
    for row in rows:
        if now is not None:
            yield now, before, row
        before, now = now, row
    if now is not None:
        yield now, before, None


def _frame_lines(path: str, keys: list[int], near: list[tuple[str, list[int]]]) -> list[bool]:
    """Whether each line is shared with the page of nearest path. A page with all these lines is a copy and tells nothing
    about the frame, so the other neighbour is asked then."""
    for _, other in sorted(near, key=lambda x: -_prefix(path, x[0])):
        if not all(on := shared_lines(keys, other)):
            return on
    return [False] * len(keys)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every row: lines that differencing and their place leave, joined by one space.

    A null or empty page has the empty text. A null URL belongs to the empty host. Pages with equal URLs are neighbours;
    repeated rows stay. Pages are dealt out in ranges of the order of host, path, URL and id, so that no host is one
    task; the edge pages of a range are also sent to the ranges beside it, so pairs don't depend on where ranges end.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    number = F.lpad(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), 20, " ")
    key = F.concat_ws("\x00", host, path, url, number)
    ranges = pages.sparkSession.sparkContext.broadcast(Ranges(pages, key, 32 * parts(pages.sparkSession)))
    base = pages.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = ranges.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, number, own, texts, places, keys = [], [], [], [], [], []
                for i, (k, page) in enumerate(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    lines = lines_of(page)
                    hashes = _line_hashes([x for x, _ in lines])
                    for r, mine in cut.places(k):
                        row.append(i)
                        number.append(r)
                        own.append(mine)
                        texts.append([x for x, _ in lines] if mine else [])
                        places.append(bytes(p for _, p in lines) if mine else b"")
                        keys.append(hashes)
                took = [c.take(pa.array(row, pa.int64())) for c in part.columns[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *took, pa.array(own), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["range", "key", "id", "url", "own", "texts", "places", "keys"])

    lines = base.mapInArrow(parse, f"range int, key string, id {id_type}, url {url_type}, own boolean, texts array<string>, places binary, keys array<bigint>")
    lines = lines.repartition(4 * parts(pages.sparkSession), "range").sortWithinPartitions("range", "key", "own")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    yield from zip(*(part.column(i).to_pylist() for i in range(8)), strict=True)

        ids, urls, out = [], [], []
        for now, before, after in _neighbours(rows()):
            r, key, page, url, own, texts, places, keys = now
            if not own:
                continue
            host, path, *_ = key.split("\x00")
            near = [(p[1], x[7]) for x in (before, after) if x is not None and x[0] == r and (p := x[1].split("\x00"))[0] == host]
            shared = _frame_lines(path, keys, near)
            article = any(p == OWN for p in places)
            keep = [p == OWN or (p == OPEN and not article and not s) for p, s in zip(places, shared, strict=True)]
            ids.append(page)
            urls.append(url)
            out.append(" ".join(t for t, k in zip(texts, keep, strict=True) if k))
            if len(out) == 256:
                yield _texts(ids, urls, out)
                ids, urls, out = [], [], []
        yield _texts(ids, urls, out)

    types = lines.select("id", "url").schema

    def _texts(ids: list, urls: list, out: list[str]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(types["id"].dataType)), pa.array(urls, to_arrow_type(types["url"].dataType)), pa.array(out, pa.string())], [id_col, url_col, "text"])

    return lines.mapInArrow(difference, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string")
