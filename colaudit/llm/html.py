"""Main text of web pages by nearest-URL page differencing.

The distinct pages of a host (by a hash of their html, each at its first URL) are range-partitioned and sorted
by host and the segments of the URL path, so a page's neighbours in that order are those with the nearest
paths; the pages at a part's edges are sent to the part beside it too, so no text depends on where parts
begin.  Each page's text lines (its blocks) are aligned with those of the neighbour that shares more path
segments, by longest common subsequence with bit vectors, and lines that both have are deleted: menus and
notices recur, an article does not.

Differencing decides first, over all lines of the page.  It errs where two pages carry the same article and
where a footer or advert is unique, so structure may object: shared blocks in an article or main element
stand, and unshared ones in navigation, headers, footers, sidebars, notices, adverts, forms and comments fall.
Scripts, styles and hidden markup have no lines.  A page without a neighbour keeps to its article, if it
has one.

Defined results: null or empty html gives an empty text; a null url counts as an empty one (its pages
are one host); identical copies on a host get the result of the first in the order; the first and last page of a
host have one neighbour (a page alone has none and loses no line); tags may be unclosed; a very long page is
aligned whole, in memory that grows with the root of its lines; pages with null or repeated ids are kept each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_RAW = frozenset("script style template noscript textarea title svg math iframe object canvas select".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_DROP = frozenset("nav footer aside form menu dialog head button".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button".split()
)
_ENDED = frozenset("p li dt dd option tr td th".split())  # end where the next block begins
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed words of class, id and role that mark what is not the article.
_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertorial sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices banner alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search pagination pager masthead contentinfo complementary dialog topbar toolbar skip".split()
)
#: Fixed words for readers' comments, which may themselves be article elements.
_REMARKS = frozenset("comment comments disqus respond replies".split())
#: Fixed words that may stand beside one of these in a longer name.
_NEUTRAL = frozenset("site page post main top bottom left right box bar wrap wrapper container inner outer list item items link links section block widget slot unit area region text form primary secondary global mobile".split())
_LOOSE, _FIRM = 1, 2  # dropped by a name, which an article inside overrules; dropped for good


def _dropped(attrs: str) -> int:
    """How the names in a tag's attributes drop the element: whole names count, not parts of longer ones."""
    out = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())) - {""}
                known = words - _NEUTRAL
                if known and known <= _NAMES | _REMARKS:
                    out = max(out, _LOOSE if known <= _NAMES else _FIRM)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _FIRM
    return out


PLAIN, ARTICLE, DROPPED = "012"  # what structure says of a line


def blocks(page: str | None) -> list[tuple[str, str]]:
    """The text blocks in page order and what structure says of each."""
    out: list[tuple[str, str]] = []
    if not page:
        return out
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: tag, dropped, main
    drop, main = 0, False

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, DROPPED if drop else ARTICLE if main else PLAIN))
            held.clear()

    def pop(n: int) -> None:
        nonlocal drop, main
        flush()
        del stack[n:]
        drop, main = stack[-1][1:] if stack else (0, False)

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            held.append(html.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK or any(s[0] == tag for s in stack):
                flush()
                n = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag), None)
                if n is not None:
                    pop(n)
        elif tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            held.append(" ")
        else:
            block, attrs = tag in _BLOCK, m[3]
            if block:
                flush()
                if stack and stack[-1][0] in _ENDED:
                    pop(len(stack) - 1)
            if tag in _VOID or attrs.endswith("/"):
                continue
            named = _dropped(attrs) if attrs and tag not in ("html", "body") else 0
            gone = _FIRM if tag in _DROP or tag == "header" and not main else max(drop, named)
            if tag in _MAIN and gone == _LOOSE:
                gone = 0
            inside = main or tag in _MAIN
            if tag in _MAIN and not inside or gone != drop or inside != main or block and tag not in _ENDED and tag not in ("html", "body"):
                flush()
                stack.append((tag, gone, inside))
                drop, main = gone, inside
            elif tag in _ENDED and gone:
                stack.append((tag, gone, inside))
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Positions in a of one longest common subsequence with b.

    A row of the table is a bit vector whose zero bits count up along b.  Every root-th row is kept, those
    between are computed again on the way back, so a page of any length takes the same choices.
    """
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = {*range(low), *range(n, len(a))}
    a, b = a[low:n], b[low:m]
    if not a or not b:
        return out
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def rows(v: int, start: int, stop: int) -> list[int]:
        found = [v]
        for x in a[start:stop]:
            u = v & at.get(x, 0)
            v = ((v + u) | (v - u)) & full
            found.append(v)
        return found

    kept = [full]
    for start in range(0, len(a), step):
        kept.append(rows(kept[-1], start, start + step)[-1])
    i, j, base, held = len(a), len(b), len(a) + 1, []

    def count(i: int, j: int) -> int:
        nonlocal base, held
        if not base <= i < base + len(held):
            base = i // step * step
            held = rows(kept[base // step], base, base + step)
        return j - (held[i - base] & ((1 << j) - 1)).bit_count()

    now = count(i, j)
    while now:
        if count(i, j - 1) == now:
            j -= 1
        elif count(i - 1, j) == now:
            i -= 1
        else:
            i, j, now = i - 1, j - 1, now - 1
            out.add(low + i)
    return out


def main_text(lines: list[tuple[str, str]], other: list[tuple[str, str]] | None) -> tuple[str, int]:
    """The text that is left, and how many lines differencing deleted."""
    gone = shared([t for t, _ in lines], [t for t, _ in other]) if other else set()
    gone = {i for i in gone if lines[i][1] != ARTICLE}
    rest = [x for i, x in enumerate(lines) if i not in gone and x[1] != DROPPED]
    if not other and any(m == ARTICLE for _, m in rest):
        rest = [x for x in rest if x[1] == ARTICLE]
    return "\n".join(t for t, _ in rest), len(gone)


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)"


def _order(host: str, path: str, url: str | None, page_id: int | None, digest: bytes) -> tuple:
    """Orders as Spark does: nulls first, strings by code point."""
    return host, path, url is not None, url or "", page_id is not None, page_id or 0, digest


def _ranges(keys: DataFrame, reps: DataFrame, parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """Where each part of the order begins, and the parts beside its own in which a page is a neighbour.

    Only keys are dealt here, and three of each part come to the driver.
    """
    both = keys.select(*KEY, F.lit(False).alias("rep")).unionAll(reps.select(*KEY, F.lit(True)))
    key = F.struct(*KEY)
    found = both.repartitionByRange(parts, *KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("first"), F.min(F.when(F.col("rep"), key)).alias("low"), F.max(F.when(F.col("rep"), key)).alias("high"))
    edges = sorted([_order(*e) if e else None for e in r[1:]] for r in found.collect())
    beside: dict[tuple, list[int]] = {}
    last = None
    for part, (_, low, high) in enumerate(edges):
        if low is None:
            continue
        if last is not None and edges[last][2][0] == low[0]:
            beside.setdefault(edges[last][2], []).append(part)
            beside.setdefault(low, []).append(last)
        last = part
    return [e[0] for e in edges[1:]], beside


KEY = ["host", "path", "url", "page_id", "digest"]
_DEALT = "part int, host string, path string, url string, page_id long, digest binary, kind int, lines binary"
#: Kinds of dealt rows: notes that the page of this key stands for itself alone or for its copies too, a neighbour from another part, a page.
_ALONE, _COPIED, _BESIDE, _PAGE = range(4)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_batches(rows, schema: pa.Schema):
    out = []
    for row in rows:
        out.append(row)
        if len(out) == 500:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def extract(pages: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_shared): n_shared lines were the neighbour's too."""
    spark = pages.sparkSession
    parts = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    url = F.coalesce("url", F.lit(""))
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    keyed = source.select(F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.translate(F.regexp_extract(url, _PATH, 1), "/", "\x01").alias("path"), "url", "page_id", digest.alias("digest"), "html")
    keys = save(keyed.select(*KEY), "keys")
    # of equal pages of a host the first stands for all
    first = keys.groupBy("host", "digest").agg(F.min(F.struct("path", "url", "page_id")).alias("first"), F.count("*").alias("n"))
    reps = save(first.select("host", "first.*", "digest", F.when(F.col("n") > 1, _COPIED).otherwise(_ALONE).alias("kind")), "distinct")
    firsts, beside = _ranges(keys, reps, parts)
    forget(keys)
    dealt_schema = pa.schema([("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("digest", pa.binary()), ("kind", pa.int32()), ("lines", pa.binary())])
    done_schema = pa.schema([("host", pa.string()), ("digest", pa.binary()), ("kind", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())])

    def deal(batches):
        def rows():
            for b in batches:
                for *key, last in zip(*(c.to_pylist() for c in b.columns)):
                    at = _order(*key)
                    part = bisect.bisect_right(firsts, at)
                    if isinstance(last, int):
                        yield part, *key, last, None
                        continue
                    lines = zlib.compress("\n".join(m + t for t, m in blocks(last)).encode("utf-8", "surrogatepass"))
                    yield part, *key, _PAGE, lines
                    for other in beside.get(at, ()):
                        yield other, *key, _BESIDE, lines

        return _in_batches(rows(), dealt_schema)

    def prefix(a: list[str], b: list[str]) -> int:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    def done(prev, cur, after):
        _, host, path, lines, (kind, page_id, url, digest) = cur
        near = [o for o in (prev, after) if o and o[1] == host]
        other = max(near, key=lambda o: prefix(o[2], path))[3] if near else None
        return *((host, digest) if kind == _COPIED else (None, None)), kind, page_id, url, *main_text(lines, other)

    def run(batches):
        def rows():
            prev = cur = note = None
            at = kind = None
            for b in batches:
                for part, host, path, url, page_id, digest, k, lines in zip(*(c.to_pylist() for c in b.columns)):
                    if part != at:
                        if cur and cur[4][0] != _BESIDE:
                            yield done(prev, cur, None)
                        prev = cur = note = None
                        at = part
                    key = host, path, url, page_id, digest
                    if k in (_ALONE, _COPIED):
                        note, kind = key, k
                        continue
                    if k == _BESIDE:
                        if cur and cur[0] == key:
                            continue
                        kind = k
                    elif note != key:
                        yield host, digest, _PAGE, page_id, url, None, None
                        continue
                    note = None
                    after = key, host, path.strip("\x01").split("\x01"), [(x[1:], x[0]) for x in zlib.decompress(lines).decode("utf-8", "surrogatepass").split("\n") if x], (kind, page_id, url, digest)
                    if cur and cur[4][0] != _BESIDE:
                        yield done(prev, cur, after)
                    prev, cur = cur, after
            if cur and cur[4][0] != _BESIDE:
                yield done(prev, cur, None)

        return _in_batches(rows(), done_schema)

    dealt = keyed.mapInArrow(deal, _DEALT).unionAll(reps.mapInArrow(deal, _DEALT))
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *KEY, "kind")
    out = save(ordered.mapInArrow(run, "host string, digest binary, kind int, page_id long, url string, text string, n_shared long"), "texts", {"spark.sql.parquet.compression.codec": "zstd"})
    copies = out.where(F.col("kind") == _PAGE).select("host", "digest", "page_id", "url")
    copied = out.where(F.col("kind") == _COPIED).select("host", "digest", "text", "n_shared")
    names = ["page_id", "url", "text", "n_shared"]
    return out.where(F.col("kind") != _PAGE).select(*names).unionAll(copies.join(copied, ["host", "digest"]).select(*names))
