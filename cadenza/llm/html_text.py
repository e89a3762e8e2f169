"""Main text of web pages by nearest-URL differencing.

Pages are sorted by host and URL path.  Each is compared with the nearest pages of its host: the last `reach` before it and the
first `reach` after it whose contents differ from its own, where pages of equal content that follow each other count as one.
Contents are equal if all lines but chrome are, so copies and one page under two query strings are no neighbours.  The lines of
a page and of each neighbour are aligned by a longest common subsequence, and shared lines are deleted by these rules, in which
the markup is a prior:

* a line outside of any article (or main) element goes if one neighbour shares it;
* a line in an article goes if all neighbours, and three at least, share it: articles quote each other, but what all
  pages around repeat is the site's.  A neighbour that shares over half of the article's lines is another version of the
  page and says nothing about them;
* a line in an element that is chrome by tag, role or class (menus, footers, adverts, forms, comments ...) goes before that,
  for much of it differs from page to page.

A page's lines move once, to a range of (host, path) whose bounds come from a sample with ties broken by id, so that a host
with a third of all pages is spread out.  Where a page's neighbours lie in another range, a pass over keys and digests
alone has found them before (2 * (reach + 1) pages a range reach the driver), and their lines go to both ranges; so the text
does not depend on the number of ranges.
"""

from __future__ import annotations

import bisect
import hashlib
import html as _html
import math
import re
from collections import deque
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import col, range_bounds, range_count, spread
from .url_rules import host_of, path_of

MAIN, CHROME, OTHER = 2, 0, 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no markup, and is dropped.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
_CHROME_TAG = set("nav footer aside form menu dialog select button head fieldset".split())
_CHROME_ROLE = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CHROME_WORD = set(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription"
    " signup social share sharing sharebar sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist respond replies reply discussion disqus related recommended"
    " recommendations popup modal overlay widget widgets toolbar pagination pager login search searchbox tags disclaimer copyright".split()
)
_HEADER_WORD = {"header", "siteheader", "pageheader"}
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is chrome; inside: within an article."""
    if tag in _CHROME_TAG or tag == "header" and not inside:
        return True
    if "=" not in attributes:
        return False
    for name, *value in _ATTRIBUTE.findall(attributes):
        value = "".join(value).lower()
        if name.lower() == "role":
            if value in _CHROME_ROLE:
                return True
        else:
            for word in _WORD.findall(value):
                if word in _CHROME_WORD or word in _HEADER_WORD and not inside:
                    return True
    return False


def page_lines(source: str) -> list[tuple[int, str]]:
    """(zone, line) of every block with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # (tag, zone)
    zone, text = OTHER, []
    at, end = 0, len(source)

    def flush():
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                out.append((zone, line))
            text.clear()

    match = _TOKEN.match
    while at < end:
        m = match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                text.append(piece)
            elif piece.startswith("<![CDATA["):
                text.append(piece[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end
            if tag in _BLOCK:
                flush()
            elif tag in ("td", "th"):
                text.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in _BLOCK:
                        flush()
                    del stack[k:]
                    zone = stack[-1][1] if stack else OTHER
                    break
            continue
        if tag in _RAW:
            done = _RAW_END[tag].search(source, at)
            at = done.end() if done else end
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            if tag == "br":
                text.append(" ")
            continue
        if tag in ("td", "th"):
            text.append(" ")
        attributes = m[3] or m[6] or ""
        inside = zone == MAIN
        if zone != CHROME and _is_chrome(tag, attributes, inside):
            flush()
            zone = CHROME
            stack.append((tag, zone))
        elif tag in ("article", "main") and zone != CHROME or 'role="main"' in attributes and zone != CHROME:
            zone = MAIN
            stack.append((tag, zone))
        elif tag in _BLOCK and tag != "p" or stack and stack[-1][0] == tag:
            stack.append((tag, zone))
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Indexes of a in a longest common subsequence with b.

    By bit vectors: one big integer a line of a, a bit a line of b, so len(a) * len(b) / 64 steps of a machine word however often
    lines repeat.  The vectors are kept for a stretch of a at a time and made again from its start, so memory
    is near the square root of that.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    rows = [i for i, x in enumerate(a) if x in masks]  # the others match nothing
    if not rows:
        return found
    full = (1 << len(b)) - 1

    def walk(v, some):
        for i in some:
            u = v & masks[a[i]]
            v = (v + u | v - u) & full
            yield v

    step = math.isqrt(len(rows)) + 1
    starts, v = [full], full
    for k in range(0, len(rows), step):
        for v in walk(v, rows[k : k + step]):
            pass
        starts.append(v)
    j = len(b)
    for k in range((len(rows) - 1) // step, -1, -1):  # back over the stretches
        part = rows[k * step : (k + 1) * step]
        vectors = [starts[k], *walk(starts[k], part)]
        for r in range(len(part), 0, -1):
            while j and vectors[r] >> (j - 1) & 1:  # the last line of b adds nothing here
                j -= 1
            if not j:
                return found
            if vectors[r - 1] >> (j - 1) & 1:  # nor did it a line earlier: a match
                found.add(head + part[r - 1])
                j -= 1
    return found


def deleted(zones: list[int], lines: list[str], others: list[list[str]]) -> set[int]:
    """Indexes of the lines (without chrome) that the alignments delete; others: the neighbours' lines."""
    shared = [common_lines(lines, x) for x in others]
    out = {i for s in shared for i in s if zones[i] == OTHER}
    article = [i for i, z in enumerate(zones) if z == MAIN]
    votes = [s for s in shared if 2 * sum(i in s for i in article) <= len(article)]
    if len(votes) >= 3:
        out |= {i for i in article if all(i in s for s in votes)}
    return out


def content_key(found: list[tuple[int, str]]) -> bytes:
    """A digest of a page's lines and zones, chrome left out."""
    h = hashlib.blake2b(digest_size=16)
    for z, x in found:
        if z != CHROME:
            h.update(b"%d" % z + x.encode("utf-8", "surrogatepass") + b"\n")
    return h.digest()


def host_part(key: str) -> str:
    return key.split("\x01", 1)[0]


def range_ends(batches, reach: int):
    """The runs (pages of equal content, one of them standing for all) at both ends of each range.

    Of the first host the first reach + 1 runs, of the last host the last, as (sort, digest) lists; alone: whether it is one host.
    """
    names = ["bucket", "first_sort", "first_digest", "last_sort", "last_digest", "alone"]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.bool_()]
    bucket, first, last, alone = None, [], [], True

    def row():
        values = [bucket, [p[0] for p in first], [p[1] for p in first], [p[0] for p in last], [p[1] for p in last], alone]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for k, *page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != bucket:
                if bucket is not None:
                    yield row()
                bucket, first, last, alone = k, [page], [page], True
                continue
            if host_part(page[0]) != host_part(last[-1][0]):
                last, alone = [page], False
                continue
            if page[1] == last[-1][1]:
                last[-1] = page  # the run's last page stands for it from behind, its first from before
                continue
            if alone and len(first) <= reach:
                first.append(page)
            last = [*last[-reach:], page]
    if bucket is not None:
        yield row()


ENDS = "bucket int, first_sort array<string>, first_digest array<binary>, last_sort array<string>, last_digest array<binary>, alone boolean"


def guests(ends: list[tuple], reach: int) -> dict[tuple[str, bytes], list[tuple[int, int]]]:
    """Pages (key, digest) that another range needs, with that range and -1 if they come before it, 1 if after.

    ends: (bucket, first runs, last runs, alone) of range_ends, by bucket.
    """
    out: dict = {}

    def walk(side, rows):
        near = []  # the nearest runs of all ranges passed, the nearest last
        for bucket, mine, far, alone in rows:  # mine: runs from the side that we come from, nearest first
            if near and host_part(near[-1][0]) != host_part(mine[0][0]):
                near = []
            seen = near[:-1] if near and near[-1][1] == mine[0][1] else near  # a run may go on over the bound
            for guest in seen[-reach:]:
                out.setdefault(guest, []).append((bucket, side))
            if alone and len(mine) <= reach:
                near = (seen + mine)[-reach - 1 :]
                near[-1] = far[-1]
            else:
                near = far[-reach - 1 :]

    walk(-1, ends)
    walk(1, [(k, last[::-1], first[::-1], alone) for k, first, last, alone in reversed(ends)])
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", reach: int = 2, buckets: int | None = None) -> DataFrame:
    """pages, less their html, with text (main text, its blocks joined by newlines) and n_chars.

    Null or empty html gives an empty text.  Null URLs, or URLs without ://, form a host of their own.  Repeated pages are
    compared with the nearest pages that differ, and a page whose host has no other content keeps all but its chrome.
    Columns named text or n_chars are replaced.
    """
    n = buckets or range_count(pages, F.octet_length(col(html_col)))
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars") and f.name != html_col]
    key = F.concat(host_of(col(url_col)), F.lit("\x01"), path_of(col(url_col)), F.lit("\x01"), F.hex(F.xxhash64(col(id_col), col(url_col))))
    bounds = range_bounds(pages.select(key.alias("k")), n)

    def outline(batches):
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                at = [bisect.bisect_right(bounds, s) for s in batch.column(0).to_pylist()]
                digests = [content_key(page_lines(source or "")) for source in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.array(digests, pa.binary())], ["_bucket", "_sort", "_digest"])

    away: dict = {}
    if bounds:
        keys = pages.select(key.alias("_sort"), col(html_col).alias("_html")).mapInArrow(outline, "_bucket int, _sort string, _digest binary")
        ends = keys.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_sort", "_digest").mapInArrow(lambda batches: range_ends(batches, reach), ENDS).collect()  # a row a range
        runs = lambda sorts, digests: [(s, bytes(d)) for s, d in zip(sorts, digests)]
        away = guests(sorted(((r.bucket, runs(r.first_sort, r.first_digest), runs(r.last_sort, r.last_digest), r.alone) for r in ends), key=lambda r: r[0]), reach)

    def parse(batches):
        sent = set()
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                zones, lines, digests, place = [], [], [], []
                for i, (sort, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found = [f for f in page_lines(source or "") if f[0] != CHROME]
                    zones.append(bytes(z for z, _ in found))
                    lines.append([x for _, x in found])
                    digests.append(content_key(found))
                    place.append((i, bisect.bisect_right(bounds, sort), 0))
                    for to in away.get((sort, digests[-1]), ()):
                        if (sort, digests[-1], to) not in sent:
                            sent.add((sort, digests[-1], to))
                            place.append((i, *to))
                made = pa.RecordBatch.from_arrays([batch.column(1), pa.array(digests, pa.binary()), batch.column(0), pa.array(zones, pa.binary()), pa.array(lines, pa.list_(pa.string()))], names[2:])
                made = made.take(pa.array([p[0] for p in place], pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array([p[k] for p in place], pa.int32()) for k in (1, 2)], *made.columns], names)

    names = ["_bucket", "_side", "_sort", "_digest", "_row", "_zones", "_lines"]
    rows = pages.select(F.struct(*[col(f.name) for f in kept]).alias("_row"), key.alias("_sort"), col(html_col).alias("_html"))
    kinds = [T.IntegerType(), T.IntegerType(), T.StringType(), T.BinaryType(), rows.schema["_row"].dataType, T.BinaryType(), T.ArrayType(T.StringType())]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, kinds, strict=True)])
    placed = rows.mapInArrow(parse, schema).repartition(n, "_bucket").sortWithinPartitions("_bucket", "_side", "_sort", "_digest")

    def difference(batches):
        made = []
        for done in texts(runs(read(batches))):
            made.append(done)
            if len(made) == 256:
                yield emit(made)
                made = []
        if made:
            yield emit(made)

    def runs(pages_):
        """Pages of equal content that follow each other, as lists."""
        run = []
        for page in pages_:
            if run and run[-1]["place"] == page["place"] and run[-1]["digest"] == page["digest"]:
                page["zones"], page["lines"] = run[-1]["zones"], run[-1]["lines"]  # copies share memory
                run.append(page)
                continue
            if run:
                yield run
            run = [page]
        if run:
            yield run

    def texts(all_runs):
        """(row, text) of the pages of each run, once the runs after it are there."""
        before, waiting = deque(maxlen=reach), deque()
        for run in chain(all_runs, [None]):
            ends = run is None or waiting and waiting[-1][0]["place"] != run[0]["place"]
            while waiting and (ends or len(waiting) > reach):
                now = waiting.popleft()
                yield from finish(before, now, list(waiting)[:reach])
                before.append(now[:1])
            if ends:
                before.clear()
            waiting.append(run)

    def read(batches):
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                for i, (bucket, side, sort, digest, zones, lines) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)), strict=True)):
                    host = host_part(sort)
                    yield {"place": (bucket, host), "side": side, "digest": digest, "zones": list(zones), "lines": lines, "row": batch.column(4).take(pa.array([i]))}

    def finish(before, run, after):
        mine = [page["row"] for page in run if not page["side"]]  # the others are another range's
        if mine:
            lines = run[0]["lines"]
            gone = deleted(run[0]["zones"], lines, [r[0]["lines"] for r in [*before, *after]])
            text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            for row in mine:
                yield row, text

    def emit(made):
        row = pa.concat_arrays([m[0] for m in made])
        text = pa.array([m[1] for m in made], pa.string())
        return pa.RecordBatch.from_arrays([*[row.field(k) for k in range(len(kept))], text, pa.array([len(m[1]) for m in made], pa.int64())], [*[f.name for f in kept], "text", "n_chars"])

    return placed.mapInArrow(difference, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), "html")
    return extract_text(pages)
