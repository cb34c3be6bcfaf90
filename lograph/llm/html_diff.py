"""Main text of web pages by differencing each page with the one of the nearest address.

1. A page is read into lines: the visible text of each block, in page order, with what the markup says of it (article,
   boilerplate, neither).
2. Pages are ordered by host and path and numbered densely; the nearest page is the one before or after on the
   same host whose path shares the longer start (of equals the one before). Only hashes of lines travel.
3. The lines of the two pages are aligned by their longest common subsequence, and shared lines are deleted.

Inside a declared article (or main) element a shared line goes only if all pages around it on the host have it (``AROUND`` before
and after, ``LEAST`` in all at least), since articles quote each other; none goes from an article half of whose lines would, a copy among
copies. Lines of a page that declares an article count only inside it. Lines of
menus, forms, adverts and so on go although not shared. A page without a declared article all of whose
lines are shared is a copy of its neighbour and keeps them.

Blocks of ``BLOCK`` neighbouring pages are one group each, so a host with any number of pages is spread.

Cases: null or empty html gives the empty text. A null address has no neighbour. Equal rows are one page in the order
and get the same text. Unclosed tags end with the element around them, an unclosed comment or script hides
the rest, as in browsers. Long texts are read whole. Extra columns are kept, but for those named like a result or a column in between (``HELPERS``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograph.operators.running import numbered, positioned
from lograph.session import written

BLOCK = 1024
#: Pages on either side that must have a shared line of an article, and the least number of them.
AROUND, LEAST = 2, 3
HELPERS = frozenset("html text n_shared k1 k2 host path packed shared often".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
SPACE = re.compile(r"\s+")
#: Elements of the markup language by what they mean here.
HIDDEN = frozenset("script style noscript template iframe svg math head title object audio video canvas textarea".split())
RAW = frozenset("script style noscript template iframe svg math title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu nav"
    " navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus share sharing social related popup modal newsletter subscribe"
    " subscription widget toolbar pagination pager overlay alert".split()
)
#: What a line may be.
PLAIN, ARTICLE, DROPPED = 0, 1, 2


def boilerplate(name: str, attrs: str) -> bool:
    """Whether an element is marked as no part of the article."""
    if name in BOILERPLATE:
        return True
    if not attrs or attrs.isspace():
        return False
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), html.unescape("".join(values)).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main", "article"):
            for token in value.split():
                parts = re.split(r"[^a-z0-9]+", token)
                if parts[0] not in ("has", "with", "no", "without") and (parts[0] in MARKS or parts[-1] in MARKS):
                    return True
    return False


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """The lines of a page and what each is. Line breaks inside a block are white space."""
    found: list[tuple[str, int]] = []
    held: list[str] = []
    # Open elements as (name, kind of their text); the kind of a child is at least that of its parent.
    stack: list[tuple[str, int]] = [("", PLAIN)]

    def flush() -> None:
        if held:
            line = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if line:
                found.append((line, stack[-1][1]))

    page = page or ""
    at = 0
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            if stack[-1][1] != DROPPED:
                held.append(text)
            continue
        name = token["name"] or token["name2"]
        if name is None:
            continue
        name = name.lower()
        if token["end"] or token["end2"]:
            if name not in INLINE:
                flush()
            # An end tag closes what is open inside its element; without one it says nothing.
            for place in range(len(stack) - 1, 0, -1):
                if stack[place][0] == name:
                    if any(kind == DROPPED for _, kind in stack[place:]) and name in INLINE:
                        flush()
                    del stack[place:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else len(page)
            continue
        if name not in INLINE and (name not in VOID or name in ("br", "hr")):
            flush()
        if name in VOID:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") or (name not in INLINE and stack[-1][0] == "p"):
            closing = name if name in ("li", "tr", "td", "th", "dt", "dd", "option") else "p"
            for place in range(len(stack) - 1, 0, -1):
                if stack[place][0] == closing:
                    del stack[place:]
                    break
                if stack[place][0] not in INLINE:
                    break
        kind = stack[-1][1]
        attrs = token["attrs"] or ""
        if kind != DROPPED:
            if name in HIDDEN or boilerplate(name, attrs) or (name == "header" and kind != ARTICLE):
                kind = DROPPED
                if name in INLINE:
                    flush()
            elif name in ("article", "main"):
                kind = ARTICLE
        stack.append((name, kind))
    flush()
    return found


def visible_lines(page: str | None) -> list[tuple[str, int]]:
    return [(line, kind) for line, kind in page_lines(page) if kind != DROPPED]


def main_text(lines: list[tuple[str, int]], shared: list[int], often: list[int] | None = None) -> str:
    """The main text: the lines that stay, with the places of the lines shared with the nearest page, and of those all pages around have."""
    gone = set(shared)
    article = [place for place, (_, kind) in enumerate(lines) if kind == ARTICLE]
    if article:
        gone = set(often or ()).intersection(article)
        kept = [lines[place][0] for place in article if place not in gone or 2 * len(gone) >= len(article)]
    else:
        kept = [line for place, (line, _) in enumerate(lines) if place not in gone] or [line for line, _ in lines]
    return " ".join(kept)


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Rows of the length table are bit sets held in one number each, so a row costs a few operations on numbers of ``len(b)`` bits.
    """
    both = set(a) & set(b)
    rows = [i for i, x in enumerate(a) if x in both]
    other = [x for x in b if x in both]
    lead = 0
    while lead < min(len(rows), len(other)) and a[rows[lead]] == other[lead]:
        lead += 1
    found, rows, other = rows[:lead], rows[lead:], other[lead:]
    tail: list[int] = []
    while rows and other and a[rows[-1]] == other[-1]:
        tail.append(rows.pop())
        other.pop()
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    table = [full]
    for i in rows:
        now = table[-1]
        match = now & where.get(a[i], 0)
        table.append(((now + match) | (now - match)) & full)
    # A zero bit j of row i: the common length of the first i lines with the first j + 1 is one more than with the first j.
    i, j = len(rows), len(other)
    picked = []
    while i and j:
        bit = 1 << (j - 1)
        if table[i] & bit:
            j -= 1
        elif not table[i - 1] & bit:
            i -= 1
        else:
            picked.append(rows[i - 1])
            i, j = i - 1, j - 1
    return found + picked[::-1] + tail[::-1]


def with_hashes(pages: DataFrame) -> DataFrame:
    """Per page ``k1``, ``k2``, ``host``, ``path`` and the hashes of its lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [pa.array([line for line, _ in visible_lines(page.as_py())], pa.string()) for page in batch.column("html")]
            hashes = [[line_hash(x) for x in own.to_pylist()] for own in lines]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("k1", "k2", "host", "path")], pa.array(hashes, pa.list_(pa.int64()))], names=["k1", "k2", "host", "path", "lines"],
            )

    return pages.select("k1", "k2", "host", "path", "html").mapInArrow(run, "k1 bigint, k2 bigint, host string, path string, lines array<bigint>")


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def compare_block(rows: pa.Table) -> pa.Table:
    """Shared lines of each page of a block (not of the context at its edges) with its nearest page."""
    rows = rows.sort_by("pos")
    hosts, paths, lines = (rows.column(c).to_pylist() for c in ("host", "path", "lines"))
    own = rows.column("own").to_pylist()

    def near(i: int, j: int) -> int:
        if not 0 <= j < len(hosts) or hosts[i] != hosts[j]:
            return -1
        a, b = paths[i], paths[j]
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    held = [set(x) for x in lines]
    out, often = [], []
    for i in range(len(hosts)):
        if own[i]:
            before, after = near(i, i - 1), near(i, i + 1)
            partner = i - 1 if before >= after else i + 1
            out.append(common(lines[i], lines[partner]) if max(before, after) >= 0 else [])
            around = [j for j in range(i - AROUND, i + AROUND + 1) if j != i and near(i, j) >= 0]
            often.append([k for k in out[-1] if all(lines[i][k] in held[j] for j in around)] if len(around) >= LEAST else [])
    there = np.flatnonzero(np.array(own, dtype=bool))
    keys = rows.select(["k1", "k2"]).take(pa.array(there))
    kind = pa.list_(pa.int32())
    return keys.append_column("shared", pa.array(out, kind)).append_column("often", pa.array(often, kind))


def shared_lines(pages: DataFrame) -> DataFrame:
    """Per page (by its two keys) the places of lines that it shares with its nearest page."""
    hashes = with_hashes(pages.filter("host is not null")).dropDuplicates(["k1", "k2"])
    placed = numbered(positioned(hashes, ["host", "path", "k1", "k2"], "seq"), ["seq"], "pos").drop("seq")
    block = F.floor(F.col("pos") / BLOCK)
    at = F.col("pos") % BLOCK
    # Pages at the edge of a block are also context of the block next to it.
    copies = F.array_compact(F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.when((at < AROUND) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(at >= BLOCK - AROUND, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
    ))
    grouped = placed.withColumn("c", F.explode(copies)).select("k1", "k2", "host", "path", "lines", "pos", "c.block", "c.own").groupBy("block")
    return written(grouped.applyInArrow(compare_block, "k1 bigint, k2 bigint, shared array<int>, often array<int>"), "shared")


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of an address, both without what follows."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(host != "", host), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def extracted(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (``page_id``, ``url``, ``html``) but the html, and ``text`` and ``n_shared``."""
    host, path = address(F.col("url"))
    keyed = pages.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64("html", "url", F.lit(1), "page_id"), "host": host, "path": path})
    shared = shared_lines(keyed)
    kept = [f for f in pages.schema.fields if f.name not in HELPERS]
    names = [f.name for f in kept]
    packed = T.StructType([*kept, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            lines = ["\n".join(f"{kind}{line}" for line, kind in visible_lines(page.as_py())) for page in batch.column("html")]
            blobs = [zstd.compress(x.encode("utf-8", "surrogatepass")) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in [*names, "k1", "k2"]], pa.array(blobs, pa.binary())], names=[*names, "k1", "k2", "packed"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            shared, often = (batch.column(c).to_pylist() for c in ("shared", "often"))
            lines = [zstd.decompress(x.as_py()).decode("utf-8", "surrogatepass") for x in batch.column("packed")]
            texts = [
                main_text([(line[1:], int(line[0])) for line in own.split("\n")] if own else [], gone or [], most or []) for own, gone, most in zip(lines, shared, often)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string()), pa.array([len(s or []) for s in shared], pa.int64())],
                names=[*names, "text", "n_shared"],
            )

    # Pages meet their shared lines as packed lines, a fraction of the html.
    joined = keyed.drop("host", "path").mapInArrow(pack, packed).join(shared, ["k1", "k2"], "left").select(*names, "packed", "shared", "often")
    return joined.mapInArrow(assemble, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_shared", T.LongType())]))
