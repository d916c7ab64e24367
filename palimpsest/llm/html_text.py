"""Main text of web pages: element rules where the page marks its article, a host's repeated blocks where it doesn't.

A page's markup is cut into blocks. Blocks inside `article` or `main` are the main text; blocks inside menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, media and reader comments (by element, role, class or id) are not. What is neither
is open. On pages that mark no article, open blocks are settled by the host: a run of whole neighbouring blocks with RUN tokens or more
that stands on MANY pages with distinct contents (on both, where the host has two) is boilerplate, and the other blocks are kept whole.
A phrase inside a block never counts, and pages with equal contents are copies and count once. Where all of a page's blocks are such runs, those on the
fewest pages are its own text (a copied article), unless all stand on equally many. Every repeat of that size has a shortest run from each
of its blocks on or back, so only those are sent, by (host, hash of the run): a host with a third of all pages is spread over all tasks.

Articles that are copies of each other keep their text: repetition decides only about open blocks. Character references are
decoded, white space in a block becomes one space, blocks are joined in page order by one space. Null or empty html: an empty text. Null urls
are one host. Identical rows count as one page and each gets its result row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, staged

#: Tokens of the shortest run of blocks that counts as boilerplate; pages that it stands on; parts of a host's runs in a join.
RUN, MANY, PARTS = 6, 3, 64

_ATTRIBUTES = r"""((?:"[^"]*"|'[^']*'|[^'">])*)"""
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|select)\b" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)" + _ATTRIBUTES + r">|<[!?][^>]*(?:>|\Z)", re.S | re.I
)
# Elements by their part in a page.
_ASIDE = frozenset("nav footer aside form menu dialog button figure video audio head".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# End tags that may be left out. A start tag of a key ends an open element of its first set, up to one of its second set.
_CELLS = frozenset("table td th caption".split())
_ENDS = {x: (frozenset(["p"]), _CELLS | {"button"}) for x in _BLOCK - frozenset("body br caption head html legend tbody td tfoot th thead tr".split()) | {"form", "menu", "nav", "dialog"}}
_ITEM_ENDS = {
    "li": (frozenset(["li"]), _CELLS | {"ul", "ol", "menu"}), "dt": (frozenset(["dt", "dd"]), _CELLS | {"dl"}), "dd": (frozenset(["dt", "dd"]), _CELLS | {"dl"}), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])), **{x: (frozenset("thead tbody tfoot caption".split()), frozenset(["table"])) for x in ("thead", "tbody", "tfoot")},
}
_TABLE = frozenset("table caption thead tbody tfoot tr td th html body".split())
_NAMES = re.compile(r"""\b(?:class|id|role|data-role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side-bar|aside|widget|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|toolbar|pagination|pager|masthead|complementary|contentinfo|skip-link|hidden)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_SPACES = re.compile(r"\s+")


def _end(opened: list[str], names: frozenset[str], border: frozenset[str]) -> None:
    """End the innermost open element of `names` and what is open in it, unless one of `border` lies between."""
    for k in range(len(opened) - 1, -1, -1):
        if opened[k] in names:
            del opened[k:]
            return
        if opened[k] in border:
            return


def _end_tag(opened: list[str], name: str) -> None:
    if name in _TABLE:
        border = frozenset() if name in ("table", "html", "body") else frozenset(["table"])
    elif name in _BLOCK or name in _ASIDE:
        border = _CELLS | {"ul", "ol", "menu"} if name == "li" else _CELLS | {"button"} if name == "p" else _CELLS
    else:
        border = _BLOCK
    _end(opened, frozenset([name]), border)


def blocks_of(html: str) -> tuple[list[str], list[str]]:
    """The texts of a page's article blocks and of its open blocks, in page order."""
    main: list[str] = []
    free: list[str] = []
    held: list[str] = []
    opened: list[str] = []
    # Elements that are open around the one that is left out; -1: none is.
    inside, skip, at = 0, -1, 0

    def close() -> None:
        text = _SPACES.sub(" ", unescape("".join(held))).strip()
        held.clear()
        if text:
            (main if inside else free).append(text)

    for m in _MARKUP.finditer(html):
        if skip < 0 and m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            if m[1] and m[1].lower() not in ("math", "svg"):
                held.append(" " if skip < 0 else "")
            continue
        name, end = name.lower(), bool(m[3])
        if end:
            _end_tag(opened, name)
        else:
            for ends in (_ENDS, _ITEM_ENDS):
                if name in ends:
                    _end(opened, *ends[name])
        if skip >= 0:
            if len(opened) > skip:
                if not end and name not in _VOID:
                    opened.append(name)
                continue
            skip = -1
        if name in _BLOCK:
            close()
        if end:
            if name in ("article", "main") and inside:
                inside -= 1
            continue
        if name not in _VOID:
            opened.append(name)
        drop = name in _ASIDE or (name == "header" and not inside)
        attributes = m[5]
        if not drop and attributes and name not in ("html", "body", "article", "main"):
            for names in _NAMES.findall(attributes):
                value = "".join(names)
                drop = drop or bool(_CHROME.search(value)) or (not inside and bool(_HEADER.search(value)))
        if drop and name not in _VOID:
            close()
            skip = len(opened) - 1
        elif name in ("article", "main"):
            inside += 1
    if skip < 0 and at < len(html):
        held.append(html[at:])
    close()
    return main, free


PARSED = "page_id long, url string, host string, has_main boolean, text string, open array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        main, free = [], []
        for html in batch.column("html").to_pylist():
            a, b = blocks_of(html or "")
            main.append(a)
            free.append(b)
        columns = [batch.column(c) for c in ("page_id", "url", "host")]
        columns += [pa.array([bool(a) for a in main]), pa.array([" ".join(a) for a in main], pa.string()), pa.array(free, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in PARSED.split(", ")])


def _runs(blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) and hash of the shortest runs of RUN tokens or more, from each block on and back."""
    ends = np.cumsum([b.count(" ") + 1 for b in blocks])
    starts = np.concatenate([[0], ends])[:-1]
    on = np.searchsorted(ends, starts + RUN)
    back = np.searchsorted(starts, ends - RUN, "right") - 1
    at = np.arange(len(blocks))
    pairs = np.concatenate([np.stack([at, on + 1], 1)[on < len(blocks)], np.stack([back, at + 1], 1)[back >= 0]])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    sizes = np.array([len(b.encode()) + 1 for b in blocks], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer("".join(b + "\n" for b in blocks).encode(), np.uint8)
    return pairs[:, 0], pairs[:, 1], mix(span_hash(prefix_hash(raw), edges[pairs[:, 0]], edges[pairs[:, 1]])).view(np.int64)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct run of a page."""
    for batch in batches:
        for key, host, blocks in zip(batch.column("page_key").to_pylist(), batch.column("host").to_pylist(), batch.column("open").to_pylist(), strict=True):
            runs = np.unique(_runs(blocks)[2]) if blocks else np.zeros(0, np.int64)
            n = len(runs)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(runs), pa.array([key] * n, pa.int64())], ["host", "run", "page_key"])


def own_blocks(blocks: list[str], repeated: dict[int, int]) -> list[str]:
    """A page's open blocks without boilerplate; repeated: hash of a run -> pages that it stands on."""
    if not blocks or not repeated:
        return blocks
    pages = np.zeros(len(blocks), np.int64)
    for first, last, run in zip(*(x.tolist() for x in _runs(blocks)), strict=True):
        pages[first:last] = np.maximum(pages[first:last], repeated.get(run, 0))
    # The least is 0 where the page has blocks of its own.
    least = int(pages.min())
    return [b for b, n in zip(blocks, pages.tolist(), strict=True) if n == least and (n == 0 or n < pages.max())]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, repeated in zip(batch.column("open").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
            texts.append(" ".join(own_blocks(blocks, {r["run"]: r["pages"] for r in repeated or []})))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").alias("html"))
    parsed = rows.mapInArrow(_parse, PARSED)
    marked = parsed.where("has_main").select("page_id", "url", "text")
    # Only open blocks are staged: the articles go straight to the result. A page's key is its contents.
    key = F.xxhash64("host", "has_main", "text", F.to_json("open"))
    free = staged(parsed.where("size(open) > 0 or not has_main").withColumn("page_key", key).drop("text"), "pages-open")
    contents = free.dropDuplicates(["page_key"]).select("page_key", "host", "open", "has_main")
    runs = contents.mapInArrow(_sent, "host string, run long, page_key long")
    counts = runs.groupBy("host", "run").agg(F.count("*").alias("pages")).where("pages > 1")
    # A host of two pages: its row goes to each part, so that no host's runs come together in one.
    pairs = contents.groupBy("host").count().where("count = 2").select("host", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    few = counts.where(F.col("pages") < MANY).withColumn("part", F.pmod("run", F.lit(PARTS)).cast("int")).join(pairs, ["host", "part"], "left_semi").drop("part")
    repeated = counts.where(F.col("pages") >= MANY).unionByName(few)
    unmarked = free.where("not has_main")
    found = runs.join(unmarked.select("page_key").distinct(), "page_key", "left_semi").join(repeated, ["host", "run"]).groupBy("page_key").agg(F.collect_list(F.struct("run", "pages")).alias("repeated"))
    settled = unmarked.join(found, "page_key", "left").select("page_id", "url", "open", "repeated").mapInArrow(_settled, "page_id long, url string, text string")
    return marked.unionByName(settled)
