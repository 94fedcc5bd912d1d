"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles: a node is a path of tags with their
classes. Two entropies over the host's pages are taken of each node. What its blocks say is its
content importance (0: the same notice on every page; 1: another text on each). Which styles
follow each other below it is its presentation importance (a menu is built alike on every page, an
article is not). A block is worth its node's content importance, raised or lowered a little by how its
container is built, times a prior for its place: in an article, beside one, or on a page without.
Blocks worth less than LEAST_IMPORTANCE are cut, inside articles and outside. Names of roles only
set a prior: a branch named a menu or a comment list as a whole has none.

Only hashes of nodes and texts cross the network until it is known what is cut; pages are parsed
again for that, and their text moves once.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread, store

#: Importance below which a branch is cut.
LEAST_IMPORTANCE = 0.5
#: Places of blocks, and their prior.
NOISE, PLAIN, ARTICLE, BESIDE = 0, 1, 2, 3
PRIOR = {NOISE: 0.0, PLAIN: 1.0, ARTICLE: 2.0, BESIDE: 0.6}
#: A container that is built alike on all pages lowers a block's worth by this share, one that never is raises it.
PRESENTATION = 0.1
#: Share of a page's text that, longest blocks first, tells it from copies that differ in a line.
TELLING = 0.9

_RAW = "script|style|noscript|template|textarea|select|svg|iframe|object|head"
_MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_RAW_HEAD = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr dd dt".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Tags, and words in classes, ids and roles, of branches that are not main text.
_NOISE_TAGS = frozenset("nav header footer aside form button dialog menu title".split())
_ROLES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted promotion banner nav navbar navigation
    menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent notice popup modal newsletter
    subscribe subscription share sharing social related comment comments disqus review reviews replies login search contentinfo complementary""".split()
)
#: Words that may stand beside them in a name; a name with any other word is about something, not a role.
_PARTS = frozenset(
    """a and area bar block body bottom box btn button buttons card column container content entry form footer global group head inner item items
    left link links list main menu mobile more outer page panel post posts primary right row secondary section site slot tab text thread title
    toggle tools top unit user users view wrap wrapper""".split()
)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")


@functools.lru_cache(maxsize=1 << 14)
def _names_role(names: str) -> bool:
    """Whether one of the names of a tag is that of a role, as a whole."""
    for name in names.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if any(w in _ROLES for w in words) and all(w in _ROLES or w in _PARTS for w in words):
            return True
    return False


_MAIN_TAGS = frozenset(("article", "main"))
#: Tags whose names say nothing of a role: the whole page, and, in an article, what heads it.
_PAGE_TAGS = frozenset(("html", "body", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


def _role_counts(tag: str, main: bool, stack: list[tuple]) -> bool:
    """Whether classes and ids of the tag may make its branch noise; an article in an article may be a comment."""
    if tag in _PAGE_TAGS or main and tag in _HEADINGS:
        return False
    return tag != "article" or any(x[0] == "article" for x in stack)


def parse(page: str) -> tuple[list[tuple[str, bool, bool, str]], dict[str, list[str]]]:
    """Blocks of a page in order (style path, whether in an article, whether of a noise role, text), and the styles below each path."""
    below: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, in an article, noise
    blocks: list[tuple[str, bool, bool, str]] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in _INLINE:
                    k -= 1
                _, path, main, _ = stack[k] if k >= 0 else ("", "", False, False)
                blocks.append((path, main, bool(stack) and stack[-1][3], text))
            parts.clear()

    last = 0
    # The head holds no text of the page; scripts in it may hold what looks like tags.
    for m in _MARK.finditer(page):
        if m.start() > last:
            parts.append(page[last : m.start()])
        last = m.end()
        if m.group(1):
            if m.group(1).lower() not in ("svg",):
                flush()
            continue
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("br", "img", "wbr"):
            if tag == "br":
                parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            continue
        closed = ("p",) if tag in _CLOSES_P else ()
        closed += _SAME.get(tag, ())
        if closed:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closed:
                    del stack[k:]
                    break
                if stack[k][0] not in _INLINE:
                    break
        names = [" ".join(x for x in a.groups()[1:] if x) for a in _ATTRIBUTE.finditer(m.group(4))] if m.group(4) else []
        _, path, main, noise = stack[-1] if stack else ("", "", False, False)
        noise = noise or tag in _NOISE_TAGS and not (tag == "header" and main) or any(_names_role(x) for x in names) and _role_counts(tag, main, stack)
        style = ".".join([tag, *sorted(re.sub(r"\d+", "0", x) for x in names)])
        if tag not in _INLINE:
            below.setdefault(path, []).append(style)
        stack.append((tag, f"{path}/{style}" if tag not in _INLINE else path, main or tag in _MAIN_TAGS, noise))
    if last < len(page):
        parts.append(page[last:])
    flush()
    return blocks, below


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _placed(url: str | None, raw: bytes | None):
    """Host, key of the page, its blocks that are no noise (path, role, text), and the styles below each path."""
    page = raw.decode("utf-8", "replace") if raw is not None else ""
    host = re.sub(r"^[^/]*://|[/?#].*$", "", url or "", flags=re.S).lower()
    blocks, below = parse(page)
    has = any(main and not noise for _, main, noise, _ in blocks)
    kept = [(path, ARTICLE if main else BESIDE if has else PLAIN, text) for path, main, noise, text in blocks if not noise]
    return host, _hash(host, page), kept, below


def _copy_key(kept: list[tuple[str, int, str]]) -> int:
    """The same for pages that say the same in their longest blocks, those that make up most of their text."""
    own = sorted({text for _, role, text in kept if role != BESIDE}, key=lambda t: (-len(t), t))
    need, said = TELLING * sum(map(len, own)), 0
    for k, text in enumerate(own):
        said += len(text)
        if said >= need:
            return _hash(*own[: k + 1])
    return 0


def _pages(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        urls = batch.column(1).to_pylist()
        yield batch, [_placed(url, raw.as_buffer().to_pybytes() if raw.is_valid else None) for url, raw in zip(urls, batch.column(2), strict=True)]


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, parent, content, copy): what stands in a node on a page; with parent null, how it is built."""
    for _, pages in _pages(batches):
        rows: dict[tuple, None] = {}
        for host, _, kept, below in pages:
            copy = _copy_key(kept)
            containers = set()
            for path, _, text in kept:
                parent = path.rpartition("/")[0]
                containers.add(parent)
                rows[_hash(host, path), _hash(host, parent), _hash(text), copy] = None
            for path in containers:
                rows[_hash(host, path), None, _hash(*below.get(path, ())), copy] = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["node", "parent", "content", "copy"])


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, node, role) of each page's nodes."""
    for _, pages in _pages(batches):
        rows = {(page, _hash(host, path), role): None for host, page, kept, _ in pages for path, role, _ in kept}
        if rows:
            page, node, role = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(node, pa.int64()), pa.array(role, pa.int8())], names=["page", "node", "role"])


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, page, nodes and roles of its blocks, their texts)."""
    for batch, pages in _pages(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([page for _, page, _, _ in pages], pa.int64()),
             pa.array([[_hash(host, path) for path, _, _ in kept] for host, _, kept, _ in pages], pa.list_(pa.int64())),
             pa.array([[role for _, role, _ in kept] for _, _, kept, _ in pages], pa.list_(pa.int8())),
             pa.array([[text for _, _, text in kept] for _, _, kept, _ in pages], pa.list_(pa.string()))],
            names=["page_id", "url", "page", "nodes", "roles", "texts"],
        )


def style_tree(said: DataFrame) -> DataFrame:
    """(node, parent, importance): the entropy of what a node holds over pages, as a share of the largest.

    Near copies of a page count once, so that a page's text does not depend on their number. Each
    node is taken to hold one more content that has not been seen: few pages prove little, a node of
    one page has an importance of 1. Rows with a null parent tell how a container is built.
    """
    n = said.groupBy("node", "parent", "content", "copy").agg(F.lit(1)).groupBy("node", "parent", "content").agg(F.count("*").alias("n"))
    node = n.groupBy("node", "parent").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    most = F.log(F.col("all") + 1)
    return node.select("node", "parent", ((most - F.col("nlogn") / (F.col("all") + 1)) / most).alias("importance"))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text (blocks joined by line feeds, empty if none), n_chars of every page.

    Character references are decoded once, white space within a block becomes one space. A null
    page is empty; a null url has an empty host, and its pages count as one site. Rows are kept one
    by one, with null or repeated ids too; equal pages have equal texts. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    given = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("binary").alias("html"))
    tree = store(style_tree(given.mapInArrow(_said, "node bigint, parent bigint, content bigint, copy bigint")), "tree")
    built = tree.where("parent is null").select(F.col("node").alias("parent"), F.col("importance").alias("built"))
    priors = F.explode(F.create_map(*(F.lit(x) for k, v in PRIOR.items() if k != NOISE for x in (k, v)))).alias("role", "prior")
    highest = least / (min(v for v in PRIOR.values() if v) * (1 - PRESENTATION))
    worth = F.col("importance") * F.col("prior") * (1 - PRESENTATION + 2 * PRESENTATION * F.col("built"))
    open_ = tree.where(F.col("parent").isNotNull() & (F.col("importance") < highest)).join(built, "parent")
    # Stored, so that Spark knows whether the list is small.
    cut = store(open_.select("node", "importance", "built", priors).where(worth < least).select("node", F.col("role").cast("tinyint")), "cut")
    of_page = given.mapInArrow(_nodes_of, "page bigint, node bigint, role tinyint").join(spread(cut), ["node", "role"])
    gone = store(of_page.groupBy("page").agg(F.collect_set(F.struct("node", "role")).alias("gone")), "gone")
    texts = given.mapInArrow(_texts_of, "page_id bigint, url string, page bigint, nodes array<bigint>, roles array<tinyint>, texts array<string>")
    blocks = F.arrays_zip("nodes", "roles", "texts")
    stays = lambda b: F.col("gone").isNull() | ~F.array_contains("gone", F.struct(b["nodes"].alias("node"), b["roles"].alias("role")))
    text = F.array_join(F.transform(F.filter(blocks, stays), lambda b: b["texts"]), "\n")
    out = texts.join(gone, "page", "left").select("page_id", "url", text.alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
