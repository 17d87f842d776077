"""Main text of web pages by a site style tree: one merged tree per host, entropy per node, low branches cut."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import masked, spare
from augury.session import cut_lineage

# Elements of HTML that break the flow of text, that hold no text, and that end by themselves.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
            "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNREAD = set("script style noscript template textarea title iframe svg math select object canvas audio video button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# What elements, roles and names of classes and ids say about the place of a branch in a page.
ASIDE_TAGS = set("nav footer aside form menu dialog".split())
MAIN_TAGS = set("article main".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog".split())
ASIDE_NAMES = set("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
                  "footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                  "subscription signup login share sharing social related recommended widget toolbar masthead pagination pager form search".split())
HEAD_NAMES = set("header banner top topbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_KEYS: dict = {}


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), 7) - 2**63


class Node:
    """An open element: where it hangs in the site's tree, what its own marks say of it (-1 aside, 1 main, 0 open), and the
    paths that lead to it: all (above), and those that the tree judges (judged): inside a marked article only what lies under it."""
    __slots__ = ("tag", "path", "prior", "style", "above", "judged")

    def __init__(self, tag: str, path: int, prior: int, above: tuple, judged: tuple):
        self.tag, self.path, self.prior, self.style, self.above, self.judged = tag, path, prior, [], above, judged


def _place(parent: Node, tag: str, attrs: str) -> Node:
    key = (parent.path, parent.prior, tag, attrs)
    if key not in _KEYS:
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        marks = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)}
        names = [re.sub(r"\d+", "", x) for x in re.split(r"[^a-z0-9]+", f"{marks.get('class', '')} {marks.get('id', '')}".lower()) if x]
        inside = parent.prior == 1
        off = (tag in ASIDE_TAGS or marks.get("role", "").lower() in ASIDE_ROLES or not ASIDE_NAMES.isdisjoint(names) or "hidden" in marks
               or marks.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", marks.get("style", ""), re.I)
               or (not inside and (tag == "header" or not HEAD_NAMES.isdisjoint(names)))) and tag not in ("html", "body") and tag not in MAIN_TAGS
        prior = -1 if parent.prior == -1 or off else 1 if inside or tag in MAIN_TAGS or marks.get("role", "").lower() == "main" else 0
        _KEYS[key] = (_hash(parent.path, tag, *names), prior)
    path, prior = _KEYS[key]
    judged = () if prior == 1 and parent.prior != 1 else (*parent.judged, path)
    return Node(tag, path, prior, (*parent.above, path), judged)


def walk(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The page's text blocks in order with their elements, and all block elements. Character references are decoded,
    white space becomes one space, empty blocks vanish; markup cut off at the end of the page is no text."""
    root = Node("", 0, 0, (), ())
    stack, nodes, blocks, text, at, end = [root], [root], [], [], 0, len(page)

    def flush():
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                blocks.append((stack[-1], words))
            text.clear()

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in UNREAD and not closing and not m[3].rstrip(">").endswith("/"):
            shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            else:
                ends = _CLOSES.get(tag, ())
                while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in ends):
                    stack.pop()
                if tag in ("html", "body") and any(x.tag == tag for x in stack):
                    continue
                node = _place(stack[-1], tag, m[3])
                stack[-1].style.append(node.path)
                nodes.append(node)
                if tag not in VOID:
                    stack.append(node)
        elif tag == "head" and not closing:
            shut = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
            at = end if not shut else shut.start() if shut[0][:2] != "</" else shut.end()
    flush()
    return blocks, nodes


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and path: how its elements are built (style) and what stands in their branches (content)."""
    for batch in batches:
        out = [[], [], [], [], []]
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            blocks, nodes = walk(page or "")
            style, content = {}, {}
            for n in nodes[1:]:
                if n.prior >= 0:
                    style.setdefault(n.path, []).append(n.style)
            for n, words in blocks:
                for path in n.above:
                    if path in style:
                        content.setdefault(path, []).append(words)
            key = _hash(page)
            for path, s in style.items():
                for col, v in zip(out, (host, path, key, _hash(s), _hash(*content.get(path, ())))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["host", "path", "page", "style", "content"])


def _entropy(rows: DataFrame, sig: str, name: str) -> DataFrame:
    """Entropy of ``sig`` over the pages that have a node, to base of their number: 0 if all agree, 1 if none do."""
    n = rows.groupBy("host", "path", sig).agg(F.count(F.lit(1)).alias("n"))
    e = n.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("x"))
    return e.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("x") / F.col("m") / F.log("m")).otherwise(1.0).alias(name))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", gamma: float = 0.9) -> DataFrame:
    """The merged trees: ``host`` (hash), ``path`` (hash), ``m`` distinct pages and ``importance`` of every open node.

    Presentation importance is the entropy of how the node's children are laid out, content importance that of the text
    in its branch; the composite weighs content by ``gamma``. Copies of a page count once. Nodes that their own marks set
    aside (navigation, adverts, ...) need no statistics and are not listed; those of a marked article are.
    """
    src = pages.select(_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = src.mapInArrow(_tree_rows, "host long, path long, page long, style long, content long")
    rows = cut_lineage(rows.groupBy("host", "path", "page").agg(F.min("style").alias("style"), F.min("content").alias("content")))
    both = _entropy(rows, "style", "shown").join(_entropy(rows, "content", "said").drop("m"), ["host", "path"])
    return both.withColumn("importance", (1 - gamma) * F.col("shown") + gamma * F.col("said"))


def _host(url: Column) -> Column:
    return F.xxhash64(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def _main_text(page: str, low: set[int]) -> str:
    blocks, nodes = walk(page)
    main = any(n.prior == 1 for n in nodes)
    keep = (words for n, words in blocks if n.prior == main and low.isdisjoint(n.judged))
    return "\n".join(keep)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = 0.3, least_pages: int = 5, gamma: float = 0.9, slices: int = 1000) -> DataFrame:
    """``pages`` with ``__text``, the main text of each page, as the last column (``__text_`` where ``pages`` has one so called).

    A branch goes if its marks set it aside, or if its node in the site's tree has an importance under ``least`` on
    ``least_pages`` distinct pages or more; a page with a marked article keeps that only, without the low branches inside
    it. The blocks that stay are joined by one line break. Null and empty pages give an empty text; null addresses form one site; repeated pages
    count once in the tree and are extracted each; an empty table gives no rows; other columns keep names and values.

    Page statistics combine in the map tasks. A site's low nodes meet its pages in a join on the site, for which a site
    with more than 1 / ``slices`` of all pages is dealt into copies of at most that many; there are fewer such sites
    than ``slices``, so their table is broadcast.
    """
    low = style_tree(pages, url_col, html_col, gamma).where((F.col("importance") < least) & (F.col("m") >= least_pages))
    low = low.groupBy("host").agg(F.collect_list("path").alias("__low")).withColumnRenamed("host", "__site")
    sites = pages.groupBy(_host(F.col(url_col)).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = sites.agg(F.sum("__n").alias("__all"))
    hot = sites.crossJoin(F.broadcast(total)).select("__hot", F.ceil(F.col("__n") * slices / F.col("__all")).cast("int").alias("__copies")).where("__copies > 1")
    hot = F.broadcast(cut_lineage(hot))
    copies = F.coalesce("__copies", F.lit(1))
    low = low.join(hot, F.col("__site") == F.col("__hot"), "left").select("__site", "__low", F.explode(F.sequence(F.lit(0), copies - 1)).alias("__copy"))
    d, names = masked(pages)
    placed = d.withColumn("__host", _host(F.col(names[url_col]))).join(hot, F.col("__host") == F.col("__hot"), "left")
    placed = placed.withColumn("__at", F.pmod(F.xxhash64(*[d[c] for c, kind in d.dtypes if "map<" not in kind]), copies).cast("int"))
    joined = placed.join(low, (F.col("__host") == F.col("__site")) & (F.col("__at") == F.col("__copy")), "left")

    @F.arrow_udf("string")
    def text(html_: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([_main_text(h or "", set(p or ())) for h, p in zip(html_.to_pylist(), paths.to_pylist())], pa.string())

    return joined.select(*[F.col(names[c]).alias(c) for c in pages.columns], text(F.col(names[html_col]), F.col("__low")).alias(spare(pages, "__text")[0]))
