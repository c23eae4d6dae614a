"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks, less links, with hints from tags and
class names. The page votes for the generalised path of its best container (tags with their classes,
digits folded). Votes are added up per host in Spark; the host's winning paths, most votes first, are
then joined back and the text is extracted again from the container at the first winning path that
the page has. A page without any of them uses its own best container.

Votes are aggregated before they move, so a host that serves a third of all pages adds one row per
task and path. Winners are broadcast only after their rows are counted; past the bound they are
joined with hot hosts spread.
"""

from __future__ import annotations

import html as H
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm._spark import materialise, text_udf, with_small

#: Share of a host's votes from which on a path wins, and how many paths at most are tried. A rarer path is a stray
#: page's layout: such a page finds none of the winners, or not their text, and uses its own best container.
SHARE, PATHS = 0.05, 8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP_TAG = frozenset("nav header footer aside form button select option noscript iframe dialog menu template svg canvas object audio video figure label input head".split()) - {"figure"}
_BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address center fieldset details summary hr br nav header footer aside form hgroup".split()
)
_CONTAINER = frozenset("body article section main div td center table blockquote".split())
_CLOSES_P = _BLOCK - {"br"}
#: Names of what surrounds an article. A class or id is one of them if each of its parts is such a word or one of
#: `_NEUTRAL`: `cookie-notice` and `comment-list` are, `related-work` and `article-header` aren't.
_WORDS = re.compile(
    r"ads?|advert(?:s|ising|isements?)?|adverts?|banners?|sponsor(?:s|ed)?|promos?|promotions?|comments?|replies|reply|respond|disqus|sidebars?|widgets?|menus?|nav(?:s|bars?|igation)?|breadcrumbs?|footers?|header|masthead|topbar|cookies?|consent|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscribe|subscriptions?|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbars?|gdpr|skip|search|tags|aside"
)
_NEUTRAL = re.compile(r"site|page|main|global|top|bottom|left|right|primary|secondary|side|box|bar|list|lists|links?|form|forms|container|wrapper|wrap|inner|outer|block|section|area|items?|posts?|articles?|stories|content|body|text|buttons?|icons?|media|google|slot|unit|zone|panel|header|title|thread|author|count|col|column|row|nav|the|my|js|is|sticky|fixed|desktop|mobile|area|message|more|user|reader|readers|secondary|and|policy|v|\d+")
#: Names of an article's own element, whatever else it is called.
_OWN = frozenset("entry hentry post article story entry-content post-content article-content article-body post-body story-body main-content".split())
#: Parts of an article: their header is the article's.
_HEADED = frozenset("article post story entry content section block title".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_GOOD = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")


def surrounds(names: str) -> bool:
    """Whether a class attribute or id names something around an article."""
    some = names.split()
    if any(n.lower() in _OWN for n in some):
        return False
    for n in some:
        parts = [x.lower() for x in _PARTS.findall(n)]
        if "header" in parts and _HEADED.intersection(parts):
            continue
        if any(_WORDS.fullmatch(x) for x in parts) and all(_WORDS.fullmatch(x) or _NEUTRAL.fullmatch(x) for x in parts):
            return True
    return False


class _Node:
    __slots__ = ("tag", "path", "parent", "fixed", "named", "hint", "order", "dropped", "worth", "holds")

    def __init__(self, tag: str, path: str, parent, fixed: bool, named: bool, hint: int, order: int):
        self.tag, self.path, self.parent, self.fixed, self.named, self.hint, self.order = tag, path, parent, fixed, named, hint, order
        self.dropped, self.worth, self.holds = False, 0, False


#: Largest share of a page's unlinked text that an element may hold and still be dropped for its name.
MOST = 0.4


def _parse(page: str):
    """Containers of a page in order, and its blocks: (text as in the page, characters, of them in links, element)."""
    root = _Node("html", "", None, False, False, 0, 0)
    stack = [root]
    every, nodes, blocks = [root], [root], []
    text: list[str] = []
    linked = 0
    in_link = 0

    def flush():
        nonlocal text, linked
        if text:
            whole = "".join(text)
            if not whole.isspace():
                blocks.append((whole, len(whole), linked, stack[-1]))
        text, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m[2] else 1
        if tag not in _BLOCK and tag not in _DROP_TAG:
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _CONTAINER and tag not in _CONTAINER and tag not in _DROP_TAG:
                    break
            continue
        if tag in _CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in _VOID:
            continue
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            stack.pop()
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[4])} if "=" in m[4] else {}
        name = " ".join((found.get("class") or "").split())
        both = f"{name} {found.get('id') or ''}"
        parent = stack[-1]
        # an article's own header holds its headline
        fixed = tag in _DROP_TAG and not (tag == "header" and any(x.tag in ("article", "main") for x in stack))
        fixed |= (found.get("role") or "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        named = bool(both.strip()) and tag not in ("html", "body", "article", "main") and surrounds(both)
        path = f"{parent.path}/{tag}" + ("." + _DIGITS.sub("#", ".".join(sorted(name.split()))) if name else "")
        hint = (tag in ("article", "main")) + bool(both.strip() and _GOOD.search(both))
        node = _Node(tag, path, parent, fixed, named, hint, len(every))
        stack.append(node)
        every.append(node)
        if tag in _CONTAINER:
            nodes.append(node)
    text.append(page[at:])
    flush()

    # a name alone drops no element that holds an article, a headline or much of the page's text
    for _, size, linked, node in blocks:
        node.worth += size - linked
    for node in reversed(every[1:]):
        node.parent.worth += node.worth
        node.parent.holds |= node.holds or node.tag in ("article", "main", "h1")
    for node in every[1:]:
        node.dropped = node.parent.dropped or node.fixed or (node.named and not node.holds and node.worth <= MOST * root.worth)
    return nodes, [b for b in blocks if not b[3].dropped]


def _best(nodes, blocks) -> _Node | None:
    """Highest score: own text in full, deeper text at a discount for each container passed, links off, hints on; the first of equals."""
    score: dict[_Node, float] = {}
    for _, size, linked, node in blocks:
        worth = max(0.0, size - 2.0 * linked)
        while node is not None:
            if node.tag in _CONTAINER or node.parent is None:
                score[node] = score.get(node, 0.0) + worth
                worth *= 0.9
            node = node.parent
    if not score:
        return None
    return max(score, key=lambda n: (score[n] * (1 + 0.5 * n.hint), -n.order))


def _inside(node: _Node, top: _Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def best_path(page: str) -> tuple[str, int] | None:
    """Path of a page's best container and its number of characters."""
    nodes, blocks = _parse(page)
    best = _best(nodes, blocks)
    return best and (best.path, sum(b[1] for b in blocks if _inside(b[3], best)))


def _text(blocks) -> str:
    lines = (" ".join(H.unescape(b[0]).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str, paths: list[str]) -> str:
    """Blocks of the containers at the first winning path the page has, one a line."""
    nodes, blocks = _parse(page)
    for path in paths:
        tops = [n for n in nodes if n.path == path and not n.dropped]
        text = _text(b for b in blocks if any(_inside(b[3], t) for t in tops)) if tops else ""
        if text:
            return text
    best = _best(nodes, blocks)
    return _text(b for b in blocks if _inside(b[3], best)) if best else ""


def host(url) -> F.Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html", share: float = SHARE, most: int = PATHS) -> DataFrame:
    """Winning paths of each host, most votes first: columns _host, _paths."""

    def vote(column: pa.Array) -> pa.Array:
        best = (best_path(t) if t else None for t in column.to_pylist())
        return pa.array([b and b[0] for b in best], pa.string())

    votes = pages.select(host(url).alias("_host"), text_udf(pages.sparkSession, "string", vote)(F.col(html)).alias("path")).filter("path is not null").groupBy("_host", "path").agg(F.count("*").alias("n"))
    every = votes.groupBy("_host").agg(F.sum("n").alias("all"))
    strong = votes.join(every, "_host").filter(F.col("n") >= share * F.col("all"))  # at most 1 / share rows a host
    return strong.groupBy("_host").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]), 1, most).alias("_paths")
    )


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """One row per page: page_id, url and the main text (empty if none) in column `out`.

    Null and empty pages give an empty text. Pages without a host vote together. Of containers that score
    alike the first wins, of paths with equal votes the first in code point order. Rows that repeat a
    page_id are extracted and vote each. A very long page is held once per task; nothing of it is cut.
    Other columns are not looked at, whatever their names. An empty table gives an empty table.
    """
    winners = materialise(host_paths(pages, url, html))

    @F.arrow_udf("string")
    def cut(column: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([extract(t, p or []) if t else "" for t, p in zip(column.to_pylist(), paths.to_pylist())], pa.string())

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"), host(url).alias("_host"))
    rows = with_small(rows, winners, ["_host"], "left", salt="page_id")
    return rows.select("page_id", "url", cut("_html", "_paths").alias(out))
