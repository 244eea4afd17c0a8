"""Main-text extraction by tree scoring.

Every paragraph passes points for its length and its commas to its ancestors, fewer the farther up
and fewer the more of its text is links. The ancestor with the most points, discounted by its own
link density, or the article element around it, is the container; siblings with enough points are
kept with it, other articles included. What the markup itself calls a menu, footer, sidebar, advert,
notice, form or comment is left out; inside an article only what it calls nothing else.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, table, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[a-z]+")
#: Element classes of HTML. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption body html".split())
ENDED_BY_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
                 "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
SCOPES = frozenset("html body article main section div ul ol dl table td th blockquote form aside nav header footer figure".split())
#: What is never the article: by element, by role, and by a word of the class or id. Fixed values.
JUNK_TAGS = frozenset("head script style noscript template iframe object embed svg canvas nav aside footer form button select textarea "
                      "dialog menu title datalist xmp noembed noframes".split())
JUNK_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
JUNK_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sidebar menu menus nav navbar navigation breadcrumb "
                       "breadcrumbs footer masthead comment comments commentlist disqus respond replies cookie cookies consent gdpr notice "
                       "notices notification alert popup modal overlay newsletter subscribe subscription signup promo promotion sponsor "
                       "sponsored related recommended recommendations share sharing social widget toolbar pagination pager login "
                       "search skip paywall outbrain taboola disclaimer legal copyright adsbygoogle discussion reactions".split())
#: A class or id of these words is a page header, unless a word of the second set says whose it is. Fixed values.
HEADER_WORDS = frozenset("header topbar".split())
ARTICLE_WORDS = frozenset("article post entry story content main page title section".split())
WHOLE = frozenset("html body article main".split())
ARTICLES = frozenset("article main".split())
#: Paragraphs and headings, whose class counts for adverts only; words that say of a class how it looks. Fixed values.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored".split())
LAYOUT_WORDS = frozenset("area article bar block bottom box button buttons container entry form icon icons inner item items left link links list "
                         "outer panel post right section top wrap wrapper".split())
ENDABLE = frozenset(t for tags in ENDED_BY_SAME.values() for t in tags.split()) | {"p"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "block", "inside", "parts", "chars", "linked", "score", "junk", "holds")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        #: the nearest block around the node, and whether an article is
        self.block = None if parent is None else parent if parent.parent is None or parent.tag in BLOCKS else parent.block
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLES)
        self.parts: list = []
        self.chars = self.linked = 0
        self.score = 0.0
        self.junk = self.holds = False


class OpenElements:
    """The elements that are open, innermost last, and where those of each tag, those that bound a
    search and those that another tag may end lie, so that no search walks through inline elements."""

    def __init__(self, root: Node):
        self.stack, self.marks, self.scopes = [root], [], []
        self.by_tag: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.by_tag.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag in SCOPES or tag in ENDABLE:
            self.marks.append(at)

    def close_from(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.by_tag[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag in SCOPES or tag in ENDABLE:
                self.marks.pop()

    def end_tag(self, tag: str) -> None:
        found = self.by_tag.get(tag)
        # an end tag of an inline element does not close the blocks around it
        if found and (tag in BLOCKS or not self.scopes or found[-1] > self.scopes[-1]):
            self.close_from(found[-1])

    def end_before(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: paragraphs, and items or cells of its kind."""
        if not (tag in CLOSES_P and self.by_tag.get("p") or tag in ENDED_BY_SAME):
            return
        ended = ENDED_BY_SAME.get(tag, "p").split()
        if tag in CLOSES_P:
            ended.append("p")
        k = len(self.marks) - 1
        while k >= 0:
            at = self.marks[k]
            if self.stack[at].tag in ended:
                self.close_from(at)
                k = len(self.marks)
            elif self.stack[at].tag in SCOPES:
                break
            k -= 1


def parse(page: str) -> list[Node]:
    """The nodes of a page in document order, the root first; tolerant of unclosed and stray tags."""
    root = Node("#root", "", None)
    nodes, opened, at, n = [root], OpenElements(root), 0, len(page)
    while at < n:
        top = opened.stack[-1]
        m = MARKUP.search(page, at)
        if m is None:
            top.parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            top.parts.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            if not m[1]:
                opened.end_before(tag)
            opened.stack[-1].parts.append(" ")
            continue
        if m[1]:
            opened.end_tag(tag)
            continue
        opened.end_before(tag)
        top = opened.stack[-1]
        node = Node(tag, m[3], top)
        top.parts.append(node)
        nodes.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        opened.push(node)
    return nodes


def _is_furniture(names: str) -> bool:
    """Whether one of the names of a class or id says nothing but that the element is none of the article."""
    words = (frozenset(TOKEN.findall(name)) for name in names.split())
    return any(w & JUNK_WORDS and w <= JUNK_WORDS | LAYOUT_WORDS for w in words)


def is_junk(node: Node) -> bool:
    """Whether the markup itself says that the node is not part of the article.

    Inside an article, and of an article itself, a class or id counts only if one of its names has
    no other meaning (``advert-box``, not ``legal-analysis``); that of a paragraph or heading counts
    only for adverts.
    """
    if node.tag in JUNK_TAGS:
        return True
    if node.tag == "header" and not node.inside:
        return True
    if not node.attrs or node.tag in WHOLE and node.tag != "article":
        return False
    for name, value in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            words = frozenset(TOKEN.findall(value))
            if node.tag in TEXT_TAGS:
                if words & AD_WORDS and _is_furniture(value):
                    return True
            elif node.inside or node.tag == "article":
                if words & JUNK_WORDS and _is_furniture(value):
                    return True
            elif words & JUNK_WORDS or words & HEADER_WORDS and not words & ARTICLE_WORDS:
                return True
        if node.tag == "article":
            continue
        if name == "role" and value in JUNK_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _measure(nodes: list[Node]) -> None:
    """Junk, text lengths and linked text lengths, bottom up."""
    for node in nodes:
        node.junk = node.parent is not None and (node.parent.junk or is_junk(node))
    articles = [x for x in nodes if x.tag in ARTICLES]
    if articles and all(x.junk for x in articles):
        # what the markup says would leave no article: it does not count around one
        for node in reversed(nodes):
            if node.parent is not None and (node.holds or node.tag in ARTICLES):
                node.parent.holds = True
        for node in nodes:
            node.junk = node.parent is not None and (node.parent.junk or node.tag == "head" or not (node.holds or node.tag in WHOLE) and is_junk(node))
    for node in reversed(nodes):
        if node.junk:
            continue
        node.chars += sum(len(p.strip()) for p in node.parts if type(p) is str)
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def link_density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _pass_points(nodes: list[Node]) -> None:
    for node in nodes:
        if node.junk or not node.chars:
            continue
        own = "".join(p for p in node.parts if type(p) is str)
        if node.tag in ("p", "pre", "td", "blockquote"):
            size, commas, at = node.chars, own.count(","), node.block
        elif node.tag in BLOCKS or node.tag == "#root":
            size = len(own.strip())
            if not size or node.tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd"):
                continue
            commas, at = own.count(","), node  # text of its own: a container that is its own paragraph
        else:
            continue
        points, level = (1 + commas + min(size / 100, 3)) * (1 - link_density(node)), 0
        while at is not None and level < 5:
            at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at, level = at.block, level + 1


def _container(nodes: list[Node]) -> Node | None:
    best, most = None, 0.0
    for node in nodes:
        if not node.junk and node.score * (1 - link_density(node)) > most:
            best, most = node, node.score * (1 - link_density(node))
    if best is None:
        held = [x for x in nodes if not x.junk and x.chars and x.tag in ("article", "main", "body", "#root")]
        return max(held, key=lambda x: (x.tag in ARTICLES, -x.linked, x.chars), default=None)
    at = best
    while at is not None:  # a section of an article stands for the article
        if at.tag in ARTICLES:
            return at
        at = at.parent
    return best


def _kept(best: Node) -> list[Node]:
    """The container and those siblings that look like it, in page order."""
    if best.parent is None or best.tag in ("main", "body"):
        return [best]
    least = max(2.0, 0.2 * best.score)
    return [x for x in best.parent.parts if type(x) is Node and not x.junk and (
        x is best or x.score * (1 - link_density(x)) >= least or x.tag == "p" and x.chars > 80 and link_density(x) < 0.25)]


def _is_menu(node: Node) -> bool:
    return not node.inside and node.tag in ("ul", "ol", "dl") and link_density(node) > 0.66 and node.linked > 0


def blocks_of(kept: list[Node]) -> list[str]:
    """The texts of the blocks in page order; white space inside a block is one space."""
    blocks, run = [], []

    def end_block() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    work: list = list(reversed(kept))
    while work:
        part = work.pop()
        if part is None:
            end_block()
        elif type(part) is str:
            run.append(part)
        elif not part.junk and not _is_menu(part):
            if part.tag in BLOCKS:
                end_block()
                work.append(None)
            work.extend(reversed(part.parts))
    end_block()
    return blocks


def main_text(page: str) -> str:
    nodes = parse(page)
    _measure(nodes)
    _pass_points(nodes)
    best = _container(nodes)
    return "\n".join(blocks_of(_kept(best))) if best is not None else ""


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                               pa.array([len(t) for t in texts], pa.int64())], schema=TEXTS)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page, one row per input row, repeated rows included.

    A page without main text, an empty or a null page gives the empty text and 0; null ids and URLs
    are kept; an empty table gives no rows. Unclosed, stray and cut-off markup is tolerated.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(_extract, ddl(TEXTS))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
