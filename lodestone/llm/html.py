"""Main-text extraction by composite text density.

A tolerant tokenizer builds a DOM; for every node the characters per tag, adjusted for the share of link
text, give its density. The densities of a node's child blocks are summed; the node of the largest sum is the
content, and the smallest density on its path to body is the threshold above which other parts of the
page count as content too: of each such part again its subtree of the largest sum. Boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) carries no density and no
text, but a wrapper called so by form, class, id or role is no boilerplate if the page's content is in it.

Null or empty html gives an empty text; unclosed tags, cut-off pages and bad references are read as far as they
go. Among equal sums the first in page order is taken; a page without blocks is its body. Equal pages give equal
texts, row by row; an empty table gives none. All steps are linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the markup language: what holds raw text, what has no content, what starts a block.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}

#: What isn't main text: by element, by role, and by class or id as a whole.
DROP = set("head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas dialog menu title noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies widget toolbar pagination pager skip hidden".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "mark", "drop", "block", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", mark: int):
        self.tag, self.parent, self.mark, self.children = tag, parent, mark, []
        self.drop = mark > 0 or parent is not None and parent.drop
        self.block = tag in BLOCK
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


#: How sure a node is boilerplate: CALLED by form, class, id or role, which `spare` may take back, or FIRM.
CALLED, FIRM = 1, 2


def boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """CALLED, FIRM, or 0 if it isn't boilerplate."""
    if tag in DROP - {"form"} or tag == "header" and not in_article:
        return FIRM
    mark = CALLED if tag == "form" else 0
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return FIRM
            if name in ("class", "id") and not WORDS.isdisjoint(value.split()) or name == "role" and value in ROLES:
                mark = CALLED
    return mark


def parse(page: str) -> Node:
    root = Node("html", None, 0)
    here, at, n = root, 0, len(page)
    depth_article = 0
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<":
                here.children.append(text)
            elif text == "<":
                if page[at : at + 1].isalpha() or page[at : at + 1] in "/!?":  # a tag that never ends: the page is cut off here
                    end = page.find("<", at)
                    at = n if end < 0 else end
                else:
                    here.children.append(text)
            continue
        tag = tag.lower()
        if m.group(1):
            node = here
            while node is not None and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag doesn't close a block
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                walk = here
                while walk is not node.parent:
                    depth_article -= walk.tag in ("article", "main")
                    walk = walk.parent
                here = node.parent
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        if tag in CLOSES_P:
            node = here
            while node is not None and node.tag != "p" and (node.tag not in BLOCK):
                node = node.parent
            if node is not None and node.tag == "p" and node.parent is not None:
                here = node.parent
        for own in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)):
            if tag in own:
                node = here
                while node.parent is not None and node.tag not in own and node.tag not in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu", "div") and not (node.tag == "tr" and tag in ("td", "th")):
                    node = node.parent
                if node.tag in own and node.parent is not None:
                    here = node.parent
        node = Node(tag, here, boilerplate(tag, m.group(3), depth_article > 0))
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag not in DROP:
                node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m.group(3) or "").endswith("/") or tag not in VOID and tag in BLOCK:
            here = node
            depth_article += tag in ("article", "main")
    return root


def ordered(root: Node) -> list[Node]:
    """Every node, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def spare(nodes: list[Node], body: Node) -> None:
    """Takes marks back that would drop the content: of nodes around a main; and of those around an article or most of the body's text outside links, unless an article or main is left beside them."""
    if not any(n.mark == CALLED for n in nodes):
        return
    plain, mains, articles = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, False), dict.fromkeys(nodes, False)
    within: dict[Node, bool] = {}
    for node in nodes:  # parents first
        up = node.parent
        within[node] = up is not None and (within[up] or up.tag in ("article", "main"))
    for node in reversed(nodes):
        if node.mark == FIRM:
            continue
        for c in node.children:
            if isinstance(c, str):
                plain[node] += len(SPACE.sub(" ", c).strip())
            elif c.mark != FIRM:
                plain[node] += plain[c] if c.tag != "a" else 0
                mains[node] |= mains[c] or c.tag == "main"
                articles[node] |= articles[c] or c.tag == "article"

    def free(wrong) -> None:
        for node in nodes:
            if node.mark == CALLED and wrong(node):
                node.mark = 0
            node.drop = node.mark > 0 or node.parent is not None and node.parent.drop

    free(lambda n: mains[n])
    left = any(n.tag in ("article", "main") and not n.drop for n in nodes)
    free(lambda n: 2 * plain[n] > plain[body] and (not left or within[n]) or not left and articles[n])


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, link characters and tags of every node, then densities and the sums of their children's."""
    for node in reversed(nodes):
        if node.drop:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(SPACE.sub(" ", c).strip())
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.links += c.links
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    whole, whole_links = max(body.chars, 1), body.links
    for node in nodes:
        if node.drop or not node.chars:
            continue
        tags, links, link_tags = max(node.tags, 1), max(node.links, 1), max(node.link_tags, 1)
        plain = max(node.chars - node.links, 1)
        base = math.log(node.chars / plain * node.links + whole_links / whole * node.chars + math.e)
        node.density = node.chars / tags * (math.log(node.chars / links * tags / link_tags + 1e-9) / math.log(base) if base > 1.0000001 and math.log(base) > 1e-6 else math.log(node.chars / links * tags / link_tags + math.e))
        node.density = max(node.density, 0.0)
    # A paragraph's inline parts are no parts of the page: sums are over blocks, through what is inline around them.
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                node.total += c.density if c.block else c.total


def heaviest(top: Node) -> Node:
    """The node of the largest sum of child densities in a subtree; the first in page order among equals."""
    best = top
    for node in ordered(top):
        if not node.drop and node.total > best.total:
            best = node
    return best


def select(root: Node) -> list[Node]:
    """The content subtrees in page order: the heaviest node, and of each part that passes the threshold its heaviest one."""
    nodes = ordered(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    spare(nodes, body)
    measure(nodes, body)
    best = heaviest(body)
    if best is body or not best.total:
        return [body]
    path, threshold, node = {body}, min(best.density, body.density), best
    while node is not body:
        path.add(node)
        if node.density:
            threshold = min(threshold, node.density)
        node = node.parent
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if node is best:
            out.append(node)
        elif node in path:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
        elif node.block and node.density >= threshold:
            out.append(heaviest(node))
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def blocks(tops: list[Node]) -> list[str]:
    """The texts of the blocks in page order, references decoded, white space made one space."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part:
            text = SPACE.sub(" ", "".join(part)).strip()
            part.clear()
            if text:
                out.append(text)

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                part.append(entities.unescape(x))
            elif not x.drop:
                edge = x.tag in BLOCK
                if edge:
                    close()
                    todo.append(None)
                todo += reversed(x.children)
        close()
    return out


def extract_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    return " ".join(blocks(select(parse(page)))) if page else ""


def extract(html: Column) -> Column:
    """The main text of an html column. One narrow pass; null gives an empty text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(extract_text)

    return run(F.coalesce(html, F.lit("")))
