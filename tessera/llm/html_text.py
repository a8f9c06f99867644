"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fields, spared

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never shown as text, or is a control's.
UNSEEN = frozenset("head title script style noscript template iframe object embed svg canvas audio video button select textarea input label legend option datalist noembed noframes xmp".split())
#: Elements that say themselves that they hold a menu, header, footer, side column or notice.
LANDMARK = frozenset("nav menu header footer aside dialog".split())
#: Words of class, id and role by which a container may be a menu, notice, advert, side column or readers' comments; density decides.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related respond replies reply search share sharing sidebar sidebars sideblock social sponsor sponsored subscribe tabs toolbar topbar widget".split())
#: Elements that hold text of their own: a mark on them says nothing, and beside the main text they belong to it.
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT = HEADING | frozenset("p blockquote pre dl figure".split())
PLAIN = TEXT | frozenset("html body main article li dt dd tr td th tbody thead tfoot caption figcaption hr br summary optgroup".split())
#: Share of the greatest density sum that a subtree needs to count as main text too.
SHARE = 0.2
#: A start of these closes an open p; and each closes open elements of the set behind it, up to the parent given.
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "li", "dd", "dt"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"})}

TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)

class Node:
    __slots__ = ("tag", "parent", "items", "apart", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, apart: bool, doubtful: bool = False):
        self.tag, self.parent, self.apart, self.doubtful = tag, parent, apart, doubtful
        self.items: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def hidden(attrs: str) -> bool:
    return any(name.lower() == "hidden" or name.lower() == "aria-hidden" and value.strip("\"'").lower() == "true" for name, value in NAMED.findall(attrs))


def marked(attrs: str) -> bool:
    """Do class, id or role name something other than main text?"""
    return any(name.lower() in ("class", "id", "role") and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", value.strip("\"'").lower())) for name, value in NAMED.findall(attrs))


def parse(page: str) -> Node:
    """A forgiving tree: unclosed, crossed and cut-off elements, raw text elements, comments."""
    root = Node("#root", None, False)
    at, node, n = 0, root, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if not (tag := m[2] or m[5]):
            continue
        tag, attrs = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            up = node
            while up.parent is not None and up.tag != tag:
                if up.tag in ("td", "th", "table", "button") and tag not in BLOCK:
                    up = root  # an inline end tag does not close a cell
                    break
                up = up.parent
            if up.parent is not None:
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up.parent is not None and up.tag not in ("p", "button", "td", "th", "table"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            up = node
            last = None
            while up.parent is not None and up.tag not in stop:
                if up.tag in shut:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        apart = tag in UNSEEN or tag in LANDMARK or attrs != "" and tag not in ("body", "html") and hidden(attrs)
        child = Node(tag, node, apart, tag in ("form", "fieldset") or attrs != "" and tag in BLOCK and tag not in PLAIN and marked(attrs))
        node.items.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not attrs.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span", "em", "strong"):
            node = child
    return root


def measure(root: Node) -> list[Node]:
    """Counts of characters, tags and those in links of every node, parents first; nodes that stand apart count nothing."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.apart:
            order.append(x)
            x.chars = x.tags = x.link_chars = x.link_tags = 0
            stack += [y for y in x.items if type(y) is Node]
    for x in reversed(order):
        for y in x.items:
            if type(y) is Node:
                if not y.apart:
                    x.chars, x.tags, x.link_chars, x.link_tags = x.chars + y.chars, x.tags + y.tags + 1, x.link_chars + y.link_chars, x.link_tags + y.link_tags + (y.tag == "a")
            else:
                x.chars += len(" ".join(y.split()))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags
    return order


def densities(root: Node, order: list[Node]) -> None:
    """Composite text density: characters per tag, lowered where links hold the characters; and the sum over children."""
    ratio = root.link_chars / max(root.chars, 1)
    for x in reversed(order):
        if x.chars:
            tags, links, link_tags = max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            free = max(x.chars - x.link_chars, 1)
            base = math.log(x.chars / free * links + ratio * x.chars + math.e)  # over 1: links is 1 at least
            x.density = x.chars / tags * math.log(max(1.0, x.chars / links * tags / link_tags)) / math.log(base)
        x.total = sum(y.density for y in x.items if type(y) is Node and not y.apart) + (x.density if any(type(y) is str and y.strip() for y in x.items) else 0.0)


def measured(root: Node) -> list[Node]:
    order = measure(root)
    densities(root, order)
    return order


def settle(root: Node) -> None:
    """Doubtful nodes stand apart unless they hold the main text.

    The main text is the subtree of the greatest density sum outside doubtful nodes; inside them only
    if it has several blocks and what lies outside has less than a fifth of its sum, as where a form
    wraps the page.
    """
    order, doubt = measured(root), set()
    for x in order:
        if x.doubtful or x.parent is not None and id(x.parent) in doubt:
            doubt.add(id(x))
    if not doubt:
        return
    total = lambda x: x.total
    inner = [x for x in order if x.chars and x.tag not in ("#root", "html", "body")]
    parts = lambda x: sum(type(y) is Node and not y.apart and y.tag in BLOCK and y.chars > 0 for y in x.items)
    most, clean = max((x for x in inner if parts(x) > 1), key=total, default=None), max((x for x in inner if id(x) not in doubt), key=total, default=None)
    # What doubtful children add to a sum does not count for their parent.
    without = lambda x: x.total - sum(y.density for y in x.items if type(y) is Node and not y.apart and id(y) in doubt)
    x = most if clean is None or most is not None and without(clean) < SHARE * most.total else clean
    kept = set()
    while x is not None:
        kept.add(id(x))
        x = x.parent
    for x in order:
        x.apart = x.doubtful and id(x) not in kept


def chosen(root: Node) -> list[Node]:
    """The subtree of the greatest density sum, and the subtrees beside the path from it to body that belong to it.

    The least density on that path is the threshold. A subtree beside the path belongs to the main
    text if links hold less than half of its characters and it is a heading, or its density reaches
    the threshold and it is a paragraph or has a fifth of the greatest density sum itself.
    """
    order = measured(root)
    body = next((x for x in order if x.tag == "body"), root)
    inner = [x for x in order if x.chars and x is not body and x.tag not in ("#root", "html") and x.tag in BLOCK]
    own = any(type(y) is str and y.strip() or type(y) is Node and not y.apart and y.chars and (y.tag in TEXT or y.tag not in BLOCK) for y in body.items)
    best = max(inner if inner and not own else [*inner, body], key=lambda x: x.total)
    # A paragraph alone is main text with what stands around it.
    while best is not body and best.parent is not None and best.tag in PLAIN - {"main", "article", "td"}:
        best = best.parent
    path, x = [best], best
    while x is not body and x.parent is not None:
        x = x.parent
        path.append(x)
    limit = min(x.density for x in path)
    picked = {id(best)}
    for below, x in zip(path, path[1:]):
        for y in x.items:
            if type(y) is Node and y is not below and not y.apart and 2 * y.link_chars < y.chars:
                if y.tag in HEADING or y.density >= limit and (y.tag in TEXT or y.total >= SHARE * best.total):
                    picked.add(id(y))
    out, stack = [], [path[-1]]
    while stack:
        x = stack.pop()
        if id(x) in picked:
            out.append(x)
        else:
            stack += [y for y in reversed(x.items) if type(y) is Node and not y.apart]
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order, white space as one space."""
    out, now = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif type(x) is str:
                now.append(x)
            elif x.apart:
                now.append(" ") if x.tag in ("button", "label", "select", "input") else None
            elif x.tag == "br":
                now.append(" ")
            elif x.tag in BLOCK:
                end()
                stack.append(None)
                stack += reversed(x.items)
            else:
                stack += reversed(x.items)
        end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    settle(root)
    return "\n\n".join(blocks(chosen(root)))


def extract_pages(pages: DataFrame, *, html_col="html", keep=("page_id", "url")) -> DataFrame:
    """Adds text: blocks of the page's main text, joined by blank lines.

    Null, empty and text-free pages give an empty text. Pages are independent, so repeated rows give
    equal texts; columns other than ``keep`` are dropped, and so is one of those named text.
    """

    def run(batches):
        for b in batches:
            b["text"] = [main_text(x) for x in b.pop("html\0")]
            yield b

    keep = spared(keep, "text string")
    return pages.select(*keep, F.col(html_col).alias("html\0")).mapInPandas(run, fields(pages.select(*keep), "text string"))


def query(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


def oracle() -> str:
    """For pages whose main text is their only article element of headings, paragraphs and lists, with the references &amp; and &quot;."""
    return r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1), '</?(?:p|h1|ul|li|div)(?:\s[^>]*)?>') AS parts FROM pages),
t AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g')) AS parts FROM a),
d AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM t),
j AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j"""
