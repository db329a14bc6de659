"""Main text of a web page by tree scoring.

Paragraph-like blocks earn points for length and commas; parents and grandparents take
them (in full, then half), discounted by the share of their text that lies in links. The
best container is kept with those of its siblings that score close to it or read like prose.

Inside what is kept only menus, headers, footers, sidebars, notices, adverts, forms, scripts and
readers' comments go, by element or by an unmistakable name. Names that prove nothing (related, tags,
legal, widget) halve the points, and their blocks go only where they hold links and no prose.

A form goes unless it is the page's wrapper: one that holds an article or most of the page's text stays. Parts that a name calls
search, menu or the like stay if they hold prose inside an article.

Null or empty pages give an empty text. Pages of any length and nesting are read whole, in time linear in their size; repeated rows
and ties (of containers with equal scores the first) are handled alike; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Fixed values of HTML: elements without an end tag, raw-text elements, blocks, and blocks that a p can't hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption dd dt head html legend li option optgroup tbody td tfoot th thead tr".split()) | frozenset(("p",))
#: An open element of the value ends where the key begins, unless a fence lies between.
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tr", "td", "th"), "body": ("head",),
}
FENCE = frozenset("table ul ol dl select body html article section div td th".split())
DROPPED = frozenset(
    "script style noscript template iframe object embed applet svg math canvas audio video map form button input select textarea option datalist "
    "nav aside footer header menu dialog head title search noembed noframes xmp".split()
)
#: Names in class, id or role of what surrounds an article. The first kind may stand anywhere in a name, the second ends it.
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|cookies?|consent|gdpr|popups?|modal|overlay|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|masthead|topbar|toolbar|"
    r"comments?|disqus|respond|replies|reply|newsletter|subscribe|subscription|signup|login|search|complementary|contentinfo|banner)(?:$|[\s_-]|\d)"
    r"|(?:notices?|alerts?|headers?|foot|aside|rail|banners?)(?:$|\s|\d))",
    re.I,
)
#: Names that often, but not always, mark the surroundings.
DOUBTFUL_NAME = re.compile(
    r"(?:^|[\s_-])(?:promo(?:tion|s)?|side|widgets?|discussion|social|share|sharing|related|recommend(?:ed|ations?)?|pagination|pager|tags|legal|copyright|disclaimer|skip)(?:$|[\s_-]|\d)",
    re.I,
)
PROSE_CHARS = 80
#: Names of what readers wrote, which may well be marked up as articles.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies|reply|discussion)(?:$|[\s_-]|\d)", re.I)
#: Names of parts that have a function on the page, but may also be what an article's own part is about.
FUNCTION_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menus?|breadcrumbs?|toolbar|topbar|masthead|search|login|signup|overlay|modal)(?:$|[\s_-]|\d)", re.I)
GOOD_NAME = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
SCORED = frozenset(("p", "pre", "td", "blockquote", "div", "li", "dd", "section", "article", "main", "h1", "h2", "h3"))
#: Whole lists and containers of at least three links that are shorter than this on average are menus.
LISTS = frozenset("ul ol dl div section table".split())
MENU_CHARS = 30
_BETWEEN = re.compile(r"[\s|·•»›]+")
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|))*)(?:>|$))", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"[\s\xa0]+")


class Node:
    __slots__ = ("tag", "parent", "children", "names", "score", "chars", "link_chars", "links", "solid", "longest", "last", "ends", "dropped", "by_name", "doubtful", "faint", "is_body", "in_article", "cleared")

    def __init__(self, tag: str, parent: Node | None, names: str = "", dropped: bool = False):
        self.tag, self.parent, self.names, self.dropped, self.by_name = tag, parent, names, dropped, False
        self.doubtful = bool(names) and DOUBTFUL_NAME.search(names) is not None
        self.faint = self.doubtful + (parent.faint if parent else 0)  # how many doubtful names it stands under
        self.children: list[Node | str] = []
        self.score, self.chars, self.link_chars, self.links, self.solid, self.longest = 0.0, 0, 0, 0, 0, 0
        self.last, self.ends = -1, False  # the number of its last text, and whether that closes a sentence
        self.is_body = tag in ("html", "body", "")
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.cleared = False


def _attributes(raw: str) -> tuple[str, bool]:
    """Names that describe an element, and whether it is hidden."""
    if not raw:
        return "", False
    names, hidden = [], False
    for m in _NAMES.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key in ("class", "id", "role"):
            names.append(value)
    return " ".join(names), hidden


def parse(page: str) -> tuple[Node, list[Node]]:
    """A forgiving tree and its nodes in page order: implied end tags, stray end tags skipped, raw-text elements left unread."""
    root = Node("", None)
    at, open_, nodes = 0, [root], [root]
    held: Counter = Counter()  # open elements by tag, so that nothing is looked for that is not there

    def close(k: int) -> None:
        for x in open_[k:]:
            held[x.tag] -= 1
        del open_[k:]

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            open_[-1].children.append(text)
        if not m:
            return root, nodes
        at = m.end()
        if m[0].startswith("<![CDATA["):
            open_[-1].children.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1) if held[tag] else ():
                if open_[k].tag == tag:
                    close(k)
                    break
                if open_[k].tag in FENCE and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P and held["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close(k)
                    break
                if open_[k].tag in FENCE or open_[k].tag in ("li", "button"):
                    break
        for k in range(len(open_) - 1, 0, -1) if tag in CLOSES and any(held[x] for x in CLOSES[tag]) else ():
            if open_[k].tag in CLOSES[tag]:
                close(k)
                break
            if open_[k].tag in FENCE and open_[k].tag not in ("td", "th"):
                break
        names, hidden = _attributes(m[3])
        if tag in ("article", "main"):
            above: Node | None = open_[-1]  # a wrapper called, say, with-sidebar is no sidebar, and a form around an article is a wrapper
            while above is not None and not above.cleared:
                above.cleared = True
                above.dropped = above.dropped and not (above.by_name and not READERS.search(above.names)) and above.tag != "form"
                above = above.parent
        remark = tag == "article" and bool(names) and bool(READERS.search(names)) and not GOOD_NAME.search(names)
        node = Node(tag, open_[-1], names, tag in DROPPED or hidden or remark)
        if names and not node.dropped and tag not in ("html", "body", "article", "main") and BAD_NAME.search(names):
            node.dropped = node.by_name = True
        open_[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                node.children.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(node)
            held[tag] += 1


def spare(nodes: list[Node]) -> None:
    """Take back what went too far: forms around most of the page's text, and named parts of an article that hold prose."""
    at = {id(n): k for k, n in enumerate(nodes)}
    mass, prose = [0] * len(nodes), [0] * len(nodes)
    linked = [False] * len(nodes)
    for k, n in enumerate(nodes):
        linked[k] = n.tag == "a" or n.parent is not None and linked[at[id(n.parent)]]
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if n.tag in RAW or n.dropped and not n.by_name and n.tag != "form":
            continue
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        mass[k] += own
        prose[k] = max(prose[k], 0 if linked[k] or n.tag in ("label", "legend", "button", "option") else own)
        if n.parent is not None:
            up = at[id(n.parent)]
            mass[up] += mass[k]
            # Inline elements lengthen their block's prose; a block has its own.
            prose[up] = max(prose[up], prose[k]) if n.tag in BLOCK else prose[up] + prose[k]
    for k, n in enumerate(nodes):
        if n.dropped and n.tag == "form" and 2 * mass[k] >= mass[0] and prose[k] >= PROSE_CHARS:
            n.dropped = False
        elif n.dropped and n.by_name and n.in_article and prose[k] >= PROSE_CHARS and (n.tag == "p" or FUNCTION_NAME.search(n.names) and not READERS.search(n.names)):
            n.dropped = False


def _blocks(node: Node) -> Iterator[tuple[Node, str, int, int]]:
    """(owner, text, characters in links, number of links) of each run of text between block edges, dropped parts left out."""
    run: list[str] = []
    links = [0, 0]

    def flush(owner: Node):
        text = _SPACE.sub(" ", "".join(run)).strip()
        n, k = links
        run.clear()
        links[:] = 0, 0
        if text:
            yield owner, text, n, k

    # Explicit stack: pages nest deeper than Python recurses.
    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, node.tag == "a")]
    while stack:
        here, i, owner, in_link = stack.pop()
        if i >= len(here.children):
            if here.tag in BLOCK or not stack:
                yield from flush(owner)
            continue
        stack.append((here, i + 1, owner, in_link))
        child = here.children[i]
        if isinstance(child, str):
            text = entities.unescape(child)
            run.append(text)
            if in_link:
                links[0] += len(text.strip())
        elif child.dropped:
            if child.tag in BLOCK:
                yield from flush(owner)
        elif child.tag in BLOCK:
            yield from flush(owner)
            stack.append((child, 0, child, in_link))
        elif child.tag == "br":
            run.append(" ")
        else:
            links[1] += child.tag == "a"
            stack.append((child, 0, owner, in_link or child.tag == "a"))


def extract(page: str) -> str:
    """The main text: its blocks in page order, joined by one space; empty if there is none."""
    root, nodes = parse(page)
    spare(nodes)
    blocks = list(_blocks(root))
    if not blocks:
        return ""
    touched: dict[int, Node] = {}
    for number, (owner, text, linked, links) in enumerate(blocks):
        points = 0.0
        if owner.tag in SCORED and len(text) >= 25:
            points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        points *= 0.5**owner.faint
        up, depth = owner.parent if owner.tag in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3") and owner.parent else owner, 0
        owner.longest = max(owner.longest, len(text) if 2 * linked < len(text) else 0)
        owner.last, owner.ends = number, text[-1] in ".!?:;…\"'”’»。！？"
        owner.chars += len(text)
        owner.link_chars += linked
        owner.links += links
        owner.solid += len(_BETWEEN.sub("", text))
        while up is not None and depth < 3:
            touched[id(up)] = up
            up.score += points / (1, 2, 4)[depth]
            up, depth = up.parent, depth + 1
    for n in reversed(nodes):  # sums of a part, from its own parts
        up = n.parent
        if up is not None and n.last >= 0:
            up.chars, up.link_chars, up.links, up.solid = up.chars + n.chars, up.link_chars + n.link_chars, up.links + n.links, up.solid + n.solid
            up.longest = max(up.longest, n.longest)
            if n.last > up.last:
                up.last, up.ends = n.last, n.ends

    def final(n: Node) -> float:
        bonus = 25 * (n.tag in ("article", "main")) + 5 * bool(n.names and GOOD_NAME.search(n.names)) - 10 * n.is_body
        return (n.score + bonus * (n.score > 0)) * (1 - n.link_chars / max(n.chars, 1))

    best = max(touched.values(), key=final)
    if final(best) <= 0:
        kept = [b for b in blocks if b[2] < 0.5 * len(b[1])]
        return " ".join(t for _, t, _, _ in kept)
    # A wrapper that holds little else is the same container; an article holds its sections.
    while best.parent is not None and not best.parent.is_body and (
        best.tag in ("p", "section", "blockquote", "div", "td", "tr", "tbody", "li", "ul", "ol", "dl", "table", "pre")
        and best.parent.tag in ("article", "main", "section", "div", "td", "tr", "tbody", "table") and
        (best.parent.tag in ("article", "main") or best.parent.chars <= 1.25 * best.chars)
    ):
        best = best.parent
    top, need = final(best), 0.2 * final(best)
    keep = {id(best)}
    for s in best.parent.children if best.parent is not None else ():
        if isinstance(s, Node) and s is not best and not s.dropped and s.chars:
            density = s.link_chars / s.chars
            if id(s) in touched and final(s) >= max(10, need) and density < 0.3:
                keep.add(id(s))
            elif s.tag in ("h1", "h2") and top and density == 0:
                keep.add(id(s))
            elif s.tag in ("p", "blockquote", "pre") and top and density < 0.25 and (s.chars > PROSE_CHARS or s.ends):
                keep.add(id(s))
    inside: dict[int, bool] = {}

    def held(n: Node | None) -> bool:
        trail = []
        while n is not None and id(n) not in inside and id(n) not in keep:
            trail.append(n)
            n = n.parent
        yes = n is not None and (id(n) in keep or inside[id(n)])
        inside.update((id(x), yes) for x in trail)
        return yes

    menus: dict[int, bool] = {}

    def in_menu(n: Node | None) -> bool:
        """Inside a whole list or container of short links and little else; the kept containers are none."""
        trail = []
        while n is not None and id(n) not in menus and id(n) not in keep:
            trail.append(n)
            n = n.parent
        yes = n is not None and menus.get(id(n), False)
        for x in reversed(trail):
            yes = menus[id(x)] = yes or x.tag in LISTS and x.links >= 3 and x.link_chars > 0.8 * x.solid and x.link_chars < MENU_CHARS * x.links
        return yes

    links_only: dict[int, bool] = {}

    def beside(n: Node | None) -> bool:
        """Inside a part of a doubtful name that holds links and no prose."""
        trail = []
        while n is not None and id(n) not in links_only and id(n) not in keep:
            trail.append(n)
            n = n.parent
        yes = n is not None and links_only.get(id(n), False)
        for x in reversed(trail):
            yes = links_only[id(x)] = yes or x.doubtful and x.longest < PROSE_CHARS and x.links > 0
        return yes

    return " ".join(t for o, t, _, _ in blocks if held(o) and not beside(o) and (o.tag == "p" or not in_menu(o)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html gives an empty text; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = [extract(h) if h else "" for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
