"""Main text of HTML pages by tree scoring.

A page becomes a tree in one scan over its tags. Each paragraph earns points for
its length and its commas and passes them to its ancestors, less with distance;
an element's points are discounted by its link density. The element with most
points is the container of the article: it and those of its siblings that also
carry text are kept, less what is no text of the article by its tag or name. A name is a
whole class, id or role that has only words of :data:`NOTES` and :data:`JOINTS`; other
attributes and parts of other names say nothing. Lists of links go only where the page
names no article or main element, and only where no text of their container leads to them.
Inside an article the whole names of reader comments, side bars, notices, adverts, sign-ups
(:data:`CERTAIN`, :data:`FURNITURE`) drop a container whatever it holds; the
others are weighed against its text. Of elements with equal points the first counts.
Where the page names no article or main element, siblings are judged by their own
text blocks too, and headings stay with the kept text that follows them.

One pass over the pages, row by row, no shuffle; memory is one page's tree.
Scanning is linear: open elements are counted by name, so that no end tag ever
searches for a partner that is not there.

Defined results: null, empty and text-free pages give an empty text; broken
markup is closed where a browser would close it; a truncated tag or comment at
the end is dropped; very long pages are read whole, in time and memory proportional to
their length; repeated rows are treated alike; extra columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+)))?")
#: Elements whose content is no markup.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr label picture".split())
#: Elements that never hold text of an article.
DROPPED = frozenset("nav footer aside form button select option input script style noscript textarea iframe object svg canvas template dialog menu head title datalist audio video map fieldset".split())
#: Words in class, id and role names that mark such elements.
NOTES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert comment comments commentlist reply replies respond discussion disqus sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search popup modal overlay widget widgets tags tools skip".split()
)
#: What such a word is joined with: a name of which another word is left, share-prices
#: or related-work, is no such name.
JOINTS = frozenset(
    "area bar bars block body bottom box btn button buttons card cards center col column container content count cta dialog fixed form global group icon icons inner item items js left line link links list lists main message "
    "mobile module native outer page panel post posts primary right row rows secondary section site slot sticky stories tab text title top unit units view wrap wrapper zone article articles story entry feed media label prompt policy rail strip side us up this follow thread".split()
)
#: Roles and names of a page's header, which inside an article is its own.
HEADERS = frozenset(["header", "banner"])
HOMES = frozenset(["article", "main"])
#: Names that no part of an article has: as a class, role or id they drop a container also inside one.
CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promotions cookie cookies gdpr disqus commentlist "
    "comment comments reply replies respond sidebar notice notices newsletter subscribe subscription signup".split()
)
#: Names that do so as a class or role; as an id they may be a section's own subject.
FURNITURE = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations widget widgets popup modal overlay login toolbar footer masthead alert banner".split())
NEAR = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset(".!?:…。！？")
TITLES = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LEVELS = 6


class Node:
    __slots__ = ("begin", "dropped", "home", "inline", "link", "links", "main", "named", "parent", "points", "prose", "size", "tag", "under")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, inline: bool, home: bool, link: bool):
        self.tag, self.parent, self.dropped, self.inline, self.home, self.link = tag, parent, dropped, inline, home, link
        self.points, self.size, self.links, self.prose, self.main = 0.0, 0, 0, 0, False
        self.named, self.begin = False, 0
        self.under = parent if parent is None or not parent.inline else parent.under


def _named(tag: str, attributes: str, home: bool) -> tuple[bool, bool, bool]:
    """(dropped, main, to be weighed) by what the attributes say. Inside an article
    names are weighed against the text of a container, and say nothing of inline
    elements; ids of headings, paragraphs and inline elements say nothing anywhere."""
    main = weighed = False
    small = tag in TITLES or tag in INLINE or tag == "p"
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, raw = name.lower(), next((v for v in values if v), "")
        value = raw.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
        if name == "itemprop" and value == "articlebody" or name == "role" and value in HOMES:
            main = True
        elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and not (small and (name == "id" or home and tag != "p")):
            for word in raw.split():
                pieces = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if x]
                if not pieces or pieces[0] in ("has", "with", "no", "without", "is"):
                    continue
                known = {x for x in pieces if x in NOTES or x in HEADERS}
                if not known or any(x not in known and x not in JOINTS and not x.isdigit() for x in pieces):
                    continue
                if known - HEADERS or not home:
                    if not home or known & CERTAIN or name != "id" and known & FURNITURE:
                        return True, False, False
                    weighed = True
    return False, main, weighed


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(element, text, characters in links) of every block in page order, and all elements."""
    root = Node("", None, False, False, False, False)
    stack, nodes, found = [root], [root], []
    count: dict[str, int] = {}
    held: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        if not held:
            return
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            linked = sum(len(t) for t, link in held if link)
            whole = sum(len(t) for t, _ in held)
            found.append((owner, text, round(len(text) * linked / whole)))
        held.clear()

    def box() -> Node:
        top = stack[-1]
        return top.under if top.inline else top

    def pop() -> None:
        node = stack[-1]
        if not node.inline:
            flush(node)
        stack.pop()
        count[node.tag] -= 1

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at and not stack[-1].dropped:
            held.append((page[at:stop], stack[-1].link))
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if name is None:
            if at == tag.start():
                at += 1
            continue
        name = name.lower()
        if tag[1]:
            if name == "br" and not stack[-1].dropped:
                held.append((" ", False))
            elif count.get(name):
                while stack[-1].tag != name:
                    pop()
                pop()
            continue
        inline = name in INLINE
        if name in VOID:
            if name == "br":
                if not stack[-1].dropped:
                    held.append((" ", stack[-1].link))
            elif not inline:
                flush(box())
            continue
        if not inline:
            flush(box())
            if count.get("p"):  # a block ends an open paragraph
                depth = len(stack) - 1
                while stack[depth].inline:
                    depth -= 1
                if stack[depth].tag == "p":
                    while len(stack) > depth:
                        pop()
            for other in NEAR.get(name, ()):
                if count.get(other):
                    depth = len(stack) - 1
                    while depth and (stack[depth].inline or stack[depth].tag not in (other, "ul", "ol", "dl", "table", "div", "section", "article")):
                        depth -= 1
                    if stack[depth].tag == other:
                        while len(stack) > depth:
                            pop()
        parent = stack[-1]
        home = parent.home or name in HOMES
        dropped = parent.dropped or name in DROPPED or name == "header" and not parent.home
        main = weighed = False
        if not dropped and tag[3]:
            dropped, main, weighed = _named(name, tag[3], parent.home)
        if tag[3].endswith("/") and name not in ("a", "p", "div", "span"):  # svg and the like
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        node = Node(name, parent, dropped, inline, home or main, parent.link or name == "a")
        node.main, node.named, node.begin = main or name in HOMES, weighed, len(found)
        stack.append(node)
        count[name] = count.get(name, 0) + 1
        if not inline:
            nodes.append(node)
    flush(box())
    return found, nodes


def _led_to(node: Node, found: list[tuple[Node, str, int]], inside: dict[Node, bool]) -> bool:
    """Whether a kept text block of the same parent stands right before a list, as
    before the sources of an article, and that parent holds running text."""
    if not node.begin or node.under is None or not node.under.prose:
        return False
    owner, text, linked = found[node.begin - 1]
    return owner.under is node.under and inside.get(owner, False) and linked <= 0.25 * len(text)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, nodes = blocks(page)
    if not found:
        return ""
    for owner, text, linked in found:
        owner.size += len(text)
        owner.links += linked
        if linked <= 0.25 * len(text) and (len(text) >= 80 or text.rstrip("\"'”’»)")[-1:] in STOPS):
            owner.prose += len(text)
        points = 1 + text.count(",") + text.count("、") + min(len(text) // 100, 3)
        points *= min(1.0, len(text) / 25) * (1 - linked / max(len(text), 1))
        up = owner.under if owner.tag in ("p", "pre", "td", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") and owner.under else owner
        for level in range(LEVELS):
            up.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up = up.under
            if up is None:
                break
    for node in reversed(nodes):
        if node.under is not None:
            node.under.size += node.size
            node.under.links += node.links
            node.under.prose += node.prose
    for node in nodes:
        node.points *= 1 - node.links / max(node.size, 1)
    best = max(nodes, key=lambda n: n.points)
    home, up = best, best
    while up is not None:  # the article around it, the nearest or else the page's main element
        if up.main:
            home = up
            if up.tag == "article":
                break
        up = up.under
    kept = {home}
    if home.under is not None and home.under.tag not in ("", "html"):
        for node in nodes:
            if node.under is home.under and node is not home and node.points >= max(0.2 * best.points, 1e-9):
                kept.add(node)
    if not home.main and home.under is not None and home.under.tag != "html":
        follows = False
        for node in reversed([n for n in nodes if n.under is home.under and not n.dropped and n.size]):
            if node.tag in TITLES:
                if follows and node.links <= 0.25 * node.size:
                    kept.add(node)
            elif 2 * node.prose >= node.size:
                kept.add(node)
            follows = node in kept
    inside: dict[Node, bool] = {}
    for node in nodes:  # parents come first
        inside[node] = node in kept or node.under is not None and inside[node.under]
        crowd = not home.main and node.tag in ("ul", "ol", "dl", "table") and node.size and node.links > 0.5 * node.size and not _led_to(node, found, inside)
        # a name of the page's furniture holds unless most of the element is running text
        if (crowd or node.named and 2 * node.prose < node.size) and node not in kept:
            inside[node] = False
    out = [text for owner, text, _ in found if inside[owner]]
    return "\n\n".join(out or [text for _, text, _ in found])


def extract(pages: DataFrame, source: str = "html", target: str = "text") -> DataFrame:
    """Adds the column ``target``, or replaces it; ``source`` must be a string."""
    kept = [c for c in pages.columns if c != target]
    at = kept.index(source)
    schema = pages.select(kept).schema.add(target, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, target])

    return pages.select(kept).mapInArrow(lean(run), schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
