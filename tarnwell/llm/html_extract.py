"""HTML extraction by tag-path ratios.

Each text node of a page has the path of its open elements from the root. Text
length and punctuation are summed by path; a path's ratio of both to its nodes
is smoothed with those of the paths around it (the subtrees of its ancestors),
fused, and compared with a threshold; the nodes of the paths above it are the
content. So are text elements between them, or beside them under the same parent,
unless those beside are mostly links. Elements that hold no article text by their
tag, or by a whole name of their class, id or role, are left out beforehand, but not
one that holds nearly all of the page's text; where the name is one that builders of
pages give to parts of an article too, the ratio of its text decides. Paths are numbers in a tree, and all
sums are made in one pass, so that a page takes time in proportion to its length.

Defined results: a null or empty page, or one without content, gives ''; pages
are each extracted alone, so repeated rows give equal results; broken markup is
read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwell.llm.text import pick

#: Fixed tables of HTML's elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label object math semantics mrow mi mn mo ms mtext mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd".split())
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml select canvas title head".split())
OUTSIDE = frozenset("nav footer aside menu button dialog".split())
#: Elements that hold no article text unless they hold nearly all text.
DOUBTFUL = frozenset("header form".split())
#: An element that opens one of these ends an open one of those.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Elements whose blocks follow content beside them, and those that hold such blocks within the parent.
FOLLOWS = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption summary".split())
HOLDERS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th blockquote figure details".split())
SCOPE = ("ul", "ol", "dl", "table", "article", "section", "main", "div", "body")
#: Words in names of what is no article text, in the languages of the tables.
STRONG = re.compile(
    r"(?:ads?|adsby\w*|advert\w*|adbox|adslot|adunit|sponsor(?:s|ed)?|nav|navbar|navi|topnav|subnav|navlinks|menus?|menubar|breadcrumbs?|sidebars?|footer|header|masthead|topbar|"
    r"cookies?|consent|gdpr|popup|newsletters?|subscribe|signup|comment(?:s|ers?|list|form|area|box|section|thread)?|reply|replies|disqus|sharing|recommend(?:ed|ations?)?|pagination|pager|toolbar|login|"
    r"complementary|navigation|contentinfo|"
    r"kommentare?|werbung|anzeigen?|menue|menü|fu(?:ß|ss)zeile|kopfzeile|seitenleiste|commentaires?|publicit[eé]|comentarios?|publicidad|anuncios?|barralateral|menú)"
)
#: Words of names that builders of pages also give to parts of an article: such an element is left out unless its text is like the content's.
DOUBTED = re.compile(r"(?:promos?|promotions?|promoted|banners?|widgets?|modal|overlay|skip)")
#: Words that say so alone, or with one that names a part of a page; in an article's own names they may say what it is about.
WEAK = frozenset("notice notices disclaimer discussion feedback share social related search alert side".split())
PARTS = frozenset("bar box links list button buttons widget block area container wrap wrapper icons posts articles stories form panel tools site top bottom page global left right column".split())
#: Words by which a name tells how a page is laid out, and whose headers belong to the article.
STATES = frozenset("no not has have with without is hide hidden show use enable enabled disable disabled open closed".split())
OWN = frozenset("post entry article story content main title section chapter".split())
#: Text is like the content's if its ratio is one part in so many of the best path's.
LIKE = 4
#: An element that is left out by its name goes back if all that is left without it is less than one part of its text in so many.
GUARD = 10
SPECIAL = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
VALUES = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])|[^\W_]+")
PUNCTUATION = re.compile(r"[.,;:!?。，、！？…]")
BLANK = re.compile(r"\s+")


def names_outside(name: str) -> int:
    """Whether one name of a class, an id or a role is of what holds no article text: 1, or 3 if the element's text has to say so too."""
    parts = [x.lower() for x in NAME_PARTS.findall(name)]
    if not parts or STATES.intersection(parts):
        return 0
    if any(STRONG.fullmatch(x) and not (x == "header" and OWN.intersection(parts)) for x in (*parts, "".join(parts))):
        return 1
    if any(x in WEAK and (len(parts) == 1 or any(y in PARTS or y in WEAK for y in parts if y != x)) for x in parts):
        return 1
    return 3 if any(map(DOUBTED.fullmatch, parts)) else 0


def _outside(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """0: the element may hold article text; 1: it does not by its name; 2: it can't; 3: it does not if its text is unlike the content's. And its name in a path."""
    name, found = tag, 2 if tag in OUTSIDE else 1 if tag in DOUBTFUL and not (tag == "header" and in_article) else 0
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value, key = "".join(values), key.lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 2, name
            if key in ("class", "id", "role"):
                name += "." + value
                # An id of a heading is made from what the article says there.
                if found in (0, 3) and tag not in ("html", "body", "article", "main") and not (key == "id" and tag in HEADINGS):
                    told = {*map(names_outside, value.split())}
                    found = 1 if 1 in told else 3 if 3 in told else found
    return found, name


class Page:
    """The blocks of a page, the elements they stand in, and the elements' paths, each as a tree."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str, bool]] = []  # element, text, whether it is mostly links
        self.parent, self.path, self.flag, self.plain = [-1], [0], [0], [0]  # of each element; plain: text besides links
        self.above, self.tag, self.up, self.inside = [-1], [""], [0], [False]  # of each path; up: the nearest that is no holder
        self._known: dict[tuple[int, str], int] = {}
        self._read(page)

    def _path(self, above: int, tag: str, name: str) -> int:
        found = self._known.get((above, name))
        if found is None:
            found = self._known[above, name] = len(self.tag)
            self.above.append(above)
            self.tag.append(tag)
            self.up.append(self.up[above] if tag in HOLDERS else found)
            self.inside.append(self.inside[above] or tag in ARTICLE)
        return found

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, element, whether it can't hold article text
        opened: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
        bases: list[int] = []  # where in the stack elements are that are not inline
        pieces: list[str] = []
        unclosed: set[str] = set()
        hidden, linked, at, end, quoted = 0, 0, 0, len(page), True

        def flush() -> None:
            nonlocal linked
            text = BLANK.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                element = stack[bases[-1]][1] if bases else 0
                self.blocks.append((element, text, 2 * linked > len(text)))
                self.plain[element] += max(0, len(text) - linked)
            linked = 0

        def cut(depth: int) -> None:
            nonlocal hidden
            while len(stack) > depth:
                tag, _, out = stack.pop()
                opened[tag].pop()
                hidden -= out
                if tag not in INLINE:
                    bases.pop()

        last = lambda tag: opened[tag][-1] if opened.get(tag) else -1
        while at < end:
            m = SPECIAL.search(page, at)
            stop = m.start() if m else end
            if stop > at and not hidden:
                pieces.append(page[at:stop])
                if opened.get("a"):
                    linked += len(page[at:stop].strip())
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                kind = m[0]
                close = "-->" if kind == "<!--" else "]]>" if kind == "<![CDATA[" else ">"
                k = page.find(close, at)
                if kind == "<![CDATA[" and not hidden:
                    pieces.append(html.escape(page[at : k if k >= 0 else end]))
                at = k + len(close) if k >= 0 else end
                continue
            k = VALUES.match(page, at).end() if quoted else page.find(">", at)
            if quoted and k < end and page[k] != ">":  # a quote that nothing ends: from here on quotes count nothing
                quoted, k = False, page.find(">", at)
            k = end if k < 0 else k
            attributes, at = page[at:k], min(k + 1, end)
            single = attributes.endswith("/")
            if tag in RAW and not m[1]:
                if not single and tag not in unclosed:
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    if close:
                        at = close.end()
                    elif tag != "head":
                        at = end
                    else:
                        unclosed.add(tag)
                continue
            if tag in VOID or tag in RAW:
                if tag in ("br", "hr", "img") and not hidden:
                    pieces.append(" ")
                if tag == "hr" and not hidden:
                    flush()
                continue
            inline = tag in INLINE
            if not inline and not hidden:
                flush()
            if m[1]:
                depth = last(tag)
                if depth >= 0 and not (inline and bases and bases[-1] > depth):
                    cut(depth)
                continue
            if not inline:
                while stack and stack[-1][0] in INLINE:
                    cut(len(stack) - 1)
                if stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
            if tag in ENDS:
                depth = max(map(last, ENDS[tag]))
                if depth > max(map(last, SCOPE)):
                    cut(depth)
            above = stack[bases[-1]][1] if bases else 0
            flag, name = _outside(tag, attributes, self.inside[self.path[above]])
            if single:
                continue
            element = above
            if not inline or flag:
                element = len(self.parent)
                self.parent.append(above)
                self.flag.append(flag)
                self.plain.append(0)
                self.path.append(self.path[above] if inline else self._path(self.path[above], tag, name))
            opened[tag].append(len(stack))
            if not inline:
                bases.append(len(stack))
            stack.append((tag, element, flag == 2 or inline and flag in (1, 3)))
            hidden += stack[-1][2]
        if not hidden:
            flush()

    def kept(self) -> list[tuple[int, str, bool]]:
        """(path, text, whether it is mostly links) of the blocks that may be content, in order."""
        n = len(self.parent)
        self._doubted()
        while True:
            out = [False] * n  # whether an element or one around it is left out
            for e in range(1, n):
                out[e] = out[self.parent[e]] or self.flag[e] > 0
            clean = list(self.plain)  # of each element, its text without that of elements left out inside it
            for e in range(n - 1, 0, -1):
                if not self.flag[e]:
                    clean[self.parent[e]] += clean[e]
            named = [e for e in range(1, n) if self.flag[e] == 1]
            most = max(named, key=lambda e: (clean[e], -e), default=0)
            if not most or clean[most] <= GUARD * clean[0]:
                return [(self.path[e], text, links) for e, text, links in self.blocks if not out[e]]
            while most:  # it and those around it go back
                self.flag[most] = 0 if self.flag[most] == 1 else self.flag[most]
                most = self.parent[most]


    def _doubted(self) -> None:
        """Elements that a doubted name leaves out go back if their text's ratio is like that of the best path outside them, and not mostly links."""
        n = len(self.parent)
        doubted = [0] * n  # the outermost doubted element around each, if nothing else leaves it out; -1: something does
        for e in range(1, n):
            around = doubted[self.parent[e]]
            doubted[e] = -1 if around < 0 or self.flag[e] in (1, 2) else around or (e if self.flag[e] == 3 else 0)
        if not any(f == 3 for f in self.flag):
            return
        text, marks, count, links, paths = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(lambda: [0, 0, 0])
        for e, body, linked in self.blocks:
            if (d := doubted[e]) < 0:
                continue
            points = len(PUNCTUATION.findall(body))
            if d:
                text[d], marks[d], count[d], links[d] = text[d] + len(body), marks[d] + points, count[d] + 1, links[d] + linked
            else:
                sums = paths[self.path[e]]
                sums[0], sums[1], sums[2] = sums[0] + len(body), sums[1] + points, sums[2] + 1
        ratio = lambda t, m, c: t / c * (1 + m / c) ** 0.5
        best = max((ratio(*x) for x in paths.values()), default=0.0)
        # Where a page is built of such elements alone, they are measured by the best of themselves.
        best = max(best, max((ratio(text[d], marks[d], count[d]) for d in count if 2 * links[d] <= count[d]), default=0.0))
        alike = {d for d in count if 2 * links[d] <= count[d] and LIKE * ratio(text[d], marks[d], count[d]) >= best}
        for e in range(1, n):
            if self.flag[e] == 3:
                self.flag[e] = 0 if doubted[e] in alike else 1


def followed(page: Page, nodes: list[tuple[int, str, bool]], sure: list[bool]) -> list[bool]:
    """``sure``, and the blocks that stand between such, or beside one."""
    out = list(sure)
    at = [i for i, x in enumerate(sure) if x]
    tag = lambda i: page.tag[nodes[i][0]]
    # The path of the element in which a block stands, lists, tables and quotations left out.
    home = lambda i: page.up[max(page.above[nodes[i][0]], 0)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        for i in range(a + 1, b):
            out[i] = tag(i) in FOLLOWS or bool({nodes[i][0], home(i)} & {home(a), home(b)})
    for start, step in ((at[0], -1), (at[-1], 1)):
        to, i = home(start), start + step
        while 0 <= i < len(nodes) and tag(i) in FOLLOWS and not nodes[i][2]:
            here = home(i)
            # A heading before the content may have a wrapper of its own, or the content may.
            if not (here == to or step < 0 and tag(i) in HEADINGS and (page.above[here] == to or here == page.above[to] or page.above[here] == page.above[to])):
                break
            out[i] = True
            i += step
    return out


def path_values(page: Page, nodes: list[tuple[int, str, bool]]) -> dict[int, float]:
    """The ratio of each path that has nodes, smoothed with its ancestors inside the body, each of which stands for the paths around this one."""
    n = len(page.tag)
    text, marks, count = [0] * n, [0] * n, [0] * n
    for path, body, _ in nodes:
        text[path] += len(body)
        marks[path] += len(PUNCTUATION.findall(body))
        count[path] += 1
    ratio = lambda p: (text[p] / count[p]) * (1 + marks[p] / count[p]) ** 0.5 if count[p] else 0.0
    own = {p: ratio(p) for p in range(n) if count[p]}
    for p in range(n - 1, 0, -1):  # from here on, of all that lies below a path
        above = page.above[p]
        text[above] += text[p]
        marks[above] += marks[p]
        count[above] += count[p]
    around = [0.0] * n
    for p in range(1, n):
        around[p] = max(around[page.above[p]], 0.0 if page.tag[p] in ("html", "body") else ratio(p))
    return {p: max(x, around[p]) for p, x in own.items()}


def extract(page: str | None, share: float = 0.2) -> str:
    """The main text of a page."""
    tree = Page(page or "")
    nodes = tree.kept()
    if not nodes:
        return ""
    value = path_values(tree, nodes)
    inside = sum(len(text) for path, text, _ in nodes if tree.inside[path])
    if inside and inside * 5 >= sum(len(text) for _, text, _ in nodes):
        nodes = [x for x in nodes if tree.inside[x[0]]]
    least = share * max(value[path] for path, _, _ in nodes)
    content = followed(tree, nodes, [value[path] >= least for path, _, _ in nodes])
    return "\n".join(text for (_, text, _), is_content in zip(nodes, content, strict=True) if is_content)


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", html_column).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
