"""HTML extraction: ratios against a plain version, names, pages that hold all text in a named element, broken and deep pages."""

import random
import re
import time

import pytest

from tarnwell.llm import html_extract as he

TEXT = "Words of the article, here they are. And more of them, too."


def tree_values(root):
    """The smoothed ratios by the definition, of a tree of (name, [children or texts])."""
    own, below = {}, {}

    def walk(node, path):
        name, children = node
        path = (*path, name)
        for c in children:
            if isinstance(c, str):
                for k in range(1, len(path) + 1):
                    below.setdefault(path[:k], []).append(c)
                own.setdefault(path, []).append(c)
            else:
                walk(c, path)

    walk(root, ())
    ratio = lambda texts: sum(map(len, texts)) / len(texts) * (1 + sum(len(re.findall(r"[.,;:!?]", t)) for t in texts) / len(texts)) ** 0.5
    return {p: max([ratio(t), *(ratio(below[p[:k]]) for k in range(1, len(p) + 1) if p[k - 1] not in ("html", "body"))]) for p, t in own.items()}


def test_path_ratios_against_their_definition():
    draw = random.Random(4)

    def node(depth):
        name = draw.choice(("div", "section", "p") if depth < 4 else ("p",))
        if name == "p" or depth >= 4:
            return ("p", ["w" * draw.randint(1, 30) + draw.choice((".", ",!", ""))])
        return (name, [node(depth + 1) for _ in range(draw.randint(1, 3))])

    write = lambda n: n if isinstance(n, str) else f"<{n[0]}>" + "".join(map(write, n[1])) + f"</{n[0]}>"
    for _ in range(40):
        root = ("body", [node(1) for _ in range(3)])
        page = he.Page(write(root))
        nodes = page.kept()

        def path(p, page=page):
            out = []
            while p > 0:
                out.append(page.tag[p])
                p = page.above[p]
            return tuple(reversed(out))

        got = {path(p): v for p, v in he.path_values(page, nodes).items()}
        assert got == pytest.approx(tree_values(root))


@pytest.mark.parametrize("name", ["wrap no-sidebar", "content two-column-nav", "with-sidebar", "comments-open", "nav-wrap"])
def test_a_name_on_the_whole_page_does_not_empty_it(name):
    page = f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='{name}'><div class=sidebar><p>Side words, here. Some more.</p></div><div class=post><h2>Head</h2><p>{TEXT}</p></div></div></body>"
    assert he.extract(page) == f"Head\n{TEXT}"


def test_titles_stay():
    for head in ("<header><h1>Title</h1></header>", "<div class='post-header'><h1>Title</h1></div>", "<h1 id='comments-on-nav'>Title</h1>"):
        assert he.extract(f"<body><header class=site><p>Site, name. Of it.</p></header><article>{head}<p>{TEXT}</p></article></body>") == f"Title\n{TEXT}"
    assert he.extract(f"<form id=page><div><h2 id=share-price>Share price</h2><p>{TEXT}</p><div id=share-price><p>{TEXT}</p></div></div></form>") == f"Share price\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize(("name", "outside"), [("site-header", True), ("post-header", False), ("siteHeader", True), ("commentList", True), ("commentary", False), ("share", True), ("share-price", False), ("share-buttons", True), ("related-work", False), ("related-posts", True), ("no-sidebar", False), ("side-bar", True), ("navy", False), ("ad", True), ("adapted", False), ("", False)])
def test_names(name, outside):
    assert he.names_outside(name) == outside


@pytest.mark.parametrize("part", ["<div>x.", "<b>", "<a href=\"x' ", "<i><div></i>", "<center><li>x", "<head>", "<!--", "<p>a</b>", "<x='\"", "x '\"<>", "<script>"])
def test_long_and_broken_pages_take_time_in_proportion(part):
    def seconds(n):
        page = part * n
        begin = time.process_time()
        he.extract(page)
        return time.process_time() - begin

    small, large = seconds(4000), seconds(32_000)
    assert large < 0.3 + 24 * small  # eight times the page


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, ""), (3, "v", f"<p>{TEXT}</p>" * 2000), (3, "v", f"<p>{TEXT}</p>" * 2000)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["n_chars"]) for r in he.extract_pages(df).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (3, 2000 * (len(TEXT) + 1) - 1), (3, 2000 * (len(TEXT) + 1) - 1)]
    assert he.extract_pages(df.limit(0)).count() == 0


PROSE = "This is a paragraph of some length, with a comma or two, which tells the reader what happened. It goes on, as articles do, for a while."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<h1>Title</h1><div class='elementor-widget'><p>{PROSE}</p></div><div class='elementor-widget'><p>Second. {PROSE}</p></div>", ["Title", PROSE, f"Second. {PROSE}"]),
        (f"<div><p>{PROSE}</p><p class='skip-ahead'>Skipped, or not? {PROSE}</p><div class='overlay'><p>Over it. {PROSE}</p></div></div>", [PROSE, f"Skipped, or not? {PROSE}", f"Over it. {PROSE}"]),
        (f"<article><p>{PROSE}</p><p>Let <math><mi>x</mi><annotation encoding='tex'>\\x</annotation></math> be, and <object data='a.svg'>a drawing</object> too.</p></article>", [PROSE, "Let x be, and a drawing too."]),
        (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div class='kommentare'><p>Leser: {PROSE}</p></div><div class='werbung'><p>Kauf! {PROSE}</p></div>", [PROSE, PROSE]),
        (f"<div><p>{PROSE}</p></div><div class='widget'><h3>Recent</h3><ul><li><a href='a'>One post</a></li><li><a href='b'>Another post</a></li></ul></div><a class='skip-link' href='#main'>Skip to content</a>", [PROSE]),
        (f"<div><p>{PROSE}</p></div><div class='banner'>Buy now</div><div class='modal'><p>Close</p></div>", [PROSE]),
    ],
)
def test_names_that_do_not_decide_alone(page, want):
    assert he.extract(f"<html><body><nav><a href='/'>Home</a></nav>{page}<footer>Imprint</footer></body></html>").split("\n") == want
