import pytest

from tests.llm.helpers import rows_of
from tickerloom.llm.html_extract import extract, main_text

LONG = "This paragraph is long enough, with commas, to pass points to what holds it. "
CASES = [
    (None, ""), ("", ""), ("<p>hi", "hi"), ("plain &lt;b&gt; 1 < 2", "plain <b> 1 < 2"), ("<div>a<br>b<span>c</span>d</div>", "a bcd"),
    (f"<nav><a href=/>Menu</a></nav><article><h1>Head</h1><p>{LONG}<p>x &amp; y</article><footer>{LONG}</footer>", f"Head {LONG}x & y"),
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div><div id=m><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><aside>{LONG}</aside>", f"T {LONG}{LONG}"),
    (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section><form>{LONG}<input></form></article>", LONG),
    (f"<article><p>{LONG}</p><script>var x='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div class=ad>{LONG}</div></article>", LONG),
    (f"<article><header><h1>H</h1></header><ul><li>one<li>two</ul><table><tr><td>c<td>{LONG}</table></article>", f"H one two c {LONG}"),
    (f"<body><div><p>{LONG}</p><ul><li><a>l1 l1 l1</a><li><a>l2 l2 l2</a><li><a>l3 l3 l3</a></ul><p>{LONG}</p></div></body>", f"{LONG}{LONG}"),
    ("<article><p>a  b&nbsp;c\n\td</p><p hidden>no</p></article>", "a b c d"),
    # No article element: headings, short paragraphs and short sections beside the container are the article's.
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><h2>Part</h2><p>{'s' * 60}</p></div><div><p>{LONG}{LONG}</p></div></body>", f"{LONG}{LONG}Part {'s' * 60} {LONG}{LONG}"),
    (f"<body><div id=c><p>{LONG}</p><p>{LONG}</p></div><h2>More</h2><p>Short.</p><section><p>{'t' * 100}</p></section></body>", f"{LONG}{LONG}More Short. {'t' * 100}"),
    (f"<body><ul><li><a>l1 l1</a><li><a>l2 l2</a><li><a>l3 l3</a></ul><h1>T</h1><div><p>{LONG}</p></div><div><a>one</a> <a>two</a> <a>three</a></div><p>End.</p></body>", f"T {LONG}End."),
    # Inside a marked article a name with a part that says something else is no advert.
    (f"<main><p>{LONG}</p><div class='text-ad-free'>kept</div><div class='share-price'>12</div><p class=notice-period>two weeks</p><div class='ad-slot'>no</div><ul class=share-buttons><li>no</ul></main>", f"{LONG}kept 12 two weeks"),
    (f"<header>Site</header><main><p>{LONG}</p></main><div style='display: none'>{LONG}</div>", LONG),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == " ".join(text.split())


def scores(page):
    """Plain recursion over a well-formed page: what each element with an id gets from its paragraphs."""
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(page)
    up = {c: p for p in tree.iter() for c in p}
    text = lambda e: "".join(e.itertext())
    size = lambda e: sum(len(t.strip()) for t in e.itertext())
    total = {}
    for p in tree.iter("p"):
        linked = sum(size(a) for a in p.iter("a"))
        points = (1 + min(size(p) / 100, 3) + text(p).count(",")) * (1 - linked / size(p))
        node, level = up.get(p), 0
        while node is not None and size(p) >= 25:
            share = 1 if level == 0 else 2 if level == 1 else 3 * level
            total[node.get("id")] = total.get(node.get("id"), 0) + points / share
            node, level = up.get(node), level + 1
    return total


def test_scores_equal_a_plain_recursion():
    import random

    from tickerloom.llm.html_extract import containers, parse

    rng = random.Random(2)
    for _ in range(30):
        count = [0]

        def made(depth):
            count[0] += 1
            name = f"n{count[0]}"
            inner = "".join(made(depth - 1) if depth and rng.random() < 0.6 else f"<p>{'word, ' * rng.randint(1, 60)}<a>{'x' * rng.randint(0, 30)}</a></p>" for _ in range(rng.randint(1, 3)))
            return f'<div id="{name}">{inner}</div>'  # noqa: B023

        page = made(3)
        root = parse(page)
        containers(root)
        found, stack, at = {}, [root.children[0]], 0
        order = []
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
        for node in order:
            if node.tag == "div":
                at += 1
                found[f"n{at}"] = node.score
        want = scores(page)
        assert all(abs(found[k] - want.get(k, 0)) < 1e-9 for k in found)


def test_broken_markup_ends():
    for page in ("<", "</", "<!--", "<p", "<a href='", "</b></p><p><i>x", "<script>never closed", "<![CDATA[x]]>", "<p>" * 3000 + "deep"):
        assert isinstance(main_text(page), str)
    assert main_text("<p>" * 3000 + "deep") == "deep" and main_text("<div>" * 5000 + "deep") == "deep"


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", CASES[5][0]), (1, "u", CASES[5][0]), (None, None, None), (2, "v", ""), (3, "w", "<p>🙂</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert rows_of(found.where("page_id > 1 OR page_id IS NULL"), "page_id", "text", "n_chars") == [(2, "", 0), (3, "🙂", 1), (None, "", 0)]
    assert found.count() == 5 and extract(pages.limit(0)).count() == 0
