"""Main text of pages: the parser on damaged pages, the decoding against all choices, and held-out accuracy on made-up pages and on the test table."""

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from wordloom.llm.dom import Page, joined, parse
from wordloom.llm.html_text import Memo, decode, extract, groups_of, main_text, trained
from wordloom.llm.page_maker import made_page

SCHEMA = "page_id long, url string, html string, text string, n_chars string, node string"


def everything(source):
    page = parse(source)
    return joined(page, [True] * len(page.tags))


@pytest.mark.parametrize(
    "source,want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<p><b>one<br>two<p>three", "one two\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"),
        ('<p title="a > b">x</p><script>var t="</p>";</script><style>p{}</style>y', "x\ny"),
        ("x<!-- <p>no</p> -->y<!-- open", "xy"),
        ("a <b>b</b>\n\t <i>c</i>d&nbsp;e", "a b cd e"),
        ("<p>a</i></div></p></p>b", "a\nb"),
        ("a < b <3 &lt;p&gt; &am &#8364; &unknown;", "a < b <3 <p> &am € &unknown;"),
        ("<p>cut off</artic", "cut off"),
        ("<div>x<span class=note>y</span>z</div>", "xyz"),
        ("<head><title>t</title><body>b", "b"),
        ("<TEXTAREA>no</TEXTAREA>A<Noscript>no</NOSCRIPT>B", "AB"),
        ("<i><div>a</i>b</div>c", "ab\nc"),
    ],
)
def test_parser(source, want):
    assert everything(source) == want


def test_tree():
    page = parse('<div id="main"><p class="x y">a<p>b</div><nav role=menu></nav>')
    assert list(zip(page.tags, page.parents, page.ends, page.attributes)) == [("#page", -1, 5, ""), ("div", 0, 4, "main"), ("p", 1, 3, "x y"), ("p", 1, 4, ""), ("nav", 0, 5, "menu")]


def test_deep_and_long_pages():
    assert everything("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert everything("<p>" + "word " * 300_000) == ("word " * 300_000).strip()
    assert everything("<b>" * 5000 + "x" + "</i>" * 5000) == "x"


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        for _ in range(60):
            page = Page(tags=["div"] * n, parents=[-1, *[int(rng.integers(0, i)) for i in range(1, n)]])
            score = rng.normal(0, 2, n)
            texty = rng.random(n) < 0.8
            value = lambda k: sum(s for s, t, x in zip(score, texty, k) if t and x)  # noqa: B023, E731
            allowed = [k for k in itertools.product((False, True), repeat=n) if all(not k[i] or k[page.parents[i]] for i in range(1, n))]
            got = decode(page, score, texty)
            assert tuple(got) in allowed
            assert value(got) == pytest.approx(max(map(value, allowed)))


def test_words_of_attributes():
    names = "main nav header footer side ad notice comment form share hidden".split()
    told = lambda x: [names[i] for i in range(11) if groups_of(x) >> i & 1]
    assert told("navBar") == ["nav"]
    assert told("adipose x1") == []
    assert told("post-comments") == ["main", "comment"]
    assert told("ad-slot SIDEBAR") == ["side", "ad"]


def test_held_out_pages():
    made = [made_page(5_000_000 + i) for i in range(300)]
    got = extract([s for s, _ in made], trained(), Memo())
    same = found = known = exact = 0
    for g, (_, w) in zip(got, made, strict=True):
        a, b = Counter(g.split("\n")), Counter(w.split("\n"))
        same, found, known, exact = same + (a & b).total(), found + a.total(), known + b.total(), exact + (g == w)
    assert same / found > 0.99
    assert same / known > 0.99
    assert exact / len(made) > 0.94


def known_text(source):
    """The article of the test table's pages, whose layout is known."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    bare = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\0", inner)))
    return "\n".join(y for x in bare.split("\0") if (y := " ".join(html.unescape(x).split())))


def test_pages_of_the_test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: known_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert got == want


def test_other_layouts():
    prose = "Words of a sentence that goes on, and on, for a while. And one more of them follows here. "
    comments = "".join(f'<div class="comment"><b>Name</b><p>I think that {prose}</p></div>' for _ in range(4))
    source = f"""<body><div class="site-header"><a href=/>Site</a><ul class=menu><li><a href=a>A</a><li><a href=b>B</a></ul></div>
    <div class="cookie-notice"><p>This site stores things on your device, which you may accept or not.</p><button>OK</button></div>
    <div class="content"><h1>The title</h1><p>{prose}</p><div class="ad">Buy this now, it is cheap.</div><h2>Part</h2><p>{prose * 3}</p><ul><li>First, a thing.<li>Second, a thing.</ul></div>
    <div id="comments"><h3>Comments</h3>{comments}</div><div class="sidebar"><h3>More</h3><ul><li><a href=x>Other story</a></ul></div>
    <form class="newsletter"><p>Get our letters.</p><input name=m></form><div class=footer>&copy; 2020 Site</div>"""
    want = ["The title", prose.strip(), "Part", (prose * 3).strip(), "First, a thing.", "Second, a thing."]
    assert extract([source], trained(), Memo())[0].split("\n") == want


def test_edges(spark):
    article = "<article><h1>T</h1><p>Some words, as they go. And more of them here.</p></article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, article), (3, None, article), (None, "u", article), (4, "u", "<nav><a href=x>a</a></nav>" + "<p>" * 3), (5, "u", "  \n ")]
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in main_text(pages).collect())
    text = "T\nSome words, as they go. And more of them here."
    assert got == Counter([(1, "u", "", 0), (2, "u", "", 0), (3, None, text, len(text)), (3, None, text, len(text)), (None, "u", text, len(text)), (4, "u", "", 0), (5, "u", "", 0)])
    empty = main_text(spark.createDataFrame([], SCHEMA))
    assert (empty.columns, empty.collect()) == (["page_id", "url", "text", "n_chars"], [])
