"""op11: texts of pages that are built from known blocks, and wrappers of few pages by hand."""

import random

import pytest

from ledgerlens.llm.html_extraction import VARIANTS, Wrapper, aligned, extract, hosted, inferred, main_text, wrappers
from tests.llm.helpers import write_table

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def plain(html):
    return main_text(html, None, set(), set())


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<article></article>", ""),
        ("<nav>menu</nav><article>one <b>bold</b>word<p>two\n\t three<br>four<p>five</article><footer>f</footer>", "one boldword two three four five"),
        ("<article><header><h1>Title</h1><p>by line</p></header><p>text</p><footer>share</footer></article>", "Title text"),
        ("<header><h1>Site</h1></header><main><h1>T</h1><p>a</p><aside>x</aside></main><aside>y</aside>", "T a"),
        ("<article><p>a</p><div class='ad-box'>buy</div><form><p>mail</p></form><script>var t='</p>';</script><p>b</p></article>", "a b"),
        ("<article><p>a &amp; b &lt;i&gt; &eacute;&nbsp;&#233; &am</p></article>", "a & b <i> é é &am"),
        ("<article><p>a<!-- <p>no</p> --><p>b</article><section class=comments><article class='comment'>c</article></section>", "a b"),
        ("<article><p>a</p><div id='comments'><article><p>reader</p></article></div></article>", "a"),
        ("<body class='has-sidebar no-ads'><div class='content with-sidebar'><article><p>kept</p></article></div><div class=sidebar>s</div>", "kept"),
        ("<article><div role='alert'>notice</div><p>a<style>p{}</style></p><noscript>n</noscript><button>ok</button></article>", "a"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "one two 1 2 3"),
        ("<article><p>cut off here <b>and", "cut off here and"),
        ("<article><p title='a > b' class=\"x\"\">1 < 2</p></article", "1 < 2"),
        ("</p></div><article>a</section>b</article></article>c", "a b"),
        ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
        ("<ARTICLE><P>Case</P></ARTICLE><NAV>x</NAV>", "Case"),
    ],
)
def test_pages_by_hand(html, text):
    assert plain(html) == text


def page(draw, body, style):
    """A page with its text's blocks, and much around them."""
    words = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    blocks, kept = [], []
    for _ in range(draw.randrange(2, 9)):
        text = words(draw.randrange(5, 60))
        kind = draw.choice(["p", "p", "p", "h2", "blockquote", "li"])
        blocks.append(f"<ul><li>{text}</li></ul>" if kind == "li" else f"<{kind}>{text}</{kind}>" if draw.random() < 0.8 or kind != "p" else f"<p>{text}")
        kept.append(text)
        if draw.random() < 0.3:
            blocks.append(draw.choice([f"<aside>{words(5)}</aside>", f'<div class="advert">{words(4)}</div>', f'<form><input name=q>{words(3)}</form>', "<script>if(a<b){}</script>"]))
    inner = "".join(blocks)
    if style == "article":
        inner = f"<article>{inner}</article>"
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    top = f"<nav><ul>{menu}</ul></nav>" if style == "article" else f"<div><ul>{menu}</ul></div>"
    notes = f'<section id="comments"><p>{words(200)}</p></section>' if draw.random() < 0.5 else ""
    return f"<html><head><title>{words(4)}</title></head><body>{top}<table><tr><td><div>{inner}</div></td></tr></table>{notes}<div>All rights kept by us</div></body></html>", " ".join(kept)


@pytest.mark.parametrize("style", ["article", "boxes"])
def test_built_pages(spark, style):
    draw = random.Random(7)
    made = [page(draw, 0, style) for _ in range(60)]
    rows = [(f"https://Host{i % 3}.example/{i}?q#f", html) for i, (html, _) in enumerate(made)]
    got = texts(extract(pages(spark, rows)))
    assert got == {i: text for i, (_, text) in enumerate(made)}


def test_expression():
    w = Wrapper()
    w.align("<body><h1>a</h1><p>b</p><p>c</p><div>same</div></body>")
    w.align("<body><h1>d</h1><p>e</p><ul><li>f</li></ul><p>g</p><div>same</div></body>")
    w.align("<body><p>h</p><div>same</div></body>")
    from ledgerlens.llm.html_extraction import expression

    names = ("parent", "label", "pages", "parents", "occurrences", "chars", "linked", "low", "high")
    nodes = {n: dict(zip(names, s)) for n, s in w.nodes.items()}
    root = next(n for n, s in nodes.items() if s["label"] == "")
    assert expression(nodes, w.marks, root) == "<body>(<h1>#</h1>)?((<p>#</p>)?(<ul><li>=</li></ul>)?)+<div>=</div></body>"


def test_order_and_place_of_pages_do_not_matter(spark):
    draw = random.Random(3)
    rows = [(f"http://h{i % 2}.org/", page(draw, 0, draw.choice(["article", "boxes"]))[0]) for i in range(40)]
    one = {tuple(map(str, r)) for r in inferred(aligned(hosted(pages(spark, rows).coalesce(1)))).collect()}
    draw.shuffle(rows)
    many = {tuple(map(str, r)) for r in inferred(aligned(hosted(pages(spark, rows).repartition(9)))).collect()}
    assert one == many and len(one) == 2


def test_template_text_of_a_host(spark):
    made = [f"<div><div>Read also our paper</div><p>story {i} goes on and on</p></div>" for i in range(VARIANTS * 4)]
    got = texts(extract(pages(spark, [("http://a.b/", h) for h in made] + [("http://few/", made[0])] * 3)))
    assert got[5] == "story 5 goes on and on"
    assert got[len(made)] == "Read also our paper story 0 goes on and on"  # three equal pages: nothing is known to be template


def test_defined_cases(spark):
    rows = [(None, None), (None, "<article>x</article>"), ("no url", ""), ("http://h/", "<article>same</article>"), ("http://h/", "<article>same</article>")]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages(spark, rows)).collect()}
    assert got == {0: (None, "", 0), 1: (None, "x", 1), 2: ("no url", "", 0), 3: ("http://h/", "same", 4), 4: ("http://h/", "same", 4)}
    assert extract(pages(spark, [])).count() == 0 and wrappers(pages(spark, [])).count() == 0
    odd = pages(spark, rows).selectExpr("*", "1 AS host", "2 AS text", "3 AS region", "4 AS linked", "5 AS node")
    assert texts(extract(odd)) == {i: t for i, (_, t, _) in got.items()}


def test_very_long_and_deep_pages(spark):
    text = " ".join(f"w{i}" for i in range(100_000))
    deep = "<div><span><section>" * 20_000 + "<p>inner</p>" + "</b>" * 20_000
    got = texts(extract(pages(spark, [("http://x/", f"<article><p>{text}</p></article>"), ("http://y/", deep)])))
    assert got == {0: text, 1: "inner"}


def test_query_on_the_table_as_built(spark, tmp_path):
    from ledgerlens.llm.html_extraction import op11_html_extraction

    folder = write_table(spark, tmp_path, "pages", pages(spark, [("http://h/", "<nav>n</nav><article><h1>A&amp;B</h1><p>c</article>")]))
    assert [tuple(r) for r in op11_html_extraction(spark, folder).collect()] == [(0, "http://h/", "A&B c", 5)]
