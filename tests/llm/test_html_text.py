import html
import re

import pytest

from ruleflow.llm import html_text

SF = "/root/testdata/sf0.01"


def slow_article(source):
    """The paragraphs of the one article of the test pages, by cutting at its tags."""
    article = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in parts]
    return "\n\n".join(text for text in texts if text)


def kept(source):
    parsed = html_text.Parser(source)
    level = max((b[4] for b in parsed.blocks), default=0)
    return [b[1] for b in parsed.blocks if (b[4] == level if level else not b[3])]


@pytest.mark.parametrize(("source", "texts"), [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]), ("<p>x <b>y</b>z<i> w</i></p>", ["x yz w"]),
    ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer></article><p>out</p>", ["T", "a"]),
    ("<header>h</header><p>a</p><nav>n</nav><aside>s</aside><form>q<input></form>", ["a"]),
    ("<article>a<script>var t='</p><p>no';</script> b<style>p{}</style></article>", ["a b"]), ("<p>a<!-- <p>no</p> --> b</p>", ["a b"]),
    ("<p>a <button>no</button> b <span class='ad'>no</span> c</p>", ["a b c"]), ("<div class='comments'><article class=comment>no</article></div><p>yes", ["yes"]),
    ("<article>a</article><article class='comment'>no</article>", ["a"]), ("<main><p>m</p><article><p>a</p></article></main>", ["a"]),
    ("<main><p>m</p><div id=sidebar>no</div></main><p>x", ["m"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<article><p>a<div class='notice-box'>no</div>b</article>", ["a", "b"]),
    ("<p>1 < 2 &lt;b&gt; &#233;&nbsp;&#x41;</p>", ["1 < 2 <b> é A"]), ("<p title='a>b'>t</p><P CLASS=x>u</P>", ["t", "u"]), ("<p>a</div>b</p>", ["a", "b"]),
    ("<title>no</title><textarea><p>no</textarea><p hidden>no</p><p>yes</p>", ["yes"]), ("<script>never closed <p>no", []), ("<p>a<!-- open", ["a"]),
    ("<b>x<p>y</b>z</p>", ["x", "yz"]), ("<pre>a\n  b</pre>\r\n<blockquote>q</blockquote>", ["a b", "q"]), ("<article><a href='x'>l</a></article>", ["l"]),
])
def test_blocks(source, texts):
    assert kept(source) == texts


def test_given_pages_equal_cutting_at_tags(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    given = pages.collect()
    assert len(found) == len(given)
    for page in given:
        wanted = slow_article(page.html)
        assert (found[page.page_id].text, found[page.page_id].n_chars, found[page.page_id].url) == (wanted, len(wanted), page.url)


def site(n, host="plain.example"):
    """Pages without an article element: a template around text that varies, a box of links and a fixed line."""
    return [
        (i, f"http://{host}/{i}", f"<html><body><div class=top>Welcome to us</div><div class=box><a href=x>link {i}</a> <a href=y>more</a></div>"
         f"<div class=body><p>story {i} begins</p><p>and ends {i}</p></div><div class=line>Made by us</div></body></html>", "x")
        for i in range(n)
    ]


def test_slots_of_pages_without_an_article(spark):
    pages = spark.createDataFrame(site(12), "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert {(r.page_id, r.text) for r in found} == {(i, f"story {i} begins\n\nand ends {i}") for i in range(12)}


def test_equal_vectors_make_nested_classes(spark):
    pages = spark.createDataFrame(site(6) + [(50, "http://plain.example/z", "<html><body><p>only here</p></body></html>", "x")], "page_id long, url string, html string, text string")
    template = html_text.templates(html_text.tokens(html_text.outlines(html_text.parsed(pages)))).collect()
    by_pages = {r.pages: r for r in template}
    assert set(by_pages) == {6, 7}
    assert [e.path for e in by_pages[7].elements] == ["html", "html/body"] and by_pages[7].nested_in is None
    inner = [r for r in template if r.pages == 6]
    assert {e.path for r in inner for e in r.elements} == {f"html/body/div.{c}" for c in ("top", "box", "body", "line")} | {"html/body/div.body/p"}
    assert all(r.nested_in in {t.vector for t in template} for r in inner)
    assert any(len(r.texts) == 2 and len(r.elements) == 4 for r in inner)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (None, "http://h/", "<p>x</p>", "b"), (2, "::bad[", "<p>y</p>", None), (2, "::bad[", "<p>y</p>", None), (3, "http://h/", "", "c")]
    rows += [(4, "http://h/long", "<article>" + "<p>word</p>" * 3000 + "</article>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=str)
    long = "\n\n".join(["word"] * 3000)
    assert found == sorted([(1, "", 0), (None, "x", 1), (2, "y", 1), (2, "y", 1), (3, "", 0), (4, long, len(long))], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_copies_of_one_article_are_no_template(spark):
    copies = [(i, "http://same.example/", "<html><body><nav>n</nav><article><p>the same</p></article></body></html>", "") for i in range(9)]
    found = html_text.extract(spark.createDataFrame(copies, "page_id long, url string, html string, x string")).collect()
    assert {r.text for r in found} == {"the same"} and len(found) == 9


def texts_of(spark, sources, host="one.example"):
    rows = [(i, f"http://{host}/{i}", source) for i, source in enumerate(sources)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_template_inside_an_article(spark):
    sources = [
        f"<html><body><article><h1>Title {i}</h1><div class=tools><a href=p>Print</a> <a href=m>Mail</a></div><p>story {i} begins</p>"
        f"<ul><li><a href=t>topic {i % 2}</a></li></ul><p>Made by us</p><p>it ends {i}, see <a href=x>this</a></p>"
        f"<ol><li><a href=r>source {i}</a></li></ol></article></body></html>"
        for i in range(12)
    ]
    # Text of every page and a box of few links go; a list of links of the article's own stays.
    assert texts_of(spark, sources) == [f"Title {i}\n\nstory {i} begins\n\nit ends {i}, see this\n\nsource {i}" for i in range(12)]


def test_article_in_a_main_element_that_holds_the_text(spark):
    pages = [
        f"<html><body><main><h1>Title {i}</h1><p>the story of page {i} is told here at length</p><article><p>next: {i}</p></article></main></body></html>"
        for i in range(9)
    ]
    assert texts_of(spark, pages) == [f"Title {i}\n\nthe story of page {i} is told here at length" for i in range(9)]
    assert texts_of(spark, pages[:1]) == ["Title 0\n\nthe story of page 0 is told here at length"]
    around = [f"<main><p>by {i}</p><article><p>the story of page {i} is told here</p></article></main>" for i in range(9)]
    assert texts_of(spark, around) == [f"the story of page {i} is told here" for i in range(9)]


def test_copies_and_near_copies_keep_their_articles(spark):
    menu = "<html><body><nav>menu {i}</nav><article>"
    copies = [menu.format(i=i) + "<h1>Title</h1><p>one</p><p>two</p><ul><li><a href=x>list</a></ul></article>" for i in range(9)]
    assert texts_of(spark, copies) == ["Title\n\none\n\ntwo\n\nlist"] * 9
    long = " ".join(["told"] * 100)
    near = [menu.format(i=i) + f"<h1>Title</h1><p>{long}</p><p>now {i}</p></article>" for i in range(9)]
    assert texts_of(spark, near) == [f"Title\n\n{long}\n\nnow {i}" for i in range(9)]
    others = [f"<html><body><nav>x</nav><article><p>other {i}</p><p>Made by us</p></article>" for i in range(9)]
    section = [f"<html><body><nav>{i}</nav><article class=review><p>{long}</p></article>" for i in range(4)]
    assert texts_of(spark, section + others) == [long] * 4 + [f"other {i}" for i in range(9)]


def test_repeated_rows_are_no_template(spark):
    # Pages 0 and 1 have an element of their own, 0 and 2 a text: these are different pages, though as many.
    shared = {0: "both", 2: "both"}
    rows = [
        (i, "http://two.example/", f"<html><body><article><div class={'aabbccdd'[i]}><p>page {i}</p></div><p>{shared.get(i, f'own {i}')}</p></article>")
        for i in range(8)
    ]
    single = (8, "http://two.example/", "<html><body><article><div class=ee><p>page 8</p></div></article>")
    found = html_text.extract(spark.createDataFrame(rows * 2 + [single], "page_id long, url string, html string")).collect()
    wanted = [(i, f"page {i}\n\n{shared.get(i, f'own {i}')}") for i in range(8)]
    assert sorted((r.page_id, r.text) for r in found) == [*sorted(wanted * 2), (8, "page 8")]
