"""Main text of pages: the given pages against a plain reading of their one layout, and odd pages."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from verdigris.llm import html_text
from verdigris.llm import queries as Q


def plain(page):
    """What stands in the given pages' article."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?h1>|</?p>", inner))
    return "\n".join(x for x in lines if x)


def test_query_on_its_table(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("0.001", "0.01")):
        pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
        got = Q.op12_html_main_text(spark, d).collect()
        assert len(got) == len(pages)
        for r in got:
            assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


SIDE = "<p>Side text that is long enough to be taken for the text of an article, and longer than most of it, by far.</p>"
COMMENT = "<p>I think that this is a very long comment by a reader, longer than all of the article, and it goes on and on.</p>"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("just &lt;b&gt; &amp; more", "just <b> & more"), ("<p>one<p>two", "one\ntwo"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<p title='a>b'>q</p>", "q"), ("<p>para <b>bold <i>it</b>al</i> text</p>", "para bold ital text"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("&nbsp;a&nbsp;b&#x41;&amp;amp;&am", "a bA&amp;&am"), ("<template><p>no</p></template><noscript>no</noscript><p>yes</p>", "yes"), ("<nav>only a menu</nav>", ""), ("<div class='ad'>only an advert</div>", "only an advert"),
    ("<script>var t='</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><p>yes<!-- --", "yes"), ("<p>a<br>b</p>", "a b"), ("<p>cut off <a href='x", "cut off"),
    (f"<body class=with-sidebar><main><article><header><h1>T</h1></header><p>a b c</p><pre>x\n y</pre><aside>{SIDE}</aside><form>f</form><section class=comments><article class=comment>{COMMENT}</article></section></article></main></body>", "T\na b c\nx y"),
    (f"<div id=header><a href=x>Home</a> Site</div><div class=content><h1>Title</h1><div><p>First para is here with words.<p>Second of <a href=y>linked</a> words.</div><h2>Short</h2><div><p>Third para with many more words in it.</p><ul><li>one<li>two</ul></div></div><div class=sidebar>{SIDE}</div><div id=comments>{COMMENT}</div><div class=cookie-notice>We use them</div><footer>f</footer>", "Title\nFirst para is here with words.\nSecond of linked words.\nShort\nThird para with many more words in it.\none\ntwo"),
    ("<div><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul></div><div><p>The text of the page, long enough to matter here.</p><p>More of it.</p></div>", "The text of the page, long enough to matter here.\nMore of it."),
])
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_defined_cases(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "node")})
    got = sorted(map(tuple, html_text.extracted(df).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, "v", "", 0), (None, None, "", 0)]
    assert html_text.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 40000 + "x" + "</div>" * 40000, "<a href='" * 40000, "<b>" * 40000 + "x" + "</i>" * 40000, "<p>" * 40000, "<" * 200000, "<x =" * 40000, "<!--" * 40000, "<div><p>word " * 40000, "<script>" * 40000, "a &" * 100000], ids=lambda x: x[:8])
def test_time_is_linear(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_density_follows_the_formula():
    """One node by hand: characters a tag, adjusted by links."""
    import math

    tree = html_text.parsed("<body><div><p>aaaa <a>bb</a></p><p>cccccc</p></div></body>")
    chars = [0] * len(tree.tag)
    for node, text in tree.text:
        if text:
            chars[node] += len(text.strip())
    density, total, c, lc = html_text.densities(tree, [False] * len(tree.tag), chars)
    at = tree.tag.index("div")
    assert (c[at], lc[at]) == (12, 2)
    want = 12 / 3 * math.log(12 / 2 * 3 / 1) / math.log(math.log(12 / 10 * 2 + 2 / 12 * 12 + math.e))
    base = math.log(12 / 10 * 2 + 2 / 12 * 12 + math.e)
    assert density[at] == pytest.approx(12 / 3 * math.log(18) / math.log(base)) == pytest.approx(want)
    first = tree.tag.index("p")
    assert total[at] == pytest.approx(sum(density[i] for i in range(len(tree.tag)) if tree.tag[i] == "p")) and total[first] == density[tree.tag.index("a")]
