"""Main text of pages: the tables' pages against SQL, other page forms against their article."""

from collections import Counter

import duckdb
import pytest
from conftest import SF

from tidemark.llm import html

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = '<nav><ul><li><a href="/x">Home page</a></li><li>News today</li></ul></nav>'
FORMS = {
    "article": (HEAD + NAV + "<article><h1>A  title</h1><p>One &amp; two\n three<br>four</p><p>Five</p></article><footer>&copy; all rights</footer></body></html>", "A title\n\nOne & two three four\n\nFive"),
    "soup": (HEAD + NAV + "<div class='ad'>Buy now cheap<article><h1>T &lt;x&gt;</h1><p><b>bold<br><p>next</article><footer>foot</footer>", "T <x>\n\nbold\n\nnext"),
    "main": (HEAD + '<header class="top"><a href="/">Site name</a></header><main><header><h1>Head</h1></header><p>Text here</p><aside>side note</aside><p>More text</p></main><div class="cookie-notice">We use cookies</div>', "Head\n\nText here\n\nMore text"),
    "divs": (HEAD + NAV + '<div class="sidebar">links and more links</div><div id="content"><h2>Name</h2><p>Several words of the article itself.</p><form action="/s"><input name="q">search here</form><p>And the end.</p></div><div id="comments"><p>first reader says hi</p></div><footer>end of page</footer>', "Name\n\nSeveral words of the article itself.\n\nAnd the end."),
    "comments": (HEAD + "<article><p>Own text</p><section class='comments'><article><p>A reader wrote this</p></article></section><p>Own end</p></article><section><article><p>unrelated teaser</p></article></section>", None),
    "list": (HEAD + "<article><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><!-- no --><script>x<y</script><pre>p  q</pre></article>", "one\n\ntwo\n\na b\n\np q"),
    "number": ("<article>caf&eacute; &#233; &#x1F600; a<b>c</b>d e&nbsp;f 1 < 2</article>", "café é \U0001f600 acd e f 1 < 2"),
    "empty": ("", ""), "null": (None, ""), "tags": ("<p><div></div>", ""), "broken": ("<article><p>text <a href='x", "text"),
}


@pytest.mark.parametrize("name", [k for k, v in FORMS.items() if v[1] is not None])
def test_page_forms(name):
    page, want = FORMS[name]
    assert html.main_text(page, {}) == want


def test_reader_comments_are_left_out():
    text = html.main_text(FORMS["comments"][0], {})
    assert text.startswith("Own text\n\nOwn end") and "reader" not in text


KEPT = {
    "discussion": '<section id="discussion"><p>kept words</p></section>', "related": '<section class="related-work"><p>kept words</p></section>', "beside": '<div class="side-by-side"><p>kept words</p></div>',
    "search": '<section id="search"><p>kept words</p></section>', "period": '<div class="notice-period"><p>kept words</p></div>', "label": "<p>one <label>kept words</label> x</p>", "math": "<p>x <math><mi>kept words</mi></math></p>",
    "select": "<select><option>no<p>kept words</p>", "object": "<object data=x>no<p>kept words</p>", "list": "<ul><li>kept words<li>two</ul>", "links": "<ul><li><a href=x>kept words</a></ul>",
}


def _weights(pages):
    counts: Counter = Counter()
    for page in pages:
        counts.update(html.labelled_counts(page))
    return html.weigh(counts)


def _table():
    rows = duckdb.connect().execute(f"select page_id, html, text from read_parquet('{SF}/pages.parquet') join (select page_id, text from ({html.OP2_SQL.replace('from pages', f"from read_parquet('{SF}/pages.parquet')")})) using (page_id)").fetchall()
    return [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]


@pytest.mark.parametrize("element", ["article", "div"])
@pytest.mark.parametrize("name", KEPT)
def test_text_of_the_article_stays(name, element):
    page = f"{HEAD}{NAV}<{element}><h1>Title here</h1><p>First words of it.</p>{KEPT[name]}<p>Then the last words.</p></{element}><footer>foot note</footer></body></html>"
    for weights in ({}, _weights([h for _, h, _ in _table()[0]])):
        text = html.main_text(page, weights)
        assert text.startswith("Title here") and text.endswith("last words.") and "kept words" in text and "no" not in text.split()


def test_held_back_pages_without_the_article_element():
    learned, held = _table()
    weights = _weights([h for _, h, _ in learned])
    assert held and all(html.main_text(h.replace("<article", "<div").replace("</article", "</div"), weights) == text for _, h, text in held)


def test_the_labels_decide():
    page = '<body><div class="zq">several words of one box</div>{}<p>the words of the other part</p>{}</body>'
    plain = page.format("<div>", "</div>")
    outside, inside = _weights([page.format("<article>", "</article>")]), _weights(['<body><article><div class="zq">several words of one box</div></article><p>the words of the other part</p></body>'])
    assert html.main_text(plain, {}).startswith("several") and html.main_text(plain, inside).startswith("several")
    assert outside["class=zq"] < 0 < inside["class=zq"] and html.main_text(plain, outside) == "the words of the other part"


def test_a_page_of_open_elements_takes_linear_time():
    assert html.main_text("<div>" * 50_000 + "some words" + "</section>" * 50_000, {}) == "some words"


def test_best_run_is_the_maximum():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        a, b = html.best_run(scores)
        assert sum(scores[a:b]) == max([0.0, *(sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2))])


def test_whole_table(spark):
    from __spark_entry__ import queries

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    got = sorted(tuple(r) for r in queries()["op2_html_extraction"](spark, SF).select("page_id", "text", "n_chars").collect())
    assert got == sorted(con.execute(f"select page_id, text, n_chars from ({html.OP2_SQL})").fetchall())


def test_odd_rows(spark):
    long_page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", FORMS["article"][0]), (3, "u", long_page), (3, "u", long_page)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in html.extract(df).collect()}
    assert got == {(1, "u"): "", (2, None): "", (None, "u"): FORMS["article"][1], (3, "u"): "\n\n".join(["some words here"] * 20_000)}
    assert html.extract(df).count() == 5 and html.extract(df.where("false")).count() == 0
