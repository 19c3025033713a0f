import re
from html import unescape

import pytest

from nitscope.llm import html

MODEL = html.learn()

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- ad <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>Head &amp; line</h1><p>First  para
graph<b>bold</b> &lt;x&gt;.<br>Next line<p>Second <a href='#'>linked</a> one.</p>{}<p>Z.</p></article>
<aside class="sidebar"><p>Side bar</p></aside><section id="comments"><h2>Comments</h2><p>Nice article!</p></section>
<footer>&copy; 2020</footer></body></html>"""
WANT = "Head & line\nFirst para graphbold <x>. Next line\nSecond linked one.\n{}Z."


def test_article_without_surroundings():
    assert html.main_text(PAGE.format(""), MODEL) == WANT.format("")


def test_what_stands_amid_the_article_goes():
    for extra in ("<div class='advert'>Buy this</div>", "<form><label>Mail</label><input><button>Go</button></form>", "<aside>See also that</aside>", "<div class='comments'><p>I like it very much indeed, thanks</p></div>", "<script>x()</script><style>y</style>", "<div class='newsletter-signup'><p>Sign up</p></div>", "<nav><a href='#'>Next</a></nav>"):
        assert html.main_text(PAGE.format(extra), MODEL) == WANT.format(""), extra


def test_lists_quotes_and_headings_stay():
    extra = "<h2>Two</h2><ul><li>One item</li><li>Other</ul><blockquote>Said so</blockquote><pre>a  =\n1</pre><div>Loose</div>"
    assert html.main_text(PAGE.format(extra), MODEL) == WANT.format("Two\nOne item\nOther\nSaid so\na = 1\nLoose\n")


def test_layouts_without_article():
    for tag, name in (("main", ""), ("div", ' id="content"'), ("div", ' class="post-body"'), ("div", "")):
        page = PAGE.replace("<article>", f"<{tag}{name}>").replace("</article>", f"</{tag}>").format("")
        assert html.main_text(page, MODEL) == WANT.format(""), (tag, name)


def test_awkward_pages():
    for page in (None, "", " ", "<", "<p", "<p>", "</p>", "<!-- x", "<script>x", "&amp", "<nav>a</nav>", "<a b=\"c>d", "<" * 5000, "<div>" * 5000):
        assert isinstance(html.main_text(page, MODEL), str)
    assert html.main_text("<article><p>One &am", MODEL) == "One &am"
    assert html.main_text("<article><p>One</p><p", MODEL) == "One"
    assert html.main_text("<article><p>" + "word " * 100_000, MODEL) == " ".join(["word"] * 100_000)


def test_region_is_the_best_of_all():
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.randint(-4, 4) for _ in range(rnd.randint(0, 12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])


def test_query_on_real_pages_is_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.main_text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"<[^>]*\Z", "", r.html.split("<article>")[1].split("</article>")[0])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if False else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x")], "page_id long, html string, n_chars string")
    assert [tuple(r) for r in html.extract(df).collect()] == [(1, "", 0)] * 2
    assert html.extract(df.limit(0)).count() == 0


AROUND = [
    "<aside class='sidebar'><h3>Popular</h3><ul><li><a href='#'>One</a></li></ul></aside>",
    "<div class='sidebar-widget'><h4>About</h4><p>We write things.</p></div>",
    "<section class='related-articles'><h2>Related</h2><ul><li>Other story</li></ul></section>",
    "<div class='cookie-banner'><p>We use cookies.</p><button>OK</button></div>",
    "<div role='navigation'><a href='/'>Home</a> <a href='/b'>Blog</a></div>",
    "<div id='comments'><h3>2 comments</h3><div class='comment'><p class='author'>Bob</p><p>Great post, thanks.</p></div></div>",
    "<section class='comments'><article class='comment'><p>Nice one.</p></article></section>",
    "<form><div>Email</div><input><p>We never share it.</p></form>",
    "<footer><p>All rights reserved</p></footer>",
    "<div class='sponsored'><h3>Sponsored</h3><p>Paid words</p></div>",
    "<div style='display:none'><p>Hidden</p></div>",
    "<fieldset><legend>Form</legend></fieldset>",
]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div class='post'>{}</div></main>", "<div class='content'>{}</div>", "<div>{}</div>"])
def test_surroundings_of_every_kind_go(frame):
    for extra in AROUND:
        for before, inside, after in ((extra, "", ""), ("", extra, ""), ("", "", extra)):
            page = f"<html><body class='has-sidebar'>{before}{frame.format(f'<h1>Head</h1><p>First para.</p>{inside}<p>Second <a>one</a>.</p>')}{after}</body></html>"
            assert html.main_text(page, MODEL) == "Head\nFirst para.\nSecond one.", extra


def test_head_without_end_tag():
    for first in ("<body>", "", "<a href='/'></a>"):
        page = PAGE.replace("</head><body>", first).format("")
        assert html.main_text(page, MODEL) == WANT.format(""), first


def test_long_attribute_values_hold_markup():
    for quote, value in (('"', "<p>no</p>'" * 2000), ("'", '{"a": "<b>no</b>"}' * 2000)):
        page = PAGE.format(f"<div data-x={quote}{value}{quote}>Loose</div><script data-y={quote}{value}{quote}>no()</script>")
        assert html.main_text(page, MODEL) == WANT.format("Loose\n")


UNSEEN = """<html><body><div class='zq7'><ul><li><a href='/'>Ab</a></li><li><a href='/c'>Cd</a></li></ul></div>
<div class='vv'><h1>Title of it</h1><p>{}</p><p>Second paragraph here.</p></div>
<div class='kx'><div><p>Some words here</p></div><p>More of them</p></div></body></html>"""


def test_scan_decides_where_names_say_nothing():
    page = UNSEEN.format("word " * 40)
    want = "Title of it\n" + "word " * 39 + "word\nSecond paragraph here."
    assert html.main_text(page, MODEL) == want
    by_words_alone = [b.text for b in html.read(page) if html.word_score(b.features, MODEL) > 0]
    assert len(by_words_alone) > 3 and "\n".join(by_words_alone) != want


def test_short_parts_of_an_article_stay():
    inner = "<p>Kicker</p><h1>Title</h1><section><h2>One</h2><p>Few words</p></section><section><h2>Two</h2><div><p>{0}</p><p>{0}</p></div></section><div class='zq'>Ef</div><p>Gh</p>"
    for frame, words in (("<article>{}</article>", "Ab"), ("<main><div>{}</div></main>", "Ab"), ("<div class='content'>{}</div>", "Ab cd ef gh ij")):
        page = f"<html><body><nav><a href='/'>Home</a></nav>{frame.format(inner.format(words))}<footer>End</footer></body></html>"
        assert html.main_text(page, MODEL) == f"Kicker\nTitle\nOne\nFew words\nTwo\n{words}\n{words}\nEf\nGh", frame


def test_weights_have_the_signs_of_the_method():
    assert all(w < 0 for w in MODEL["tag"].values())
    assert all(0 <= html.word_score(frozenset(f), MODEL) <= 1 for f in ((), ("<p>",), ("<nav>", "links"), ("unheard of",)))
    assert MODEL["tag"]["/div*"] < -1 and MODEL["tag"]["/ul*"] > -1


def test_query_on_a_made_table(spark, tmp_path):
    from nitscope.llm import queries

    rows = [(1, "u", PAGE.format("")), (1, "u", PAGE.format("")), (None, None, None), (3, "v", "<article><p>Ab</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op9_html(spark, str(tmp_path)).collect()), key=str)
    first = WANT.format("")
    assert got == sorted([(1, "u", first, len(first))] * 2 + [(None, None, "", 0), (3, "v", "Ab", 2)], key=str)


def test_depth_costs_nothing():
    import time

    start = time.perf_counter()
    for page in ("<div>a" * 50_000, "<div>" * 100_000 + "a", "<p>a</p>" * 50_000, "<ul><li>" * 50_000, "</div>" * 100_000):
        assert isinstance(html.main_text(page, MODEL), str)
    assert time.perf_counter() - start < 30
