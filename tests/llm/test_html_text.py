import pytest
from lexivec.llm import html_text as ht

WORDS = "some longer words that make up a paragraph of the article which goes on for a while and then ends here"
PAGE = f"""<!DOCTYPE html><html><head><title>Title &amp; site</title><style>p{{margin:0}}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies for many purposes, and {WORDS}.</p><button>OK</button></div><!-- ad > <p>no</p> -->
<div class="ad">Buy {WORDS} now.</div><form><label>Name</label><input value="x"><textarea>draft</textarea></form>
<article><h1>The&nbsp;heading &lt;1&gt;</h1><p><b>First {WORDS}.<br><p>Short.<p>A   second
 one &eacute;&#233;&#x2014;&amp;amp; with <a href="x">a link</a> and <i>markup</i>in<!-- x -->line.</p><div class="share"><a href="#">Tweet</a></div><ul><li>point one<li>point two</ul>
<script>track()</script><table><tr><td>cell<td>other</table><p>Last {WORDS}.</p><section id="comments"><h2>Comments</h2><article class="comment"><p>I think {WORDS}.</p></article></section></article>
<aside class="sidebar"><h3>Related</h3><p>Another story {WORDS}.</p></aside><footer>&copy; site &middot; all rights</footer></body></html>"""
MAIN = ["The heading <1>", f"First {WORDS}.", "Short.", "A second one éé—&amp; with a link and markupinline.", "point one", "point two", "cell", "other", f"Last {WORDS}."]


@pytest.fixture(scope="module")
def tree(spark):
    return ht.trained_tree(spark)


def test_main_text_of_a_page(tree):
    assert ht.main_text(PAGE, tree).split("\n\n") == MAIN


def test_page_without_article_element(tree):
    page = f"<body><div id='top-menu'><a href=1>One</a> <a href=2>Two</a></div><div id=content><h2>Heading words here</h2><p>{WORDS}<p>{WORDS} again</div><div class=footer>imprint</div>"
    assert ht.main_text(page, tree) == f"Heading words here\n\n{WORDS}\n\n{WORDS} again"


def test_story_beside_small_articles(tree):
    cards = "".join(f"<article class=card><h3><a href={k}>Another headline number {k}</a></h3><p>A short teaser of story {k} in a few words only.</p></article>" for k in range(4))
    story = ["Heading of the story here", f"Opening {WORDS}, and so {WORDS}.", "In between", f"Then {WORDS}, and so {WORDS}.", f"Last {WORDS}, as {WORDS}."]
    content = f"<div id=content><h1>{story[0]}</h1><p>{story[1]}</p><h2>{story[2]}</h2><p>{story[3]}</p><p>{story[4]}</p></div>"
    nav = "<nav><a href=1>Home</a></nav>"
    assert ht.main_text(f"<body>{nav}{content}{cards}</body>", tree).split("\n\n") == story
    assert ht.main_text(f"<body>{nav}{cards}{content}</body>", tree).split("\n\n") == story


def test_standfirst_before_the_article(tree):
    inside = "".join(f"<p>Part {k} {WORDS}, and so {WORDS}.</p>" for k in range(6))
    lead = f"In short {WORDS}."
    page = f"<body><nav><a href=1>Home</a></nav><p>{lead}</p><article><h1>The heading of it all</h1>{inside}</article><p>Imprint and <a href=2>more links</a></p></body>"
    assert ht.main_text(page, tree).split("\n\n") == [lead, "The heading of it all", *(f"Part {k} {WORDS}, and so {WORDS}." for k in range(6))]


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("<", "<"), ("a < b and c > d", "a < b and c > d"), ("<p>x<p", "x"), ("<article><p>one<!-- open", "one"), ("<article><p title=\"a>b\">in</p><p title='q>in2</p>", "in\n\nin2"),
    ("<article>&#0;&#55296;&notareal; &amp</article>", "��¬areal; &"), ("<article><p>a</div>b</p></article>", "a\n\nb"), ("<article><![CDATA[raw & x]]> y</article>", "raw & x y"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
])
def test_broken_markup(tree, page, text):
    assert ht.main_text(page, tree) == text


def test_long_and_hostile_pages_take_linear_time(tree):
    for page in ("<" * 200_000, "<a " * 50_000, "<p title=\"" * 20_000, "<!--" * 50_000, "<article>" + "<div>" * 3000 + "x", "<article><p>" + "w " * 300_000):
        ht.main_text(page, tree)


def test_queries_keep_all_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, None, "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, ht.extract(pages).collect()), key=str)
    text = "\n\n".join(MAIN)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert ht.extract(pages.where("false")).count() == 0


def test_test_pages_keep_their_articles(spark, tree):
    import re
    from conftest import SF001
    for r in spark.read.parquet(f"{SF001}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(re.sub(r"<[^>]*>", " ", p).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        import html
        assert ht.main_text(r["html"], tree) == "\n\n".join(html.unescape(p) for p in parts if p)
