import re

import pytest
from pyspark.sql import types as T

from lumenset.llm.article import article_text, extract_articles

PARAGRAPHS = ["The first paragraph has a good number of words in it, as articles do.", "A second one &amp; more: caf&eacute;&nbsp;&#8364;5 for everybody who reads.",
              "The third closes the story with a few more words and a full stop."]
TEXT = "The first paragraph has a good number of words in it, as articles do. A second one & more: café €5 for everybody who reads. The third closes the story with a few more words and a full stop."
STORY = "".join(f"<p>{p}</p>\n" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("  \n ", ""), ("plain  text", "plain text"), ("<nav><a href=x>menu</a></nav>", ""),
        (f"<html><body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><article><h1>Title</h1>{STORY}</article><footer>f</footer></body></html>", f"Title {TEXT}"),
        # no article element: density alone
        (f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a> <a href=4>Four</a></div><div><div>{STORY}</div></div></body>", TEXT),
        # boilerplate by class, id and role
        (f"<div class='cookie-notice'><p>We use cookies on this site, as many sites do today.</p></div><main>{STORY}</main><div id=sidebar><p>Other stories you may want to read one day.</p></div>"
         "<section class=\"comments-list\"><p>I disagree with all of this, and here is why, at length.</p></section><div role=complementary>x</div>", TEXT),
        (f"<aside>aside</aside><div class=adBanner>Buy this now</div><article>{STORY}<form><label>Mail</label><input></form><div class='share'>Share</div></article>", TEXT),
        # scripts, styles, comments, unclosed tags
        (f"<style>p{{}}</style><script>var a = '<p>no</p>';</script><!-- <p>no</p> --><article><p><b>Bold and open<br><p>{PARAGRAPHS[0]}<p>{PARAGRAPHS[2]}</article>",
         f"Bold and open {PARAGRAPHS[0]} {PARAGRAPHS[2]}"),
        ("<article><p>Hel<b>lo</b> wor<i>ld</i>, this is   one\n block.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>",
         "Hello world, this is one block. one two a b c"),
        ("<p>a < b and <3 c", "a < b and <3 c"), ("<p title='>'>x</p><p title=\"unclosed>y</p>", "x y"),
    ],
)
def test_pages(page, want):
    assert article_text(None if page is None else page.encode()) == want


def paragraphs(n, size, word):
    return " ".join(f"<p>{i} {(word + ' ') * (size // (len(word) + 1))}</p>" for i in range(n))


MENU = "<nav><a href=1>One</a> <a href=2>Two</a></nav>"
HEAD, LEAD = "<h1>A title of thirty characters</h1>", paragraphs(1, 200, "lead")
LONG, SHORT = paragraphs(10, 200, "long"), paragraphs(3, 90, "short")


@pytest.mark.parametrize(
    "before, article, after",
    [
        (f"<body>{MENU}<article>", f"{HEAD}<section>{LONG}</section><section>{SHORT}</section>", "</article></body>"),
        (f"<body>{MENU}<article>", f"{HEAD}{LEAD}<div>{LONG}</div>", "</article></body>"),
        (f"<body>{MENU}<main>", f"{HEAD}<div>{LONG}</div><div>{SHORT}</div>", "</main></body>"),
        ("<body><main><article>", f"{HEAD}<div>{LONG}</div></article><article>{HEAD}<div>{LONG}</div>{SHORT}", "</article></main></body>"),
        # neither article nor main
        ("<body><div>", f"{HEAD}{LEAD}<div>{LONG}</div>", f"</div>{MENU}</body>"),
        ("<body>", f"{HEAD}<div>{LONG}</div><div>{paragraphs(8, 200, 'more')}</div>", "</body>"),
    ],
)
def test_articles_come_whole(before, article, after):
    want = " ".join(re.sub(r"<[^>]*>", " ", article).split())
    assert article_text((before + article + after).encode()) == want


SIDE = f"<div class='sidebar'><p>Other stories.</p>{MENU}</div>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "sidebar", "widget-container", "overlay"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_with_names_of_boilerplate(name, tag):
    want = " ".join(re.sub(r"<[^>]*>", " ", HEAD + LONG).split())
    assert article_text(f"<body>{MENU}<div class='{name}'><{tag}>{HEAD}{LONG}</{tag}>{SIDE}</div></body>".encode()) == want
    if name.count("-"):  # no article element, but most of the text
        assert article_text(f"<body>{MENU}<div class='{name}'><div>{HEAD}{LONG}</div>{SIDE}</div></body>".encode()) == want


def test_article_parts_with_names_of_boilerplate():
    parts = (f"{HEAD}{LONG}<h2 id='related-work'>Related work</h2>{LEAD}<h2 id='social-effects'>Social effects</h2>{LEAD}"
             f"<p class='notice-period'>Three months.</p><section id='discussion'><h2>Discussion</h2>{SHORT}</section>")
    rest = (f"<div class='share-buttons'>Share</div><div class='related-posts'><ul><li><a href=x>Another story</a></ul></div><h2 id='comments'>Comments</h2>"
            f"<section class='comments-list'><article>{paragraphs(30, 200, 'comment')}</article></section>")
    want = " ".join(re.sub(r"<[^>]*>", " ", parts).split())
    assert article_text(f"<body><article>{parts}{rest}</article></body>".encode()) == want
    # comments that hold most of the text, in articles of their own
    page = f"<body><article>{HEAD}{LEAD}</article><div id='comments'><article>{paragraphs(30, 200, 'comment')}</article></div></body>"
    assert article_text(page.encode()) == " ".join(re.sub(r"<[^>]*>", " ", HEAD + LEAD).split())


def test_paragraphs_in_blocks_named_widgets():
    blocks = [f"<div class='elementor-widget elementor-widget-text-editor'>{paragraphs(1, 200, w)}</div>" for w in ("one", "two", "three")]
    want = " ".join(re.sub(r"<[^>]*>", " ", " ".join(blocks)).split())
    assert article_text(f"<body>{MENU}{' '.join(blocks)}</body>".encode()) == want


def test_very_long_and_very_deep_pages():
    assert article_text(("<p>" + "word " * 300_000).encode()).count(" ") == 299_999
    assert article_text(("<div>" * 5000 + STORY + "</div>" * 5000).encode()) == TEXT
    assert article_text(b"<" * 20_000 + b"x") is not None
    assert article_text(b"<a" + b" x='" * 20_000) is not None


def test_rows_and_columns(spark):
    kinds = T.StructType([T.StructField(n, T.StringType() if n != "page_id" else T.LongType()) for n in ("page_id", "url", "html", "text", "_id", "dotted.name")])
    data = [(1, "u", f"<article>{STORY}</article>", "clash", "i", "d"), (2, None, None, "clash", "i", "d"), (None, "v", "", "clash", None, "d"), (2, None, None, "clash", "i", "d")]
    out = extract_articles(spark.createDataFrame(data, kinds))
    assert out.columns == ["page_id", "url", "_id", "dotted.name", "text", "n_chars"]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out.collect()), key=str) == sorted(
        [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0), (2, None, "", 0)], key=str
    )
    assert extract_articles(spark.createDataFrame([], kinds)).count() == 0


def test_given_pages(spark, sf_dir):
    """The given pages mark their article; its text is what must come out."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_articles(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)
