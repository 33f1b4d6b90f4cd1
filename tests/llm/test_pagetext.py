import html

import pytest

from tracekit.llm.pagetext import extract, main_text

ARTICLE = "<p>First, a paragraph of some length; it has words.</p><p>Second one: more words, and more of them.</p>"
TEXT = "First, a paragraph of some length; it has words. Second one: more words, and more of them."


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("   ", ""), ("just text", "just text"), ("a < b and c > d", "a < b and c > d"),
    ("<p>one<p>two", "one two"), ("<b>in</b>line <i>x</i>", "inline x"), ("a<br>b", "a b"), ("&amp;&eacute;&#8217;&nbsp;x", "&é’ x"),
    ("<script>var a = '<p>no</p>';</script><p>yes, text.</p><style>p{}</style>", "yes, text."),
    ("<p>open <b>bold<p>next one</p", "open bold next one"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<!doctype html><title>T</title>", ""),
    (f"<nav><a href='/'>Home</a></nav><article><h1>Title here</h1>{ARTICLE}</article><footer>(c) me, you.</footer>", f"Title here {TEXT}"),
    (f"<div class='sidebar'><p>Not, this; one.</p></div><div id='c'>{ARTICLE}</div><div class='comments'><p>I agree, fully.</p></div>", TEXT),
    (f"<ul><li><a href='a'>One</a></li><li><a href='b'>Two</a></li></ul><div>{ARTICLE}</div>", TEXT),
    (f"<header><p>Site, name.</p></header><main>{ARTICLE}<ul><li>item</li></ul><form><p>Name:</p></form></main>", f"{TEXT} item"),
    (f"<main>{ARTICLE}<div class='cookie-notice'>We use, cookies.</div><aside>More, here.</aside></main>", TEXT),
    (f"<div hidden><p>Hidden, text.</p></div><div>{ARTICLE}</div>", TEXT),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_column_names_null_and_long_pages(spark):
    long = "<article>" + "<p>word, word.</p>" * 20000
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a</p>", "y"), (2, "<p>a</p>", "y"), (3, long, None)], "page_id long, html string, text string")
    got = extract(df).orderBy("page_id").collect()
    assert [r.text for r in got] == ["x", "y", "y", None] and [r.text_ for r in got[:3]] == ["", "a", "a"]
    assert len(got[3].text_) == 20000 * 12 - 1
    assert extract(df.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    for r in extract(pages).collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        words = body.replace("<br>", " ").replace("<p>", " ").replace("</p>", " ").replace("<h1>", " ").replace("</h1>", " ").replace("<b>", "").replace("</b>", "")
        assert r.text.split() == html.unescape(words).split()


@pytest.mark.parametrize("page", [
    f"<div class='content has-sidebar'>{ARTICLE}</div>", f"<div id='top'>{ARTICLE}</div>", f"<div class='elementor-widget-container'>{ARTICLE}</div>",
    f"<div class='social-post'>{ARTICLE}</div>", f"<form action='/'><div>{ARTICLE}</div></form>", f"<div class='widget'><article>{ARTICLE}</article></div>",
    f"<div id='top'><div class='sidebar'><p>Not, this; one.</p></div><article>{ARTICLE}</article></div>",
    f"<form><div>{ARTICLE}</div><div class='widget-area'><p>Not, this.</p></div><ol class='comments'><li>{'I agree, fully; yes. ' * 40}</li></ol></form>",
    f"<main>{ARTICLE}</main><div class='related'><article><p>Another, text.</p></article></div>",
    f"<header class='site-header'><p>Site, name.</p></header><div class='wrapper' role='form'>{ARTICLE}</div>",
])
def test_marks_do_not_take_the_article(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("tag", ["pre", "blockquote", "p class='lead'"])
def test_paragraphs_beside_a_long_block(tag):
    paragraphs = [f"Paragraph {i}, with words; " + "some more of them " * 9 + "end." for i in range(8)]
    long = "A long passage, with words. " * 75
    texts = [*paragraphs[:4], long.strip(), *paragraphs[4:]]
    tags = ["p"] * 4 + [tag] + ["p"] * 4
    inner = "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in zip(tags, texts))
    page = f"<ul><li><a href='a'>One</a></li></ul><div class='text'><h1>Title</h1>{inner}<p>Bye</p></div><div><p><a href='b'>Terms</a></p></div>"
    assert main_text(page) == " ".join(["Title", *texts, "Bye"])
    assert main_text(f"<body>{inner}</body>") == " ".join(texts)


def test_short_articles_beside_long_ones():
    long, short = "A long passage, with words. " * 75, "A short note, with some words in it; no more than that."
    assert main_text(f"<article><p>{short}</p></article><article><p>{long}</p></article>") == f"{short} {long.strip()}"
