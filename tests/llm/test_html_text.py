"""op8: pages with known articles, awkward markup, and the table's own article elements."""

import html
import re

import pytest

from knitwork.llm.html_text import extract_pages, main_text

SF = "/root/testdata/sf0.01"
BODY = [f"Paragraph {i} has a good number of ordinary words in it, as paragraphs of articles have." for i in range(6)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)


def expected(page):
    """For pages of the table: blocks of the article element, cut at block tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == expected(source[r.page_id]), r.page_id


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=post><div id=content>{}</div></div>", "{}", "<table><tr><td>{}</td></tr></table>"])
def test_boilerplate_goes(wrap):
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body class="has-sidebar">
    <header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to make everything better for you and for everybody else.</div>
    <div class="ad">Buy now, the offer ends today, and tomorrow there is another one.</div>
    <form><label>Mail</label><input name=m><button>Send</button></form>
    {wrap.format("<h1>The &amp; title</h1>" + PARAGRAPHS)}
    <section id="comments"><article class="comment"><p>First! This is a fairly long comment by a reader of this page.</p></article></section>
    <aside>About the author, who has written many other things too.</aside><script>var x = "<p>no</p>";</script>
    <footer>&copy; 2020 Site. All rights reserved by the owners of the site.</footer></body></html>"""
    assert main_text(page) == "\n".join(["The & title", *BODY])


def test_awkward_markup():
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == main_text("<script>x") == ""
    assert main_text("just text &lt;b&gt; &eacute;&#x41;") == "just text <b> éA"
    assert main_text("<p>one<p>two<b> bold\n\t three<br>four</p>five") == "one\ntwo bold three four\nfive"
    assert main_text("<article><p>a</article>") == "a"
    assert "text" in main_text("<![bad[ <p>text</p>")
    assert main_text("<div>" * 3000 + "deep") == "deep"
    long = "word " * 40_000
    assert main_text(f"<body><article><p>{long}</p></article></body>") == long.strip()


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "y"), (3, "v", "", None)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (3, "v", "", 0)], key=repr)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
