"""op8: article text beside awkward names, in link lists and in sibling blocks."""

import pytest

from knitwork.llm.html_text import main_text

BODY = [f"Paragraph {i} has a good number of ordinary words in it, as paragraphs of articles have." for i in range(6)]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
REFERENCES = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"


def page(inner):
    return f'<html><body><nav><a href=/>Home</a></nav>{inner}<div class="site-footer">Owned by someone</div></body></html>'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div id=content>{}</div>"])
def test_link_lists_of_the_article_stay(wrap):
    assert main_text(page(wrap.format(PARAGRAPHS + REFERENCES))) == "\n".join([*BODY, "First source", "Second source"])


@pytest.mark.parametrize("name", ["content has-sidebar", "content-with-sidebar", "article-header", "search-results", "no-nav", "elementor-widget", "sidebar"])
def test_names_that_hold_the_text(name):
    assert main_text(page(f'<div class="{name}">{PARAGRAPHS}</div>')) == "\n".join(BODY)


def test_names_that_say_what_it_is_still_go():
    extra = "".join(f'<div class="{c}">Some words that are not of the article at all.</div>' for c in ("cookie-notice", "left-sidebar", "related-posts", "site-header"))
    assert main_text(page(extra + f"<div id=content>{PARAGRAPHS}</div>")) == "\n".join(BODY)
    assert main_text(page(f'<article><div class="article-header"><h1>Title</h1></div>{PARAGRAPHS}</article>')) == "\n".join(["Title", *BODY])
    comments = "".join(f"<p>{p} {p}</p>" for p in BODY)
    assert main_text(page(f'<div id=content>{PARAGRAPHS}</div><div class="comment-list">{comments}</div>')) == "\n".join(BODY)


@pytest.mark.parametrize("cut", [1, 3, 5])
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_sibling_blocks_stay(tag, cut):
    first, last = ("".join(f"<p>{p}</p>" for p in x) for x in (BODY[:cut], BODY[cut:]))
    assert main_text(page(f"<div id=post><{tag}>{first}</{tag}><{tag}>{last}</{tag}></div>")) == "\n".join(BODY)


def test_equal_sibling_articles_stay():
    one, two = "One article here of some length.", "Another one of the same size too."
    assert main_text(f"<main><article><p>{one}</p></article><article><p>{two}</p></article></main>") == f"{one}\n{two}"


@pytest.mark.parametrize("name", ["ad-free", "banner-less", "cookie-recipes", "share-holders", "menu-engineering"])
def test_names_are_read_whole(name):
    """A paragraph whose class has a word of a menu's or advert's name in it, but isn't one."""
    assert main_text(page(f'<div id=content>{PARAGRAPHS}<p class="{name}">One more paragraph, of that name.</p></div>')) == "\n".join([*BODY, "One more paragraph, of that name."])


@pytest.mark.parametrize("name", ["ad-slot-2", "sidebar-left", "nav-links", "cookie-notice-box", "share-buttons"])
def test_parts_of_names_still_go(name):
    assert main_text(page(f'<div id=content>{PARAGRAPHS}</div><div class="{name}">Words of something else on the page.</div>')) == "\n".join(BODY)


def test_broken_declarations_keep_comments_hidden():
    html = "<body><!-- hidden words --><![if x]><p>First paragraph of the page.</p><!-- more --><p>Second paragraph of the page.</p></body>"
    assert main_text(html) == "First paragraph of the page.\nSecond paragraph of the page."


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.time()
    assert main_text("<div>text of it" * 50_000).count("\n") == 49_999
    assert time.time() - began < 30
