"""Pages whose text must come out whole."""

import pytest

from seqloom.llm.html_extract import main_text


def para(k, times=1):
    return f"<p>Paragraph {k} of a text, with commas, and a few words more.</p>" * times


def lines(*ks):
    return "\n".join(f"Paragraph {k} of a text, with commas, and a few words more." for k in ks)


@pytest.mark.parametrize("kind", ["id=a", "class=intro"])
def test_all_sections_are_kept(kind):
    assert main_text(f"<body><div id=content><section {kind}>{para(1)}</section><section id=b>{para(2, 2)}</section></div></body>") == lines(1, 2, 2)


def test_all_articles_and_the_lead_are_kept():
    assert main_text(f"<article id=post-1>{para(1)}</article><article id=post-2>{para(2, 2)}</article>") == lines(1, 2, 2)
    assert main_text(f"<main><h1>Head</h1><p>Lead.</p><article>{para(1)}</article></main>") == "Head\nLead.\n" + lines(1)


def test_links_in_the_content_are_kept():
    assert main_text(f"<article>{para(1)}<ul><li><a href=x>A link</a></li></ul></article>") == lines(1) + "\nA link"
    assert main_text(f"<body><div id=c>{para(1)}<p><a href=x>A link</a></p></div></body>") == lines(1) + "\nA link"


@pytest.mark.parametrize("box", ['class="container with-sidebar"', 'class="sidebar-layout"', "id=page class=has-navbar", 'class="menu"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_no_word_drops_the_page(box, inner):
    assert main_text(f"<body><div {box}><{inner}>{para(1)}</{inner}></div></body>") == lines(1)


@pytest.mark.parametrize("kind", ["id=discussion", "class=legal", "class=search", "class=notice", "class=tags"])
def test_topics_stay_in_an_article(kind):
    assert main_text(f"<article>{para(1, 3)}<section {kind}>{para(2)}</section><div class=advert>Buy!</div></article>") == lines(1, 1, 1, 2)


def test_words_still_tell_what_is_apart():
    assert main_text(f"<article>{para(1)}</article><div class=sidebar><article>Teaser.</article></div><div class=comments>{para(3, 9)}</div>") == lines(1)


def test_head_ends_without_its_end_tag():
    assert main_text(f"<html><head><title>T</title><meta charset=x><body>{para(1)}</body></html>") == lines(1)
    assert main_text(f"<html><head><title>T</title>{para(1)}</html>") == lines(1)


def test_words_alone_leave_no_page_empty():
    assert main_text("<body><div class=sidebar>One.</div><div class=footer>Two.</div></body>") == "One.\nTwo."
