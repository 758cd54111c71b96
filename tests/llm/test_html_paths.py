"""Pages that only their tag-path ratios tell apart, whole fragments, odd tables and very deep pages."""

import time

import pytest

from seqloom.llm import html_extract
from seqloom.llm.html_extract import extract, main_text

LONG = "A paragraph of some length, with commas, a colon: and other marks, as prose has them. It goes on for a second sentence, too."


def test_fragments_come_out_whole():
    p = f"<p>{LONG}</p>"
    for kind in ("class=tags-explained", "id=side-effects", "class=cookie-recipe", "id=social-history", 'class="search theory"'):
        assert main_text(f"<article>{p}<section {kind}><p>Short one.</p></section>{p}</article>") == f"{LONG}\nShort one.\n{LONG}"
    assert main_text(f"<article>{p}<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>{p}</article>") == f"{LONG}\nOne\nTwo\n{LONG}"
    assert main_text(f"{p}<table><tr><td>1</td><td>2</td></tr></table>{p}") == f"{LONG}\n1\n2\n{LONG}"
    assert main_text(f"{p}<template><template>a</template>b</template>{p}") == f"{LONG}\n{LONG}"
    assert main_text(f"<article>{p}<div class=ad-slot>Buy, buy!</div><div class=post-comments><p>{LONG}</p></div></article>") == LONG


UNMARKED = {
    "boxes": "<body><div>Home | News | About us</div><div><h2>Head</h2>{t}<p>Short.</p>{t}</div><div>Contact us</div></body>",
    "cells": "<body><table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td><h2>Head</h2>{t}<p>Short.</p>{t}</td><td>Top ten</td></tr></table></body>",
    "wrapped": "<body><div><div><div>Log in</div><div><h2>Head</h2>{t}<p>Short.</p>{t}</div></div><div><ul><li>More</li><li>Less</li></ul></div></div></body>",
    "sections": "<body><section>Shop</section><section class=x><h2>Head</h2>{t}<p>Short.</p>{t}</section><section>All wrongs reserved</section></body>",
}


@pytest.mark.parametrize("kind", UNMARKED)
def test_ratios_choose_on_pages_without_marks(kind, monkeypatch):
    page, want = UNMARKED[kind].replace("{t}", f"<p>{LONG}</p>" * 3), "\n".join(["Head", *[LONG] * 3, "Short.", *[LONG] * 3])
    assert main_text(page) == want
    ratios = html_extract.ratios
    monkeypatch.setattr(html_extract, "ratios", lambda blocks, path: dict.fromkeys(ratios(blocks, path), 1.0))
    assert main_text(page) != want


def test_pages_without_main_text():
    assert main_text("<body><nav><a href=x>Home</a></nav><article></article><footer>Copyright, all of it.</footer></body>") == ""
    assert main_text("<article><p>x</p></article><footer>Copyright, all of it.</footer>") == "x"


def test_evidence_and_ratios_are_weighed():
    # a word against the box of all the text tells nothing; one against a part of it does
    assert main_text(f"<div class=menu><p>{LONG}</p><div class=menu>Home, news, about.</div></div>") == LONG
    assert main_text(f"<article><p>Brief.</p></article><div class=comments>{f'<p>{LONG}</p>' * 200}</div>") == "Brief."
    assert main_text(f"<div id=x><p>{LONG}</p><aside>{LONG}</aside><form>Your name: <input></form></div><footer><p>{LONG}</p></footer>") == LONG
    assert main_text(f"<h3>News</h3><ul><li><a href=a>Other</a></li></ul><h1>Head</h1><div><p>{LONG}</p></div>") == f"Head\n{LONG}"


@pytest.mark.parametrize("page", ["<div>x " * 30_000, "<div><b>" + "<i>" * 30_000 + "</u>" * 30_000 + "x " * 30_000, "<a <a " * 30_000, "<svg>x " * 30_000, "<p><h2>x " * 15_000])
def test_very_deep_pages_take_linear_time(page):
    start = time.time()
    assert main_text(page).count("x") in (0, 15_000, 30_000)
    assert time.time() - start < 5


def test_extract_of_clashing_columns_and_empty_tables(spark):
    rows = [(1, "<p>a.</p>", "old", 5), (1, "<p>a.</p>", "old", 5), (2, None, None, None), (None, "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, TEXT string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "html", "n_chars", "text"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "a."), (1, "a."), (2, "")]
    assert extract(df.limit(0)).count() == 0
