"""Blocks of web pages: what names of elements say, odd markup of any length, repeats against brute force."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tradegrain.llm import html_text


def kept(page: str) -> list[str]:
    return [text for state, text in html_text.blocks(page) if state != html_text.DROP]


@pytest.mark.parametrize(
    "attribute",
    [
        "class='comment-body'",
        "class='comment-list'",
        "id='disqus_thread'",
        "class=promo-box",
        "class='x newsletter-signup'",
        "class='related-posts'",
        "class='share-buttons'",
        "id=CommentSection",
        "role=complementary",
    ],
)
def test_chrome_inside_an_article_goes(attribute):
    assert kept(f"<article><p>yes</p><div {attribute}>gone</div><p>too</p></article>") == ["yes", "too"]


@pytest.mark.parametrize("name", ["site-footer", "page-header", "mainHeader", "cookie-bar", "top-nav"])
def test_chrome_beside_the_text_goes(name):
    assert kept(f"<div class='{name}'>gone</div><p>yes</p>") == ["yes"]


def test_names_that_only_look_like_chrome():
    page = (
        "<body class='has-sidebar no-comments'><article class='post tag-ads category-social'><header class=entry-header>"
        "<h1>T</h1></header><pre><span class=comment># c</span> x</pre><div class=footnotes>n</div></article>"
    )
    assert kept(page) == ["T", "# c x", "n"]


def test_articles_beside_a_main_element_are_not_main():
    page = "<article>first</article><main><p>yes</p></main><article>other</article>"
    assert [t for s, t in html_text.blocks(page) if s == html_text.KEEP] == ["yes"]
    assert [t for s, t in html_text.blocks("<main></main><article>a</article>") if s == html_text.KEEP] == ["a"]


def test_stray_marks_are_text():
    assert kept("<p>a < b, 1<2 and c <d") == ["a < b, 1<2 and c <d"]
    assert kept("<p title='x > y'>in</p><p title=\"'>\">out</p>") == ["in", "out"]


@pytest.mark.parametrize(
    "page",
    [
        lambda n: '<a "' * (n // 4),
        lambda n: '<a "' * (n // 4) + ">",
        lambda n: '<a x=">" ' * (n // 8),
        lambda n: "<a x=\"> <b y='" * (n // 14),
        lambda n: "<div>" * (n // 10) + "</p>" * (n // 10),
        lambda n: "<p><td>" + "<b>" * (n // 12) + "<h1></h1>" * (n // 12),
        lambda n: "<ul>" * (n // 9) + "</li>" * (n // 10),
        lambda n: "<" * n,
        lambda n: "<!--" * (n // 4),
    ],
)
def test_time_grows_with_the_page(page):
    began = time.process_time()
    html_text.blocks(page(1_000_000))
    assert time.process_time() - began < 10  # quadratic parsing takes many minutes


def test_covered_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        streams = [list(rng.integers(0, 2 + trial % 4, rng.integers(0, 40))) for _ in range(6)]
        named = rng.integers(0, 4, 6)  # rows of one page are one page
        ids = np.array([w for i, s in enumerate(streams) for w in [*s, -1 - i]], dtype=np.int64)
        page = np.repeat(named, [len(s) + 1 for s in streams])
        pages_of: dict[tuple, set] = {}
        for i in range(len(ids) - 7):
            pages_of.setdefault(tuple(ids[i : i + 8]), set()).add(page[i])
        expected = np.zeros(len(ids), dtype=bool)
        for i in range(len(ids) - 7):
            if len(pages_of[tuple(ids[i : i + 8])]) > 1:
                expected[i : i + 8] = True
        assert (html_text.covered(ids, page) == expected).all()
