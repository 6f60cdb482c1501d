"""Containers that only a class or a form marks."""

from __future__ import annotations

import pytest

from tessera.llm.html_main import main_text

ONE = "This is the first long paragraph of the article, and it has all of the words that one would want to read in it, such as these."
TWO = "The second paragraph is there to be found by the rules, as it is long and it has many of the stop words that they look for."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE} {TWO}"


@pytest.mark.parametrize("wrap", ["{}", "<article>{}</article>"])
@pytest.mark.parametrize("name", ["layout has-sidebar", "content no-sidebar", "container footer-fixed", "page with-comments", "td-post-content with-banner", "post share-enabled", "ad-free", "menu-open"])
def test_wrappers_with_a_state_keep_their_text(name, wrap):
    page = f"<html><body><div class='{name}'>{wrap.format(BODY)}<div class='sidebar'><p>{ONE}</p></div></div><footer>{ONE}</footer></body></html>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "sidebar-right", "comments", "comment-list", "cookie_banner", "related-posts", "x ad", "nav-links"])
def test_named_containers_go(name):
    assert main_text(f"<html><body>{BODY}<div class='{name}'><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div></body></html>") == TEXT
    assert main_text(f"<html><body><article>{BODY}</article><div class='{name}'><p>{ONE}</p></div></body></html>") == TEXT
    assert main_text(f"<article><p>Short.</p></article><div class='{name}'>{BODY}</div>") == "Short."


def test_a_page_in_one_form_or_named_container_stays():
    assert main_text(f"<body><form action='/'>{BODY}<input type=hidden><div class='comments'><p>{ONE}</p></div></form></body>") == TEXT
    assert main_text(f"<body>{BODY}<form><p>{ONE} {TWO} {ONE}</p></form></body>") == TEXT
    assert main_text(f"<body><div id='promo'>{BODY}</div><p>x</p></body>").startswith(TEXT)


def test_words_inside_a_paragraph_go_without_tearing_it():
    assert main_text(f"<p>{ONE} <span class='ad'>Buy</span> {TWO}</p>") == TEXT


def test_the_two_passes_without_article_elements():
    page = f"<div><div>{BODY}<p>A short line.</p><p>{ONE}</p></div><p><a href='/a'>one</a> <a href='/b'>two</a> <a href='/c'>three</a></p></div>"
    assert main_text(page) == f"{TEXT} A short line. {ONE}"
