"""Words of class and id, and forms, against articles they stand around."""

from __future__ import annotations

import pytest

from loomwright.llm.html_text import main_text

LINES = [f"Paragraph {k}, with some words; and more of them, to be long enough." for k in range(8)]
ARTICLE = "<h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in LINES)
TEXT = " ".join(["Title here", *LINES])
PAGE = '<html><body><nav><a href="/">Home</a></nav>{}<footer>Foot</footer></body></html>'


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="container no-sidebar">{}</div>', '<div class="layout has-sidebar"><main>{}</main><div class="sidebar">Side text.</div></div>', '<form id="aspnetForm" action="/">{}</form>', '<div id="search-engines-explained">{}</div>',
        '<article class="post related-tag">{}</article>', '<article id="comments-policy">{}</article>', '<div class="sidebar-right">{}</div>', '<div class="page-header"><form>{}</form></div>', '<div class="modal"><div class="widget">{}<div class="widget">Side.</div></div></div>',
    ],
)
def test_a_wrapper_never_takes_its_article_away(wrapper):
    assert main_text(PAGE.format(wrapper.format(ARTICLE))) == TEXT


def test_what_only_sounds_like_a_mark_is_kept_and_marks_are_dropped():
    inside = '<div class="social-science"><p>' + "Of social science. " * 30 + "</p></div>"
    marks = "".join(f'<div class="{c}"><p>' + "Not of the article, at all. " * 9 + "</p></div>" for c in ("comment-list", "share buttons", "site-footer", "ad", "related posts", "cookie_notice"))
    text = main_text(PAGE.format(f"<article>{ARTICLE}{inside}{marks}</article>"))
    assert text == f"{TEXT} {' '.join(['Of social science.'] * 30)}"


def test_more_comments_than_article():
    comments = '<div class="comments">' + "".join(f"<p>Comment {k}, of a reader, on and on.</p>" for k in range(60)) + "</div>"
    assert main_text(PAGE.format(f'<div class="post">{ARTICLE}</div>{comments}')) == TEXT


def test_marks_within_a_void_mark_still_count():
    assert main_text(PAGE.format(f'<form><div class="post">{ARTICLE}</div><div class="comments"><p>Of a reader, this.</p></div><nav>Menu</nav></form>')) == TEXT


def test_a_page_of_marks_alone():
    assert main_text('<body><nav>Menu</nav><div hidden>Lost text, here.</div></body>') == ""
