"""Names of class and id by the place of their words, and generated pages whose main text is known."""

import random

import pytest

from strandloom.llm import extraction


@pytest.mark.parametrize("page,want", [
    ('<article class="promotion-review"><p>A review of a promotion, told at length.</p></article>', "A review of a promotion, told at length."),
    ('<article><div class="share-price"><p>The share price rose again today.</p></div><p>More of it.</p></article>', "The share price rose again today.\n\nMore of it."),
    ('<div class="news-header"><h1>Head</h1></div><p>Some text of the news.</p>', "Head\n\nSome text of the news."),
    ("<div>Hello</div>", "Hello"),
    ('<div class="site-header"><p>The site of all sites, since 1999.</p></div><p>Some text of the news.</p>', "Some text of the news."),
    ('<div class="sidebar-left"><p>Something beside the text.</p></div><p>Some text of the news.</p>', "Some text of the news."),
    ('<div id="cookieBanner"><p>We use cookies for all you do.</p></div><main><p>Some text of the news.</p></main>', "Some text of the news."),
    ('<div class="ad-300x250"><p>Buy this now.</p></div><article><p>Some text of the news.</p></article>', "Some text of the news."),
    ('<article><h1>Head</h1><p>Text of the article, which is most of what the page has to say, at some length.</p></article><div><p>Read all of our other news.</p></div>', "Head\n\nText of the article, which is most of what the page has to say, at some length."),
    ('<div><p>The page itself, which is most of what there is to say, at some length.</p><p>And more of it, as it goes on.</p></div><article><p>Another one.</p></article>', "The page itself, which is most of what there is to say, at some length.\n\nAnd more of it, as it goes on.\n\nAnother one."),
    ('<article class="search-engine-story"><p>How search engines came to be, in short.</p></article>', "How search engines came to be, in short."),
    ('<article><div class="comment-thread"><p>I agree with all of it.</p></div><p>The text of it.</p></article>', "The text of it."),
])
def test_names_tell_what_they_end_in(page, want):
    assert extraction.main_text(page) == want


def pages(seed, n):
    """(html, main blocks, other blocks) of pages built of known parts."""
    rng = random.Random(seed)
    words = "river stone market window letter garden engine harvest signal copper winter bridge school paper island".split()
    said = set()

    def text(lo, hi):
        while True:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi))).capitalize() + "."
            if t not in said:
                said.add(t)
                return t

    bad = [("nav", ""), ("div", "class='navbar-main'"), ("aside", ""), ("div", "class='sidebar right'"), ("div", "id=related-posts"), ("div", "class=ad"), ("footer", ""), ("div", "class='site-footer'"), ("form", ""), ("div", "class='cookie-notice'"), ("div", "class='newsletter-signup box'"), ("section", "class='comments-area'"), ("div", "role=complementary"), ("div", "class='social share-links'")]
    wraps = [("article", ""), ("article", "class='post promotion-story'"), ("main", ""), ("main", "class=widget-page"), ("div", "class='entry-content'"), ("div", "id=content"), ("article", "class='search-report'")]
    inner = [("", ""), ("", ""), ("div", ""), ("section", "class='share-price'"), ("blockquote", ""), ("div", "class='story-header'")]
    for _ in range(n):
        said.clear()
        main, other = [], []

        def boiler():
            tag, attr = rng.choice(bad)
            own = [text(1, 3) if rng.random() < 0.6 else text(5, 14) for _ in range(rng.randint(1, 5))]
            other.extend(own)
            kind = rng.choice(["<li><a href='/x'>{}</a></li>", "<p>{}</p>", "<p><a href=x>{}</a></p>"])
            return f"<{tag} {attr}>{'<ul>' if 'li' in kind else ''}{''.join(kind.format(t) for t in own)}{'</ul>' if 'li' in kind else ''}</{tag}>"

        def content():
            tag, attr = rng.choice(inner)
            t = text(6, 40)
            main.append(t)
            return f"<{tag} {attr}><p>{t}</p></{tag}>" if tag else f"<p>{t}</p>"

        before, after = [boiler() for _ in range(rng.randint(0, 3))], None
        tag, attr = rng.choice(wraps)
        head = text(2, 6)
        main.append(head)
        body = [f"<h1>{head}</h1>", *[content() if rng.random() < 0.85 else boiler() for _ in range(rng.randint(2, 12))]]
        after = [boiler() for _ in range(rng.randint(0, 4))]
        yield f"<html><body class='single has-sidebar'>{''.join(before)}<{tag} {attr}>{''.join(body)}</{tag}>{''.join(after)}</body></html>", main, other


def test_generated_pages_come_out_whole():
    hit = kept = known = 0
    for page, main, other in pages(4, 400):
        got = extraction.main_text(page).split("\n\n")
        assert not set(got) - {*main, *other}
        order = [t for t in got if t in main]
        assert order == [t for t in main if t in order]
        hit, kept, known = hit + len(order), kept + len(got), known + len(main)
    precision, recall = hit / kept, hit / known
    print(f"precision {precision:.4f}, recall {recall:.4f}")
    assert precision > 0.99 and recall > 0.99
