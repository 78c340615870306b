"""Line-block extraction: ranges against a brute-force reading of the rule, unmarked and short articles, link lists, headers."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import html_text as H


def brute_ranges(m):
    """The rule of ``ranges_of`` word for word, one line at a time."""
    n, found, taken = len(m), [], 0

    def rise(i):
        total = 0
        for k in range(i, min(n, i + H.WINDOW)):
            if m[k] <= 0:
                return total
            total += m[k]
        return total

    bar = min(H.SURGE, H.SHARE * max([rise(i) for i in range(n)], default=0))
    for i in range(n):
        if i >= taken and m[i] > 0 and rise(i) >= bar:
            foot = min(k for k in range(taken, i + 1) if all(x > 0 for x in m[k : i + 1]))
            taken = next((e for e in range(i + 1, n) if m[e] <= 0 and sum(m[e : e + H.WINDOW]) <= 0), n)
            found.append((foot, taken))
    return found


def test_ranges_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        m = [int(x) for x in rng.integers(-120, 160, rng.integers(0, 25))]
        assert H.ranges_of(m) == brute_ranges(m), m


MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(6)) + "</ul>"
LONG = "A paragraph that is long enough to be told from the menus and notices around it by its length alone."


def test_distribution_decides_where_nothing_is_marked():
    page = f"<body><div>My site</div>{MENU}<div><h2>Title</h2><div>{LONG}</div><div>Short end.</div></div><div><h3>Read more</h3>{MENU}</div><div>About us</div></body>"
    assert H.main_text(page) == f"Title\n{LONG}\nShort end."
    lines = H.lines_of(page)
    assert {"My site", "Read more", "About us"} <= {x.text for x in lines if not x.junk}  # no tag or name tells them


def test_short_and_unmarked_articles_stay():
    assert H.main_text(f"<body>{MENU}<p>Only a few words.</p>{MENU}</body>") == "Only a few words."
    assert H.main_text(f"<body>{MENU}<article><p>Tiny.</p></article><footer>{LONG}</footer></body>") == "Tiny."
    assert H.main_text(f"<body>{MENU}</body>") == ""
    assert H.main_text(f"<p>{LONG}</p><div class='ad'>{LONG[:40]}</div><p>And on it goes.</p><p>{LONG}</p>") == f"{LONG}\nAnd on it goes.\n{LONG}"


def test_parts_inside_an_article():
    page = f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>{LONG}</aside><p><a href='x'>All linked</a></p><p>End.</p><div class='user-comments'><p>{LONG}</p></div></article><div>{LONG}</div>"
    assert H.main_text(page) == f"Title\n{LONG}\nAll linked\nEnd."
    assert H.main_text(f'<article><div class="entry-header header"><h1>Title</h1></div><p>{LONG}</p></article>') == f"Title\n{LONG}"
    assert H.main_text(f'<div class="site-header"><p>{LONG}</p></div><p>{LONG}</p>') == LONG
    assert H.main_text(f'<main><div class="search-results"><p>Found {LONG}</p></div></main>') == f"Found {LONG}"
    for name in ("ad", "site-footer", "cookie-notice", "comment-list", "share-buttons", "related_posts", "sidebar", "newsletter-form"):
        assert H.main_text(f'<article><p>{LONG}</p><div class="x {name}"><p>{LONG}</p></div></article>') == LONG, name
    for name in ("header-free", "readable", "adventure", "sharepoint-guide", "navigator-story"):
        assert H.main_text(f'<article><div class="{name}"><p>{LONG}</p></div></article>') == LONG, name


def test_a_long_text_beats_a_teaser_and_comments_go():
    text = "Some words of a long text. " * 28
    assert text.strip() in H.main_text(f"<article>teaser one</article><div><p>{text}</p></div>")
    assert H.main_text(f"<article><p>{text}</p></article><div><p>{LONG}</p></div>") == text.strip()
    for head in ("Comments", "3 comments", "Leave a reply", "Kommentare (4)", "Reader comments:"):
        page = f"<article><h1>Title</h1><p>{LONG}</p><h2>{head}</h2><ul><li>Bob: {LONG}</li></ul><h3>More</h3><p>Al: yes</p></article>"
        assert H.main_text(page) == f"Title\n{LONG}", head
        assert H.main_text(page.replace("article", "div")) == f"Title\n{LONG}", head
    assert H.main_text(f"<article><h2>Comments</h2><p>{LONG}</p><h2>Comments on the budget</h2><p>{LONG}</p></article>") == f"Comments on the budget\n{LONG}"


@pytest.mark.parametrize("seed", range(200))
def test_generated_pages(seed):
    """Whole pages made of parts whose fate is known, with and without an article element, named and unnamed menus."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["alpha", "be", "gamma", "d&amp;e", "épsilon", "zeta."]) for _ in range(n))
    menu = lambda: f"<{r.choice(['ul', 'div'])}>" + "".join(f"<li><a href='/x'>{words(r.randint(1, 4))}</a></li>" for _ in range(r.randint(3, 9))) + "</ul>"
    named = lambda: r.choice([f"<nav>{menu()}</nav>", f"<div class='sidebar'><p>{words(60)}</p></div>", f"<aside>{words(50)}</aside>", f"<form>{words(9)}<input></form>", f"<div class='ad'>{words(12)}</div>", "<script>var x = '<p>no</p>';</script>"])
    blocks = [("h1", words(r.randint(1, 6)))] + [(r.choice(["p", "p", "p", "li", "blockquote"]), words(r.randint(1, 60))) for _ in range(r.randint(1, 7))] + [("p", words(40))]
    inner = "".join(f"<{t}>{b}</{t}>" + (named() if r.random() < 0.3 else "") for t, b in blocks)
    tag = r.choice(["article", "main", "div", "section"])
    page = f"<html><head><title>{words(3)}</title></head><body>{menu()}{named()}<{tag}>{inner}</{tag}>{menu()}<footer>{words(30)}</footer></body></html>"
    want = "\n".join(b.replace("&amp;", "&") for _, b in blocks)
    assert H.main_text(page) == want


def test_the_distribution_drops_unmarked_menus():
    """Pages of sf0.01 without article elements and with menus in plain elements: right by the ranges, and wrong without them."""
    import duckdb

    pages = [h or "" for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    plain = [re.sub(r"<(/?)nav\b[^>]*>", r"<\1div>", re.sub(r"</?(?:article|main)\b[^>]*>", "", p)) for p in pages]
    want = [H.main_text(p) for p in pages]
    assert [H.main_text(p) for p in plain] == want
    every = [[x.text for x in H.readable(H.lines_of(p))] for p in plain]
    menus = [len(x) > len(w.split("\n")) for x, w in zip(every, want) if w]
    assert sum(menus) > 0.9 * len(menus)
