import re
import time

import pytest
from tests.llm.bs_free import plain

from quarry.llm import html_text

BODY = "<p>First long paragraph of the article, with words enough to count.</p><p>Second one, also long enough to be seen as text.</p>"


def test_blocks_references_and_white_space():
    page = f"<body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>one\n  two&nbsp;<b>th</b>ree<br>four<p>x &lt; y &#233;</article></body>"
    assert html_text.main_text(page, None) == "A & B\none two three four\nx < y é"


@pytest.mark.parametrize(
    "noise",
    ["<header>Top</header>", "<footer>Foot</footer>", "<aside>Side</aside>", '<div class="ad">Buy</div>', '<div id="cookie-notice">We use</div>', '<form>Name <input></form>', "<script>var t='</p><p>x';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div class="comments"><p>Nice post</p></div>', '<div class="reader_comment">Hm</div>', "<ul role=navigation><li>x</li></ul>", '<p hidden>no</p>', "<button>Go</button>"],
)
def test_what_is_left_out(noise):
    want = re.sub(r"</?p>", "\n", BODY).strip().replace("\n\n", "\n")
    for page in (f"<html><body>{noise}<article>{BODY}</article>{noise}</body></html>", f"<article>{noise}{BODY}{noise}</article>", f"<div class='content'>{noise}{BODY}"):
        assert html_text.main_text(page, None) == want


LONG = "<p>" + "many words of the body " * 20 + "</p>"


@pytest.mark.parametrize(
    ("page", "holds"),
    [
        (f"<article><h1>Title</h1><p>lead</p><div class=body>{LONG}</div></article>", "Title lead many"),
        (f"<main><h1>Title</h1><div class=a><div class=b>{LONG}</div></div><p>end</p></main>", "Title many end"),
        (f"<body><h1>Title</h1><div class=one>{LONG}</div><div class=two><p>second</p>{LONG}</div></body>", "Title many second many"),
        (f"<body><ul><li><a href=/>Home page</a><li><a href=/x>Other page</a></ul><div class=one>{LONG}</div></body>", "many"),
        (f"<body><p>outside words</p><article>{LONG}</article></body>", "many"),
    ],
)
def test_text_around_the_best_container(spark, page, holds):
    text = html_text.main_text(page, None)
    assert [line.split()[0] for line in text.split("\n")] == holds.split()
    votes = spark.createDataFrame([(i, "http://a.org/x", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extracted(votes).collect()} == {text}


def test_host_votes_decide(spark):
    """A page whose side box is longer than its article follows the host's path."""
    box = "<div class='box7'><p>" + "other words " * 14 + "</p></div>"
    good = f"<body><div class='story12'>{BODY}</div></body>"
    odd = f"<body><div class='story9'>{BODY}</div>{box}</body>"
    rows = [(i, "http://a.org/x", good) for i in range(4)] + [(9, "HTTP://A.org:80/y", odd), (10, None, None), (11, "no url", ""), (12, "http://b.org", "bare words"), (13, "http://b.org", "<p>cut <b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    got = {int(r["page_id"]): r["text"] for r in html_text.extracted(df).collect()}
    assert got[9] == got[0] and got[9].startswith("First long")
    assert (got[10], got[11], got[12], got[13]) == ("", "", "bare words", "cut")
    assert html_text.extracted(df.filter("false")).count() == 0


def test_driver_rows(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in df.collect()}
    assert {int(r["page_id"]): r["text"] for r in html_text.extracted(df).collect()} == want


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<article><p>one</p><p it's>two</p><p>three isn't lost</p></article>", ["one", "two", "three isn't lost"]),
        (f"<article><p class=search-note>a note</p><p class=ad>Buy</p>{LONG}</article>", ["a note", None]),
        (f"<body><header><h1>Site</h1></header><article><header><nav>Menu</nav><h1>Title</h1>By line</header>{LONG}</article></body>", ["Title", None]),
        (f"<article><script>if (a<b && c='x') d('</p>')</script>{LONG}</article>", [None]),
        (f"<article><p title='class=ad'>kept</p>{LONG}<p title=\"a > b\">also</p></article>", ["kept", None, "also"]),
        (f"<article>{LONG}<p>3 < 4 and </ 5></p></article>", [None, "3 < 4 and"]),
    ],
)
def test_odd_markup(page, lines):
    got = html_text.main_text(page, None).split("\n")
    assert len(got) == len(lines) and all(w is None or w == g for w, g in zip(lines, got, strict=True))


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        # classes of layout and of what an article is about
        ('<div class="page has-sidebar"><div class="content"><p>all of the article text here</p>', ["all of the article text here"]),
        ('<div id="main" class="with-share social-enabled"><p>all of the article text here</p></div>', ["all of the article text here"]),
        (f'<article><section class="related-work"><h2>Work</h2></section><section class="search-methods"><p>how</p></section>{LONG}<div class="footer-notes"><p>notes</p></div></article>', ["Work", "how", None, "notes"]),
        (f'<article><div class="hero-banner"><h1>Title</h1></div>{LONG}<div class="related-posts"><p>no</p></div><div class="user-comments"><p>no</p></div></article>', ["Title", None]),
        # an element that holds the page is the page's, whatever its class; long comments are not
        (f'<body><nav>Menu</nav><div class="sponsored-story"><h1>Title</h1>{LONG}</div><div class="comments"><p>no</p></div></body>', ["Title", None]),
        (f'<body><div class="widget-area search"><div class="share">{LONG}</div></div></body>', [None]),
        (f'<body><article>{LONG}</article><div class="comments">{LONG}{LONG}{LONG}</div></body>', [None]),
        # raw elements that close themselves, that nest, that never end
        ('<p>one <svg class="icon"/> two</p><p>three four five</p>', ["one two", "three four five"]),
        ("<p>one</p><svg><title>no</title><path d=x></svg><p>two</p>", ["one", "two"]),
        ("<p>one</p><button>x<p>two</p>", ["one", "two"]),
        ("<p>one</p><button><div>no</div></button><p>two</p>", ["one", "two"]),
        ("<p>one</p><button>x<p>two</p><button>y</button><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><select><option>no<option>no</select><p>two</p>", ["one", "two"]),
        ("<p>one</p><template><p>x</p><template>y</template><div>LEAK</div></template><p>two</p>", ["one", "two"]),
        ("<div><p>one</p><template></div><p>no</p></template><p>two</p></div>", ["one", "two"]),
        ("<p>one</p><noscript><p>no</p></noscript><p>two</p>", ["one", "two"]),
        ("<p>one</p><template>x<p>two</p>", ["one", "two"]),
    ],
)
def test_no_text_is_lost(spark, page, lines):
    """Alone and as three pages of one host."""
    got = html_text.main_text(page, None).split("\n")
    assert len(got) == len(lines) and all(w is None or w == g for w, g in zip(lines, got, strict=True))
    df = spark.createDataFrame([(i, "http://a.org/x", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extracted(df).collect()} == {"\n".join(got)}


@pytest.mark.parametrize("piece", ["<button>x", "<template>x", "<div class=ad>x", "<div class=ad><h1>x", "<svg></p>", "<a ", "<div>", "<p", "<div></p>", "<a =\"", "<!--", "<script>", "</", "<div class='x", "<b><p>x", "&#", "<td>x"])
def test_long_pages_take_linear_time(piece):
    """A million characters of any of these, with a stray quotation mark, are read in seconds."""
    began = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)) + '"' + BODY, None)
    assert time.perf_counter() - began < 20


def test_ties_and_repeated_rows(spark):
    """Two paths with equal votes: one wins for all pages of the host, whatever the order of rows."""
    page = lambda name, other: f"<body><div class='{name}'>{BODY}</div><div class='{other}'><ul><li><a href=/>x</a></ul></div></body>"
    rows = [(1, "http://a.org/x", page("one", "two")), (2, "http://a.org/y", page("two", "one")), (2, "http://a.org/y", page("two", "one"))]
    got = [sorted(map(tuple, html_text.extracted(spark.createDataFrame(r, "page_id long, url string, html string")).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 3 and all(t.startswith("First long") for _, _, t in got[0])
