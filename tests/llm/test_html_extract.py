import random
import time

import pytest

from chronoloom.llm import html_extract as he
from chronoloom.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>Site &ndash; page</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href="/a">A link</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to them all now.</div><article><h1>Title  of
it</h1><p>First &amp; <b>bold</b> text.<p>Second&nbsp;line<script>var x = "</p>";</script> goes on.<div class="ad">Buy this now, it is really very cheap today!</div><p>Third.</article>
<div id="comments"><p>I like this very much, thank you for the long article that you wrote.</p></div><footer>&copy; all rights reserved by the owner</footer></body></html>"""


def test_blocks_of_the_article():
    assert he.main_text(PAGE, {}) == "Title of it\nFirst & bold text.\nSecond line goes on.\nThird."
    weights = he.learn_weights(he.count_page(PAGE))
    assert he.main_text(PAGE, weights) == "Title of it\nFirst & bold text.\nSecond line goes on.\nThird."


def test_page_without_an_article_element():
    page = PAGE.replace("<article>", '<div class="story">').replace("</article>", "</div>")
    assert he.main_text(page, {}).startswith("Title of it\nFirst & bold")
    assert "cookies" not in he.main_text(page, {}) and "like this" not in he.main_text(page, {})


def test_odd_pages():
    for page, text in [(None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a<", "a<"), ("<!-- x", ""), ("<script>x", ""), ("<nav>only a menu</nav>", ""), ("<p>&#x41;&lt;b&gt;</p>", "A<b>")]:
        assert he.main_text(page, {}) == text
    assert he.main_text("<p>" + "word " * 200_000, {}).count("word") == 200_000


def test_query_against_the_articles(spark, small):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op8_html(spark, small).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|b|br)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_hard_rows(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old"), (None, "v", "", "old"), (3, "w", "<p>" + "long " * 50_000, "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = he.with_main_text(pages, he.fit_weights(pages)).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got)[:2] == [0, 0] and max(len(r["text"]) for r in got) == 249_999
    none = pages.limit(0)
    assert he.fit_weights(none) == {} and he.with_main_text(none, {}).count() == 0


WORDS = " ".join(f"story{i}" for i in range(60))


def test_names_around_the_content():
    beside = '<div class="sidebar"><p>Read these other things as well, there are many of them here today.</p></div>'
    weights = he.learn_weights(he.count_page(f"<body>{beside}<article><p>{WORDS}</p></article></body>"))
    assert weights[".sidebar"] < 0
    for story in (f"<article><p>{WORDS}</p></article>", f"<div><p>{WORDS}</p></div>", f"<main><p>{WORDS}</p></main>"):
        for around in ('<body class="has-sidebar">', '<body class="sidebar header">', '<body><div id="page" class="with-sidebar">', '<body><div class="widget">', "<body><form>"):
            for learned in ({}, weights):
                assert he.main_text(f"{around}{story}{beside}", learned) == WORDS


def test_articles_that_are_asides():
    comments = "".join(f'<article class="comment"><p>Comment {i} says that it likes this very much.</p></article>' for i in range(3))
    for below in (comments, f'<div id="comments">{comments.replace(" class=", " data-x=")}</div>'):
        page = f'<body><div class="story"><h1>Head</h1><p>{WORDS}</p></div>{below}</body>'
        assert he.main_text(page, {}) == f"Head\n{WORDS}"


def test_long_comments_are_not_the_content():
    page = f'<body><div class="story"><h1>Head</h1><p>{WORDS}</p></div><div class="comments"><p>{"reply " * 500}</p></div></body>'
    assert he.main_text(page, {}) == f"Head\n{WORDS}"


def test_best_run_equals_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 5]) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for b in range(len(scores) + 1) for a in range(b)}
        most = max(sums.values(), default=0)
        a, b = he.best_run(scores)
        assert sum(scores[a:b]) == max(most, 0) and (most <= 0 or b == min(y for (x, y), s in sums.items() if s == most))


def test_the_label_does_not_decide():
    beside = '<nav><a href="/x">Go home</a></nav>'
    page = f"<body>{beside}<div><p>{WORDS}</p></div></body>"
    weights = he.learn_weights(he.count_page(PAGE))
    for tag in ("article", "main", "section"):
        assert he.main_text(page.replace("div>", f"{tag}>"), weights) == WORDS
    assert he.main_text(f"<article>Short teaser here</article><article>Another one</article><div><p>{WORDS}</p></div>", weights).endswith(WORDS)


def test_short_items_of_the_content_stay():
    page = f'<body><nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News</a></li></ul></nav><div><h1>Head</h1><p>{WORDS}</p><ul><li>one two</li><li>three four</li></ul></div><footer>All rights</footer></body>'
    labelled = PAGE.replace("<header>", '<ul class="top"><li><a href="/x">Go</a></li></ul><header>')
    for weights in ({}, he.learn_weights(he.count_page(labelled))):
        assert he.main_text(page, weights) == f"Head\n{WORDS}\none two\nthree four"


def test_names_that_only_look_like_asides():
    for inner in ('<h1 class="entry-header">A title</h1>', '<header><h1>A title</h1></header>', '<div class="social-science"><h1>A title</h1></div>', "<math><mi>A</mi> <mi>title</mi></math>"):
        assert he.main_text(f"<body><main>{inner}<p>{WORDS}</p></main></body>", {}).startswith("A title")
    for name in ("sidebar", "left-sidebar", "leftSidebar", "comment-list", "cookie-notice", "site-header", "ad-box"):
        assert he.main_text(f'<body><div class="{name}"><p>Some other words that are not content</p></div><div><h1>T</h1><p>{WORDS}</p></div></body>', {}) == f"T\n{WORDS}"


@pytest.mark.parametrize("part", ["<div>", "<div class=x>w", "<a ", "<a '", "<a x='", '<p "', "</div>", "<!--", "<", "&", "<script>", "<p><b>w</p>", "<script x"])
def test_broken_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    for whole in (page, page + ">", f"<p>{page}</p>"):
        begun = time.perf_counter()
        he.parse(whole)
        assert time.perf_counter() - begun < 6  # a second on an idle machine
    assert he.main_text(f"{page[: 5000 * len(part)]}", {}) is not None


def test_comments_with_most_words_are_no_content():
    for name in ('class="comment-list"', "id=comments", "class=reader-feedback"):
        page = f'<body><div class="story"><p>{WORDS}</p></div><div {name}><div class="comments-page comments">{"<p>I like this story a lot.</p>" * 60}</div></div></body>'
        assert he.main_text(page, {}) == WORDS


def test_other_things_around_the_content():
    for box in ("<section id=reader-feedback><p>Very good text, thank you so much for it.</p></section>", '<div class="legal-strip"><p>All content is owned by us and nobody else.</p></div>', '<div class="dfp-slot"><p>Buy our fine new product today.</p></div>'):
        assert he.main_text(f"<body>{box}<div><h1>T</h1><p>{WORDS}</p></div>{box}</body>", {}) == f"T\n{WORDS}"
    teasers = "".join(f'<article class="teaser"><h2><a href="/{i}">Other story {i}</a></h2><p>What it tells in short.</p></article>' for i in range(3))
    assert he.main_text(f"<body>{teasers}<div><h1>T</h1><p>{WORDS}</p></div>{teasers}</body>", {}) == f"T\n{WORDS}"


def test_names_of_paragraphs_and_headings():
    page = f"<body><div><h1>T</h1><p class='share'>the share of GDP rose</p><p>{WORDS}</p><div class='section-header'><h2>Next part</h2></div><p>{WORDS}</p></div></body>"
    assert he.main_text(page, {}) == f"T\nthe share of GDP rose\n{WORDS}\nNext part\n{WORDS}"
    page = f"<body><div class='site-header'><h2>The Site</h2></div><div><h1>T</h1><p class='share'><a href=/x>Tell friends</a></p><p>{WORDS}</p></div></body>"
    assert he.main_text(page, {}) == f"T\n{WORDS}"
