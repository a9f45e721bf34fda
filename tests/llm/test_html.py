import re
from html import unescape

import pytest

from askloom.llm import html

PARA = "A sentence of some length, with a comma, so that it reads like running text in an article. "


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words", "plain words"),
        ("<p>short</p>", "short"),
        ("<nav>menu</nav><p>text</p><footer>foot</footer>", "text"),
        ("<article><p>a &amp;amp; b&#233;&nbsp;&lt;c&gt;</p></article>", "a &amp; bé <c>"),
        ("<article><p>one<br>two</p><p>th<b>re</b>e\n\t four</article>", "one two three four"),
        ("<script>if (a < b) '<p>no</p>'</script><p>yes</p><style>p{}</style>", "yes"),
        ("<p>a<!-- <p>no</p> --> b</p>", "a b"),
        ("<p>kept</p><div class='cookie-notice'>we use</div><div id=sidebar>side</div>", "kept"),
        ("<p>kept</p><section class='comments'><p>reader</p></section><form><p>mail</p></form>", "kept"),
        ("<p>kept</p><div role=navigation>x</div><div hidden>y</div><div style='display: none'>z</div>", "kept"),
        ("<p>kept <a href='x>y'>link</a></p", "kept link"),
        ("<p>cut <a hre", "cut"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("</p></div>stray<b></i>", "stray"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>text</p></article>", "Title text"),
    ],
)
def test_small_pages(page, want):
    assert html.main_text(page) == want


def test_best_container_and_siblings():
    page = (
        "<div id=top><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"
        f"<div><div class=content><p>{PARA}</p><p>{PARA * 3}</p></div><p>{PARA}</p>"
        "<div><a href=4>more of this site</a>, <a href=5>and of that one</a></div></div>"
    )
    assert html.main_text(page) == " ".join((PARA + PARA * 3 + PARA).split())


def test_article_wins_over_its_largest_section():
    body = "".join(f"<section><h2>Part {k}</h2><p>{PARA * (1 + 20 * (k == 1))}</p></section>" for k in range(3))
    text = html.main_text(f"<body><aside>{PARA * 50}</aside><article>{body}</article><p>short</p></body>")
    assert text.startswith("Part 0") and "Part 2" in text and text.count("A sentence") == 23


def test_deep_long_and_hostile_pages():
    assert html.main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert html.main_text("<p>" + "word " * 200_000).count("word") == 200_000
    assert html.main_text("<" * 50_000) in ("", "<" * 50_000)
    assert html.main_text("<a href=\"" * 5_000 + "x") is not None
    assert html.main_text("<b>" * 20_000 + "</i>" * 20_000 + "end") == "end"


def test_nulls_repeats_clashes_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 1, "x"), (None, "u", "<p>a</p>", 1, "x"), (2, "u", "<p>é</p>", 1, "x"), (2, "u", "<p>é</p>", 1, "x")]
    got = html.page_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "", 0), (None, "u", "a", 1), (2, "u", "é", 1), (2, "u", "é", 1)], key=str)
    assert html.page_texts(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-banner", "social-science", "sidebar", "left-sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_of_the_article_are_not_cut(name, tag):
    chrome = "<nav><a href=1>one</a></nav>", "<div class=sidebar>Other things</div><footer>foot</footer>"
    body = f"<{tag}><h1>Title</h1><p>{PARA * 4}</p></{tag}>"
    page = f"{chrome[0]}<div class='{name}'>{body}{chrome[1]}</div>"
    assert html.main_text(page) == " ".join(("Title " + PARA * 4).split())
    assert html.main_text(f"<div id=page class='{name}'>{page}</div>") == html.main_text(page)


@pytest.mark.parametrize("header", ["<div class='article-header'>", "<header class='entry-header'>", "<header class='post-header'>"])
def test_header_of_the_article_is_not_cut(header):
    end = "</div>" if header.startswith("<div") else "</header>"
    body = f"{header}<h1>Title</h1>{end}<p>{PARA * 3}</p>"
    for page in (f"<article>{body}</article>", f"<main>{body}</main>", f"<header>site</header><article>{body}</article>"):
        assert html.main_text(page) == " ".join(("Title " + PARA * 3).split())


def test_forms_are_cut_for_their_controls_only():
    controls = "<input name=a><select><option>b</option></select><textarea>c</textarea><button>go</button>"
    text = f"<p>{PARA * 4}</p>"
    want = " ".join((PARA * 4).split())
    assert html.main_text(f"<form id='aspnetForm'><input type=hidden name=x><nav>menu</nav><div>{text}</div></form>") == want
    assert html.main_text(f"<form><div>{text}</div>{controls}</form>") == want
    assert html.main_text(f"<div>{text}</div><form><p>Write to us, we answer.</p>{controls}</form>") == want
    assert html.main_text(f"<form><article>{text}</article><div class=comments>{PARA * 9}</div></form>") == want


def test_parts_with_text_of_their_own_stay_cut():
    text, want = f"<p>{PARA * 4}</p>", " ".join((PARA * 4).split())
    for part in ("<div class='related-posts'>{}</div>", "<div id=comments><article>{}</article></div>", "<div class='site-footer'>{}</div>",
                 "<aside>{}</aside>", "<div class='widget sidebar-2'>{}</div>", "<div class='post-comments'>{}</div>", "<div hidden>{}</div>"):
        assert html.main_text(f"<article>{text}</article>{part.format(f'<p>{PARA * 3}</p>')}") == want
    assert html.main_text("<nav>menu</nav><footer>foot</footer>") == ""
    deep = "<div class=sidebar>" * 20_000 + text + "</div>" * 20_000
    assert html.main_text(deep) == want


def test_sections_without_an_article_tag_are_all_kept():
    body = "".join(f"<section><h2>Part {k}</h2><p>{PARA * (1 + 20 * (k == 1))}</p></section>" for k in range(3))
    text = html.main_text(f"<body><aside>{PARA}</aside><div>{body}</div></body>")
    assert text.startswith("Part 0") and "Part 2" in text and text.count("A sentence") == 23


def test_all_that_stands_beside_the_body_is_kept():
    links = "<div><a href=1>more of this site</a>, <a href=2>and of that one</a></div>"
    page = (
        f"<div id=top><a href=1>one</a> <a href=2>two</a></div><div><h1>Title</h1>Bare lead, <b>bold</b>."
        f"<div><p>{PARA * 5}</p></div>between<ul><li>First</li><li>Second</li></ul><table><tr><td>a<td>b</table>"
        f"<figure><figcaption>Figure 1</figcaption></figure>{links}<p>The end.</p><a href=3>next page</a></div>"
    )
    want = f"Title Bare lead, bold. {PARA * 5}between First Second a b Figure 1 The end."
    assert html.main_text(page) == " ".join(want.split())
    assert html.main_text(page.replace("<p>The end.</p>", "<p>See <a href=4>there</a> again.</p>")) == " ".join(
        want.replace("The end.", "See there again.").split()
    )


def test_chrome_without_sentences_stays_outside():
    items = "".join(f"<div><span>Item {k}</span></div>" for k in range(100))
    page = f"<div>{items}</div><div><h1>Title</h1><div><p>{PARA * 3}</p></div></div>"
    assert html.main_text(page) == " ".join(("Title " + PARA * 3).split())


def test_siblings_of_an_article_tag_are_chosen_as_before():
    page = f"<article><p>{PARA * 3}</p></article><article><p>{PARA * 2}</p></article><div>short</div><p>short</p>"
    assert html.main_text(page) == " ".join((PARA * 5).split())


LONG = "A sentence of the article that has some words, and a comma."


@pytest.mark.parametrize("name", ["comments", "user-comments", "reader-comments", "comments-thread", "cookie-consent", "newsletter"])
@pytest.mark.parametrize("count", [1, 4, 40])
def test_comments_and_notices_of_any_size_stay_out(name, count):
    said = "".join(f"<p>Reader {i} says quite a lot here, and more than the article does.</p>" for i in range(count))
    page = f'<body><div class="article-content"><p>{LONG}</p></div><div id="{name}">{said}</div></body>'
    assert html.main_text(page) == LONG
    page = f'<body><div class="article-content"><p>{LONG}</p></div><div><article class="comment">{said}</article></div></body>'
    assert html.main_text(page) == LONG


def test_switches_and_papers_are_no_comments():
    for name in ("comments-open", "no-comments", "has-comments", "commentary", "discussion"):
        assert html.main_text(f'<div class="page {name}"><p>{LONG}</p></div>') == LONG


@pytest.mark.parametrize("name", ["google-ads", "breadcrumb-trail", "skip-link", "author-box"])
def test_named_chrome_goes(name):
    page = f'<body><div class="{name}">Some words of chrome</div><div class="content"><p>{LONG}</p><p>{LONG}</p></div></body>'
    assert html.main_text(page) == f"{LONG} {LONG}"


def test_what_stands_around_an_article_in_main_stays():
    page = f"<main><h1>Short title</h1><p>Lead.</p><div><article><p>{LONG}</p><p>{LONG}</p></article></div><p>Last para.</p></main>"
    assert html.main_text(page) == f"Short title Lead. {LONG} {LONG} Last para."
    two = f"<main><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>A short second.</p></article></main>"
    assert html.main_text(two) == f"{LONG} {LONG} {LONG} A short second."
    beside = f"<div><article><p>{LONG}</p><p>{LONG}</p></article><p>Short end.</p></div>"
    assert html.main_text(beside) == f"{LONG} {LONG} Short end."


def test_lists_of_links_under_a_heading_stay():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(4)) + "</ul>"
    named = "Source 0 Source 1 Source 2 Source 3"
    assert html.main_text(f"<article><p>{LONG}</p><h2>Sources</h2>{links}</article>") == f"{LONG} Sources {named}"
    assert html.main_text(f"<article>{links}<p>{LONG}</p></article>") == LONG


def test_formulas_and_quotations_are_text():
    page = f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>"
    assert html.main_text(page) == f"{LONG} x=2 holds."
    quote = f"<article><p>{LONG}</p><blockquote><p>{LONG}</p><footer>Ada Writer</footer></blockquote></article><footer>Imprint</footer>"
    assert html.main_text(quote) == f"{LONG} {LONG} Ada Writer"
