import html
import math
import random
import re
import time

from tidepool.llm import html_extract

from ..conftest import SF_SMALL
from .helpers import with_clashes

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><p>Tag line, of the site, with commas</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, really, a long, long text about them, yes, and more of it.</p></div>
<div id="content"><h2>Head</h2><p>First &amp; para, one,&nbsp; two.</p><div class="advert"><p>Buy, now, a lot</p></div>
<p>Second<br>line &#8212; <b>bold</b><ul><li>one<li>two <a href=x>x</a></ul><table><tr><td>a<td>b</table>
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --></div>
<aside><p>Side, bar, text, with, commas</p></aside><form><p>Subscribe, now</p></form>
<section id="comments"><p>Great, article, mate, yes, thanks</p></section><footer>&copy; all</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert html_extract.main_text(PAGE) == "Head\nFirst & para, one, two.\nSecond line — bold\none\ntwo x\na\nb"


def test_scores_find_the_container_without_semantic_markup():
    body = "".join(f"<p>Paragraph {i}, with some words, and commas, that go on for a while to make it long.</p>" for i in range(5))
    page = f"<div><div><a href=a>one</a> <a href=b>two</a></div><div><div>{body}</div><div><p>{'Tail, more text. ' * 5}</p></div></div><div><a href=c>three</a></div></div>"
    text = html_extract.main_text(page)
    assert text.startswith("Paragraph 0") and "Tail, more text." in text and "three" not in text and "one" not in text


def test_headers_of_the_page_go_and_those_of_the_article_stay():
    page = ('<div id="site-header"><p>The site, since 1999, for you, and for all of us here.</p></div><div class="story"><div class="post-header"><h1>Title</h1></div>'
            '<p>Body text, with words, and more, that makes the article long enough to win.</p><p>More body, more text, of the story.</p></div>')
    assert html_extract.main_text(page).startswith("Title\nBody text") and "1999" not in html_extract.main_text(page)
    inner = "<article><header><h1>Head</h1></header><p>Text.</p><footer>by me</footer></article>"
    assert html_extract.main_text(inner) == "Head\nText."


def test_several_articles_and_what_stands_beside_them():
    long = "Words, of a part, that go on for a good while, so that it counts as text of the page. " * 2
    page = (f"<main><article><p>One. {long}</p></article><article><p>Two. {long}</p></article><section><p>Three. {long}</p></section>"
            f'<section id="comments"><article class="comment"><p>Mine. {long}</p></article></section><div class="related"><article><p>Teaser. {long}</p></article></div></main>')
    text = html_extract.main_text(page)
    assert [line.split(".")[0] for line in text.split("\n")] == ["One", "Two", "Three"]
    assert html_extract.main_text("<main><article>one</article></main>") == "one"
    assert html_extract.main_text('<form class="menu"><article><p>Held, by a form.</p></article></form>') == "Held, by a form."


def test_class_words_inside_an_article():
    keep = '<section class="legal-analysis"><p>Law.</p></section><p class="market share">Share.</p><h2 class="notice">Note.</h2>'
    drop = ('<div class="advert-box"><p>Buy.</p></div><p class="ad">Buy.</p><div class="share-buttons"><a href=x>Share</a></div><div class="cookie-notice">Ok?</div>'
            '<aside>Side.</aside><form>Ask.</form>')
    links = "<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>"
    assert html_extract.main_text(f"<article><p>Text.</p>{keep}{drop}{links}</article>") == "Text.\nLaw.\nShare.\nNote.\nFirst source\nSecond source"


def test_points_against_a_recount_from_each_container():
    rnd = random.Random(6)

    def tree(depth):
        out = ""
        for _ in range(rnd.randint(1, 3)):
            tag = rnd.choice(("div", "section", "span", "p", "td", "li")) if depth < 6 else "p"
            inner = tree(depth + 1) if tag in ("div", "section", "span") else "text, " * rnd.randint(1, 60) + rnd.choice(("", "<a href=x>link, link</a>"))
            out += f"<{tag}>{inner}</{tag}>"
        return out

    for _ in range(100):
        nodes = html_extract.parse(tree(0))
        html_extract._measure(nodes)
        html_extract._pass_points(nodes)

        def letters(node, linked=False):
            return sum(len(x.strip()) if type(x) is str and linked else 0 if type(x) is str else letters(x, linked or x.tag == "a") for x in node.parts)

        def recount(container, node, level):
            total = 0.0
            own = "".join(x for x in node.parts if type(x) is str)
            paragraph = node.tag in ("p", "td")
            block = node.tag in html_extract.BLOCKS or node.parent is None
            if letters(node, True) and (paragraph or block and node.tag != "li" and own.strip()):
                away = level - 1 if paragraph else level
                if 0 <= away < 5:
                    size = letters(node, True) if paragraph else len(own.strip())
                    points = (1 + own.count(",") + min(size / 100, 3)) * (1 - letters(node) / letters(node, True))
                    total += points / ((1, 2, 6, 9, 12)[away])
            for x in node.parts:
                if type(x) is not str:
                    total += recount(container, x, level + (x.tag in html_extract.BLOCKS))
            return total

        for node in nodes:
            if node.tag in html_extract.BLOCKS or node.parent is None:
                assert math.isclose(node.score, recount(node, node, 0), abs_tol=1e-9)


def test_deep_markup_takes_time_in_proportion():
    def seconds(n):
        page = "<p>" + "<span>" * (10 * n) + "<li>x, y</b></i>" * n + "<p>a, b" * n + "</u>" * n
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 3.5 * seconds(4000)


def test_awkward_pages():
    m = html_extract.main_text
    assert m("") == "" and m("<nav>x</nav>") == "" and m("plain  text &lt;") == "plain text <" and m("<p>a") == "a"
    assert m("<article><p>cut off &am") == "cut off &am" and m("</p></div><p>x</b></p>") == "x"
    began = time.time()
    assert m("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(m("<p>" + "a, " * 500_000)) == 1_499_999
    assert time.time() - began < 20


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>x</p>"), (1, "u", PAGE)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = sorted((tuple(r) for r in html_extract.extract_text(pages).collect()), key=str)
    text = html_extract.main_text(PAGE)
    assert found == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1), (1, "u", text, len(text))], key=str)
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def test_query_against_the_planted_articles(spark):
    def planted(page):
        article = re.split(r"</article>|<footer>", page.split("<article>", 1)[1])[0]
        blocks = re.split(r"</?(?:h1|p)>", article)
        return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in blocks)))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    found = html_extract.op8_html_extraction(spark, SF_SMALL).collect()
    assert len(found) == len(pages) and all(r.text == planted(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)
