"""op9: pages of known text."""

import time

import brute
import pytest

from weir.llm import html_query
from weir.llm.html_text import INLINE, _Page, densities, extract_text, main_text

P1 = "The first paragraph of the article is long enough to count as text, and has &quot;quotes&quot; &amp; more."
P2 = "The second   one\n has <b>bold</b> and <a href='x'>linked</a> words in it, which stay where they are in the text."
T1 = 'The first paragraph of the article is long enough to count as text, and has "quotes" & more.'
T2 = "The second one has bold and linked words in it, which stay where they are in the text."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{n}'>Menu {n}</a></li>" for n in range(20)) + "</ul></nav>"
WANT = f"{T1}\n\n{T2}"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p {{}}</style></head><body>{MENU}<article><p>{P1}</p><p>{P2}</p></article><footer>Copyright</footer></body></html>",
        f"<body>{MENU}<div class='content'><p>{P1}</p><p>{P2}</p></div><div class='sidebar'><p>Read this too</p></div><script>var a = '<p>no</p>';</script></body>",
        f"<div id=main><p>{P1}<p>{P2}</div><div class='comments'><p>Nice article, thanks a lot for it!</p></div>",
        f"<BODY><DIV><P>{P1}</P>\n<P>{P2}</P></DIV><form><input><button>Send</button></form></BODY>",
        f"<!-- <p>hidden</p> --><main><p>{P1}</p><aside>Advert</aside><p>{P2}</p></main>",
        f"<article><header></header><p>{P1}</p><div class='cookie-notice'>We use cookies</div><p>{P2}</p></article>",
    ],
)
def test_main_text(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<html></html>", ""), ("just words, no markup", "just words, no markup"), ("<p>a<br>b</p>", "a b"), ("<p>unclosed", "unclosed"), ("<<>>< p>", "<<>>< p>"), ("<p>" + "word " * 20_000 + "</p>", ("word " * 20_000).strip())])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_deep_page():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    rows = sorted(extract_text(df).collect(), key=str)
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "", 0)]
    assert extract_text(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_query.query(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and r.text == brute.article_text(pages[r.page_id])
    assert sum(bool(r.text) for r in rows) >= 0.9 * len(rows)


def test_all_pages(spark, sf_dir):
    """The markup of the tables is known: an article of headings and paragraphs."""
    for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect():
        assert main_text(r.html) == brute.article_text(r.html)


def test_densities_are_those_of_a_plain_version(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("length(html) < 3000").limit(12).collect()]
    pages += [f"<body>{MENU}<article><p>{P1}</p><p>{P2}</p><ul><li><a href='x'>one</a> and two</li></ul></article>tail</body>", "<p>a<br>b <i>c</i>", "<a href='y'>all <b>linked</b></a>", "<body></body>"]
    for source in pages:
        page = _Page(source)
        page.drop_marked()
        _, _, _, _, _, density, sums, _ = densities(page)
        want = brute.text_density(page, INLINE)
        assert density == pytest.approx(want[0]) and sums == pytest.approx(want[1])


LONG = " ".join(f"Sentence {n} of the article is plain prose that says a little more than the one before it." for n in range(6))


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body>{MENU}<article><h2>Part one</h2><p>{LONG}</p></article><article><p>{LONG} End.</p></article></body>", f"Part one\n\n{LONG}\n\n{LONG} End."),
        ("<body>" + MENU + "<article>" + f"<p>{LONG}</p>" * 5 + f"</article><article><p>{LONG} End.</p></article><p>{P1}</p></body>", "\n\n".join([*[LONG] * 5, f"{LONG} End."])),
        *[(f"<body>{MENU}<div class='{c}'><article><p>{P1}</p><p>{P2}</p></article><div class='sidebar'>Adverts</div></div></body>", WANT) for c in ("layout has-sidebar", "content with-menu", "post-search")],
        (f"<body>{MENU}<div class='has-sidebar'><p>{P1}</p><p>{P2}</p></div></body>", WANT),
        (f"<body>{MENU}<article><p>{P1}</p><p>{P2}</p></article><div class='user-comments'><p>{LONG}</p></div></body>", WANT),
        (f"<body><article><p>{P1}</p><p>{P2}</p><div class='comments'><p>{LONG}</p></div></article></body>", WANT),
        (f"<body><article><h1>A title</h1><p><b>{LONG}</b><br></p><p>{P1}</p><p>Short.</p></article><p>Imprint</p></body>", f"A title\n\n{LONG}\n\n{T1}\n\nShort."),
    ],
)
def test_articles_and_marked_wrappers(page, text):
    assert main_text(page) == text


def test_density_decides_in_an_article():
    """The article tag bounds what stands beside the densest part, and doesn't choose: a list of links in it is no text."""
    links = "".join(f"<p><a href='/{n}'>Read on {n}</a></p>" for n in range(30))
    assert main_text(f"<body><article><section><p>{P1}</p><p>{P2}</p></section><section>{links}</section></article></body>") == WANT


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body>{MENU}<div class='story share-enabled'><p>{P1}</p><p>{P2}</p></div></body>", WANT),
        (f"<body><article><p>{P1}</p><section class='search-results-explained'><p>Short part.</p></section><div class='related-work'><p>Other work.</p></div><p>{P2}</p></article></body>", f"{T1}\n\nShort part.\n\nOther work.\n\n{T2}"),
        (f"<body><article><p>{P1}</p><p>{P2}</p><div class='x1'><ul>" + "".join(f"<li><a href='/{n}'>Linked headline {n}</a></li>" for n in range(9)) + "</ul></div></article></body>", WANT),
        (f"<body><article><p>{P1}</p><p>{P2}</p><div class='user-feedback'><p>Nice article, thanks!</p></div></article></body>", WANT),
        (f"<body><article><table><tr><td>a<td>b<tr><td>c</table><p>{P1}</p></article></body>", f"a\n\nb\n\nc\n\n{T1}"),
        (f"<body><article><p title='a > b'>{P1}</p><p title=\"it's\">{P2}</p></article></body>", WANT),
    ],
)
def test_names_and_links(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<a '" * 100_000, "<a \">\"" * 50_000 + "'", "<" * 200_000, "<b>x" * 100_000, "<div></p></span>" * 60_000, "<noscript>x" * 50_000, "<!x" * 100_000, "<ul><li>x" * 50_000])
def test_long_broken_pages(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5  # in proportion; quadratic work would take minutes
