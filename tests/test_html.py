import pytest

from loomkit.functions import html
from loomkit.operators import pages, search
from loomkit.policy import Policy

U = "https://h.org/a/b"


def title(page):
    return html.read_page(U, page)[0]


def text(page):
    return html.read_page(U, page)[1]


def links(page):
    return [(x["label"], x["href"]) for x in html.read_page(U, page)[2]]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a</p><p>b</p>", "a\nb"),
        ("<p>a <script>var t='</p>';</script>b", "a b"),
        ("<noscript><p>x</p></noscript>y", "y"),
        ("<style>p{}</style><noscript><script>1</script>z</noscript>y", "y"),
        ("<div>a</div><div></div><div></div><div></div><div>b</div>", "a\n\nb"),
        ("a<h4>b</h4>c", "abc"),
        ("<td>a</td><td>b</td>", "ab"),
        ("&amp;amp; &amp;lt;b&gt; ", "& <b>"),
        ("<a href='/x'>one</a>two", "one two"),
        ("<a>one</a>two", "onetwo"),
        ("a \t b", "a b"),
        ("a b\x0bc", "a\nb\nc"),
        ("AT&T", ""),
        ("text <b", "text"),
        ("", ""),
    ],
)
def test_page_text(page, expected):
    assert text(page) == expected


def test_titles():
    assert title("<title>A &amp; B</title><title> C</title>") == "A & B C"
    assert title("<title>open <p>rest") == "open <p>rest" or title("<title>open <p>rest").startswith("open")
    assert text("<title>T</title>x") == "x"


def test_links():
    page = "<a href='/x'>X</a><a href='c'> </a><a href='mailto:a@b'>M</a><a href='/x'>X</a><a href='/x'>Y</a><a href='/n'>n<a href='/m'>m</a><a href='/never'>"
    assert links(page) == [("X", "https://h.org/x"), ("https://h.org/a/c", "https://h.org/a/c"), ("Y", "https://h.org/x"), ("m", "https://h.org/m")]
    assert links("<a href='http://[bad'>x</a>") == []
    assert html.read_page(U, None) == (None, None, None)


def results(page):
    return [(x["title"], x["url"]) for x in html.read_results(page)]


def test_search_results():
    page = (
        "<a class='result-link' href='//duckduckgo.com/l/?uddg=https%253A%252F%252Fe.org%252F%253Fa%253D1'>One</a>"
        "<a class=\"x 'result__a'\" href='/l/?uddg=http%3A%2F%2Ff.org'>Two</a>"
        "<a class='result-link' href='https://notduckduckgo.com/'>no</a><a class='result-link' href='foo'>no</a>"
        "<a class='result-link' href='https://e.org'></a><a class='result-link'>no</a><a href='https://e.org'>no</a>"
        "<a class='result__a' href='http://f.org'>Two</a>"
    )
    assert results(page) == [("One", "https://e.org/?a=1"), ("Two", "http://f.org")]
    # An anchor of another class leaves the pending one open, but its end closes it.
    assert results("<a class='result-link' href='https://e.org'>a<a href='/x'>b</a>c</a>") == [("ab", "https://e.org")]


def test_decoded():
    assert html.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert html.decoded(b"\xff", None) == "�"
    assert html.decoded(b"x", "a; charset=nonsense") is None
    assert html.decoded(None, "a") is None


def test_opened_and_listed(spark):
    df = spark.createDataFrame(
        [(1, U, "<title>T</title>body", "text/html"), (2, U, "{}", "application/json"), (3, "ftp://h", "x", ""), (4, U, "", ""), (5, U, None, "")],
        "id long, url string, html string, content_type string",
    )
    out = {r.id: r.output for r in pages.opened_pages(df).collect()}
    assert out[1] == f"URL: {U}\nTitle: T\n\nbody"
    assert out[2] == f"Fetched non-HTML content from {U}. Content-Type: application/json"
    assert out[3] == "Browser open error: Only http and https URLs are supported."
    assert out[4] == f"URL: {U}\nTitle: (no title)\n\n(no readable text found)"
    listed = {r.id: r.output for r in pages.listed_links(df).collect()}
    assert listed[2] == f"No links found on {U}."
    assert listed[3] == "Browser link extraction error: Only http and https URLs are supported."
    off = Policy(browser_enabled=False)
    assert pages.opened_pages(df, policy=off).first().output == "Browser tools are disabled by AGENT_ENABLE_BROWSER_TOOLS."
    assert pages.page_links(df.limit(0).withColumnRenamed("id", "page_id")).count() == 0


def test_link_limit_is_clamped(spark):
    many = "".join(f"<a href='/{i}'>{i}</a>" for i in range(130))
    df = spark.createDataFrame([(1, U, many)], "page_id long, url string, html string")
    assert [pages.page_links(df, n).count() for n in (0, 5, 1000)] == [1, 5, 100]


def test_searched(spark):
    page = "".join(f"<a class='result-link' href='https://e.org/{i}'>{i}</a>" for i in range(20))
    df = spark.createDataFrame([(1, "q", page, 99), (2, "q", "<div id='challenge-form'>", 5), (3, "q", "", 5)], "id long, query string, html string, k int")
    out = {r.id: r.output for r in search.searched(df, df.k).collect()}
    assert out[1].startswith("Search results for: q\n1. 0\n   https://e.org/0\n") and out[1].count("\n") == 20
    assert out[2] == "Web search error: search provider returned an anti-bot challenge."
    assert out[3] == "No web search results found."
    assert search.searched(df, policy=Policy(search_enabled=False)).first().output == "Web search is disabled by AGENT_ENABLE_WEB_SEARCH."
