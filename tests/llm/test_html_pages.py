"""Pages that differ from the others of their host, names that mislead, broken markup, and what alignment does."""

import random
import time

from loomkit.llm import html_wrappers


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_wrappers.extract_text(df).collect()}


def test_block_of_one_page_stays(spark):
    page = lambda i, extra="": f"<div class='top'>Always</div><h1>Head {i}</h1><p>Text {i}</p>{extra}<div class='end'>Ever</div>"
    rows = [(i, "http://h.org", page(i)) for i in range(5)]
    rows += [(i, "http://h.org", page(9, "<blockquote>Quoted</blockquote><p>After</p>")) for i in (9, 10, 11)]
    got = texts(spark, rows)
    assert all(got[i] == f"Head {i}\nText {i}" for i in range(5))
    assert {got[i] for i in (9, 10, 11)} == {"Head 9\nText 9\nQuoted\nAfter"}


ARTICLE = "<article><h1>Head</h1><p>Text</p><div class='share'>Share</div></article>"
LAYOUTS = ["div class='layout has-sidebar'", "div class='with-ads'", "section class=no-menu", "div id='page-nav-wrap'", "form", "div class='has-sidebar'><div class='inner'"]
OTHERS = ["aside", "nav", "footer", "div class='sidebar'", "div id='post-comments'", "section class='related-posts'"]


def test_wrapped_article_stays(spark):
    pages = [f"<body><{around}>{ARTICLE}<p>Beside</p>" for around in LAYOUTS] + [f"<body>{ARTICLE}<{around}><article><p>Other</p></article>" for around in OTHERS]
    got = texts(spark, [(i, f"http://h{i}.org", page) for i, page in enumerate(pages)])
    assert got == dict.fromkeys(range(len(pages)), "Head\nText")
    assert texts(spark, [(1, "http://h.org", "<div class='has-sidebar'><div role='main'><p>Text</p></div></div>")]) == {1: "Text"}


def test_names_that_say_little(spark):
    page = "<div class='share-prices'><p>Stock text {0}</p></div><p>Other {0}</p><div class='site-footer'>End {0}</div>"
    got = texts(spark, [(i, "http://h.org", page.format(i)) for i in range(4)])
    assert got == {i: f"Stock text {i}\nOther {i}" for i in range(4)}
    assert texts(spark, [(1, "http://h.org", "<div class='share-prices'><p>Stock text</p></div>")]) == {1: "Stock text"}


def test_the_wrapper_decides_inside_articles(spark, monkeypatch):
    """A bar that never changes goes, by the wrapper alone: some pages have more blocks before it, others repeat some."""
    page = lambda i: f"<article><h1>H{i}</h1>{f'<h2>S{i}</h2>' if i % 2 else ''}{''.join(f'<p>T{i}{j}</p>' for j in range(1 + i % 3))}<div class='x'>Tell your friends</div>{f'<blockquote>Q{i}</blockquote>' if i == 5 else ''}</article>"
    rows = [(i, "http://h.org", page(i)) for i in range(6)]
    body = {i: "\n".join([f"H{i}", *([f"S{i}"] if i % 2 else []), *(f"T{i}{j}" for j in range(1 + i % 3)), *(["Q5"] if i == 5 else [])]) for i in range(6)}
    assert texts(spark, rows) == body
    wrapper = html_wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).first().wrapper
    assert wrapper == "(/article/h1 #TEXT) (/article/h2 #TEXT)? (/article/p #TEXT)+ (/article/div.x) (/article/blockquote)?"
    monkeypatch.setattr(html_wrappers, "MOST_ITEMS", 0)  # each skeleton by itself: nothing is aligned
    alone = texts(spark, rows)
    assert alone[5] == body[5].replace("\nQ5", "\nTell your friends\nQ5") and alone[1] == body[1] + "\nTell your friends"


def test_one_block_of_four_pages(spark):
    page = "<p>{}</p>"
    rows = [(i, "http://h.org", page.format(w)) for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    rows[3] = (3, "http://h.org", page.format("delta") + "<blockquote>UNIQUE QUOTE</blockquote>")
    assert texts(spark, rows)[3] == "delta\nUNIQUE QUOTE"


def test_long_and_broken_pages_take_time_in_proportion():
    broken = ['<a "', "</a '", '<a ">" ', "<b>", "<div>", "<div></span>", "<p></b>", "<", "</", "<!--", "<!", "<script>", "&amp", "<p>x<b>y"]
    for piece in broken:
        started = time.perf_counter()
        found = html_wrappers.skeleton("<p>first</p>" + piece * 60_000 + "<p>last</p>")[2]
        assert found[0] == "first" and time.perf_counter() - started < 10, piece
    many = "".join(f"<p>word {i}</p>" for i in range(50_000))
    assert len(html_wrappers.skeleton(many)[2]) == 50_000 and html_wrappers.skeleton(many)[0] == ["./p"]


def test_against_a_plain_parser(spark):
    """Random pages without template or marks: all text of the article, by the standard parser's events."""
    r = random.Random(4)
    rows, expected = [], {}
    for i in range(60):
        parts, blocks = [], []
        for j in range(r.randrange(1, 9)):
            words = [f"w{i}.{j}.{k}" for k in range(r.randrange(1, 6))]
            tag = r.choice(["p", "h2", "li", "blockquote", "pre", "td"])
            parts.append(f"<{tag}>{r.choice([' ', chr(10), '  '])}" + r.choice([" ", "\t", "<br>", "&nbsp;", " <i>", "</i> "]).join(words) + f"</{tag}>")
            blocks.append(" ".join(words))
        rows.append((i, f"http://h{i % 5}.org", f"<nav><p>Menu {i}</p></nav><article>{''.join(parts)}</article><footer>F{i}</footer>"))
        expected[i] = "\n".join(blocks)
    assert texts(spark, rows) == expected
