"""Main text of pages: what a wrapper must leave out, and what it must keep."""

import random

from pyspark.sql import functions as F

from vintagelake.llm import html

SCHEMA = "page_id long, url string, html string"


def page(i, body, host="a.example"):
    head = "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav>"
    foot = "<aside class=sidebar>Top stories</aside><footer>(c) 2024</footer><script>var x = '<p>no</p>';</script></body></html>"
    return (i, f"http://{host}/{i}", f"{head}{body}{foot}")


def texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article(spark):
    rows = [page(1, "<article><h1>A &amp; B</h1><p>One\n  two &#233;&nbsp;x</p><p>Three</p><div class='ad'>Buy</div></article><section id=comments><p>nice</p></section>")]
    assert texts(spark, rows) == {1: "A & B\n\nOne two é x\n\nThree"}


def test_template_of_a_host_is_cut(spark):
    """No article element: what stands in the same place of all pages of a host goes, what varies stays."""
    rows = [page(i, f"<div><div><p>Follow our daily letter</p></div><div><h1>Story {i}</h1><p>Body number {i} here.</p><p>End {i}.</p></div></div>") for i in range(8)]
    rows += [page(20, "<div><p>Follow our daily letter</p></div>", "lonely.example")]
    got = texts(spark, rows)
    assert got[3] == "Story 3\n\nBody number 3 here.\n\nEnd 3."
    assert got[20] == "Follow our daily letter"


def test_template_inside_articles_is_cut(spark):
    """A constant block of a host's articles goes, whatever its class; an article repeated under other menus stays whole."""
    rows = [page(i, f"<article><h1>Story {i}</h1><p>Body number {i} here.</p><div class=x{i % 2}><p>Get our daily letter</p></div><p>Get the app</p></article>") for i in range(9)]
    rows += [page(20 + i, f"<nav>Menu {i}</nav><article><p>The same text</p><p>on all pages</p></article>", "mirror.example") for i in range(6)]
    rows += [page(30 + i, f"<article><p>The one text</p></article><div>Part {i}</div>", "whole.example") for i in range(6)]
    got = texts(spark, rows)
    assert got[3].startswith("Story 3\n\nBody number 3 here.") and "Get the app" not in got[3]
    assert got[22] == "The same text\n\non all pages" and got[31] == "The one text"


def test_class_words_of_states_and_wrappers_keep_the_article():
    def kept(body):
        return html.page_text(page(1, body)[2], None, None, None)[0]

    for wrapper in ("content-with-sidebar", "has-sidebar", "sidebar"):
        assert kept(f"<div class='{wrapper}'><article><p>Text</p><div class=ad>Buy</div></article></div>") == "Text"
    assert kept("<article class='post comments-open'><p>Text</p></article>") == "Text"
    assert kept("<div><p>Long main text of the page</p></div><div class=related><article>Teaser</article></div>") == "Long main text of the page"
    assert kept("<article><p>Text</p><div class='ad-slot'>Buy</div></article><div id=comments><article class='comment-body'>Nice</article></div>") == "Text"
    assert kept("<div class=sidebar><aside><article>Aside</article></aside></div>") == ""


def test_content_is_found_without_tags_and_classes(spark):
    """Pages whose menus, adverts and footers vary too and are plain div elements: the host's pages tell where its content is."""
    rows = []
    for i in range(12):
        menu = "".join(f"<li><a href=/{k}>Item {i * k}</a></li>" for k in range(5 + i % 2))
        body = f"<div><h1>Story {i}</h1><p>{'long text ' * (1 if i == 3 else 30)}{i}</p><p>The end {i}</p></div>"
        rows.append((i, f"http://plain.example/{i}", f"<html><body><div><ul>{menu}</ul></div><div>Buy {i} things today, they are cheap</div>{body}<div>&copy; plain {i} words of the footer</div>"))
    got = texts(spark, rows)
    assert all(got[i].startswith(f"Story {i}\n\nlong text ") and got[i].endswith(f"The end {i}") for i in range(12))


def test_given_pages_without_tags_and_classes(spark):
    """Induction alone gives the text that tags and classes give, on nearly all pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", r"(</?)(nav|aside|footer|header|main|article|section)\b", "$1div"), r"\s(class|id|role)=\"[^\"]*\"", "")
    a, b = ({r.page_id: r.text for r in html.main_text(df).collect()} for df in (pages, pages.withColumn("html", plain)))
    assert sum(a[i] == b[i] for i in a) >= 0.95 * len(a)


def test_deep_and_wide_pages(spark):
    """No recursion over elements, and siblings in near linear time."""
    deep = "<html><body>" + "<div>" * 100_000 + "deep text" + "</div>" * 100_000
    wide = ["<table>" + "".join("<tr>" + "<td>x</td>" * (i * step % 5 + 1) + f"<p>{i}</p>" for i in range(20_000 + step)) + "</table>" for step in (3, 7)]
    rows = [(i, "http://odd.example/", x) for i, x in enumerate([deep, deep + "<center>" * 100_000 + "</section>" * 100_000, *wide, "<div>" * 100_001 + "deeper"])]
    got = texts(spark, rows)
    assert got[0] == got[1] == "deep text" and got[4] == "deeper" and got[2].count("x") == sum(i * 3 % 5 + 1 for i in range(20_003))


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "http://b.example/", ""), (3, "nonsense", "plain words"), (3, "nonsense", "plain words"), (None, "http://c.example", "<p>open <b>bold"), (5, "http://c.example", "<p" + " x" * 50_000)]
    out = html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    assert (got[1], got[2], got[3], got[None]) == ("", "", "plain words", "open bold")
    assert html.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simple_tree_matching_against_brute_force():
    """The largest common top-down, order-keeping matching, by trying all ways."""
    import random
    from functools import lru_cache

    rng = random.Random(3)

    def tree(depth):
        return (rng.choice("xyz"), tuple(tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)))

    def text(t):
        return f"({t[0]}{''.join(map(text, t[1]))})"

    @lru_cache(None)
    def best(a, b):
        return 1 + ways(a[1], b[1]) if a[0] == b[0] else 0

    @lru_cache(None)
    def ways(x, y):
        return max(ways(x[1:], y), ways(x, y[1:]), best(x[0], y[0]) + ways(x[1:], y[1:])) if x and y else 0

    for _ in range(150):
        a, b = tree(3), tree(3)
        if text(a) != text(b):
            assert len(html.matched(text(a), text(b))) == best(a, b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = html.main_text(pages).collect()
    assert len(out) == pages.count() and not any("<" in r.text and "</" in r.text for r in out) and sum(r.n_chars > 0 for r in out) > 0.8 * len(out)


def test_compound_class_names_inside_an_article_mark_nothing(spark):
    names = ["share-price", "ad-hoc", "banner-photo", "related-work", "menu-of-the-day", "replies-analysis", "form-of-art", "comments"]
    body = "".join(f'<p class="{n}">The paragraph that is called {n} tells of quiet rivers and of many fields beyond them.</p>' for n in names)
    page = f"<html><body><nav>Home News</nav><article><h1>Names of classes in articles</h1>{body}</article><footer>Imprint</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://host.example/a", page)], "page_id long, url string, html string")
    text = html.main_text(pages).first().text
    assert all(f"called {n} tells" in text for n in names[:-1]) and "called comments tells" not in text and "Imprint" not in text


def test_matching_does_not_depend_on_the_size_of_a_list(monkeypatch):
    """A list with a table of 1.2 million cells is matched as a short one, and kept cells change nothing."""
    for n in (5, 550):
        page, host = "(r(x)" + "(p)(q)" * n + ")", "(r" + "(p)(q)" * n + "(x))"
        assert html.matching(page, host) == {0: 0} | {k + 2: k + 1 for k in range(2 * n)}
    rng = random.Random(5)

    def tree(depth):
        return f"({rng.choice('abc')}{''.join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ''})"

    pairs = [tuple(f"(r{''.join(tree(3) for _ in range(rng.randint(1, 6)))})" for _ in range(2)) for _ in range(60)]
    whole = [html.matching(*p) for p in pairs]
    monkeypatch.setattr(html, "CELLS", 8)
    assert [html.matching(*p) for p in pairs] == whole
