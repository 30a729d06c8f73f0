import html as stdlib_html
import re
from collections import Counter

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from leakscope.llm import html, search


def brute_top(rows, k, every=20):
    good = [(i, np.floor(64 * np.array(v, dtype=float)).astype(object)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in good if i % every == 0}.values():
        scores = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return Counter(out)


def check_top(df, k=20, **kw):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    got = search.top_k(df, F.col("vec_id") % 20 == 0, k=k, **kw).collect()
    assert Counter(map(tuple, got)) == brute_top(rows, k)


def test_top_k(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check_top(df)
    check_top(df, query_group=9, row_group=70)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, -0.5]), (20, [0.1, 0.2]), (20, [0.1, 0.2]), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]),
            (None, [1.0, 1.0]), (100, [float("inf"), 0.0]), (120, []), (140, [1.0, 2.0, 3.0]), (141, [1.0, 2.0, 3.0]),
            (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [1e7, -1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    check_top(df, k=3)
    check_top(df, k=20)
    assert search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_never_undercut():
    rng = np.random.default_rng(0)
    for size in (1, 3, 17, 64):
        x, q = rng.normal(size=(200, size)) * 30, rng.normal(size=(20, size)) * 30
        for segments in search.resolutions(size):
            bound = search.statistics(q, segments) @ search.statistics(x, segments).T
            assert (bound + 1e-6 >= q @ x.T).all()


def article(source):
    part = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", source, re.S)[1]
    part = re.sub(r"<(?:/?p|/?h1|br)>", " ", part)
    return " ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", "", part)).split())


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"]))


LONG = "This sentence belongs to the article and is long enough to be told apart from the menus around it. "


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
      <header><h1>Site name</h1><nav>Home News</nav></header><div class="cookie-notice">We use cookies, please accept.</div>
      <div id="content"><h1>Title &amp; more</h1><p>{LONG}<a href="x">link</a></p><p>{LONG}</p><div class="ad">Buy now</div>
      <ul><li><a href=1>One more story</a></li><li><a href=2>Another story</a></li></ul><form>Name <input></form>
      <p>{LONG}<script>if (a < b) track()</script></p></div><aside>Side text</aside>
      <div id="comments"><p>{LONG.replace("article", "reader")}</p></div><footer>&copy; 2024</footer></body></html>"""
    one = " ".join(LONG.split())
    assert html.main_text(page) == f"Title & more {one} link {one} {one}"


def test_awkward_pages(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("plain &lt; text") == "plain < text"
    assert html.main_text("<p>a<b>c<p>d</b><br>e") == "a c d e".replace("a c", "ac")
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert html.main_text("<p title='>'>x</p><!-- <p>no</p> --><p>y &am") == "x y &am"
    rows = [(1, "u", None, 0), (None, None, "<p>x</p>", 0), (1, "u", "", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        type(got[0])(page_id=1, url="u", text="", n_chars=0), type(got[0])(page_id=None, url=None, text="x", n_chars=1),
        type(got[0])(page_id=1, url="u", text="", n_chars=0)]))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_links_or_article_element():
    one, two = " ".join(LONG.split()), " ".join(LONG.replace("sentence", "paragraph").split())
    for body in (f"<div>We use cookies on this site.</div><div><p>{one}</p><p>Short.</p><p>{two}</p></div>",
                 f"<table><tr><td><a href=1>menu</a><br><a href=2>more</a></td><td><p>{one}</p><p>Short.</p><p>{two}</p></td></tr></table>",
                 f"<div class=wrap><div class=side><ul><li><a href=1>a long link to another page</a><li><a href=2>and one more of "
                 f"them</a></ul></div><div><p>{one}</p><p>Short.</p><div><p>{two}</p></div></div></div>"):
        assert html.main_text(f"<html><body>{body}</body></html>") == f"{one} Short. {two}"
    page = f"<h1>Title</h1><div class=share>Share this</div><div><p>{one}</p><p>{two}</p></div>"
    assert html.main_text(page) == f"Title {one} {two}"
    comments = f"<section id=comments><article><p>{one}</p><p>{two}</p><p>{one}</p></article></section>"
    assert html.main_text(f"<main><article><p>{one}</p></article>{comments}</main>") == one


def test_letters_that_grow_in_lower_case_do_not_shift_raw_elements():
    for tag in ("script", "style", "iframe", "svg"):
        page = f"<p>{'\u0130' * 30}</p><{tag}>x</{tag.upper()} ><p>{LONG}</p><p>second {LONG}</p>"
        one = " ".join(LONG.split())
        assert html.main_text(page) == f"{'\u0130' * 30} {one} second {one}"
