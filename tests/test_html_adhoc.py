"""HTML extraction, page cut-off and the guarded ad-hoc query surface."""

import pytest

from revq.operators.adhoc import QueryRejected, adhoc_select, route_questions
from revq.sources.html import extract_reviews, page_cutoff

PAGE_A = """<html><body>
<div data-hook="review"><i data-hook="review-star-rating"><span>4.5 out of 5 stars</span></i>
 <a data-hook="review-title">5.0 out of 5 stars Great sound</a>
 <span data-hook="review-body">Lovely &amp; loud</span>
 <span data-hook="review-date">Reviewed in India on 5 March 2024</span>
 <a class="a-profile author" href="/gp/profile/amzn1.account.XYZ?ref=abc">x</a></div>
<div data-hook="review"><span data-hook="review-body">No stars here</span>
 <span class="a-profile-name">Asha</span></div>
<div data-hook="review"><i data-hook="review-star-rating">4 out of 5</i><span data-hook="review-body"></span></div>
<div data-hook="review"><i data-hook="review-star-rating">abc</i><span data-hook="review-body">bad stars</span></div>
</body></html>"""

PAGE_B = """<html><body>
<div class="col _2wzgFH K0kLPL"><div class="XQDdHH">3</div><p class="z9E0IG">Okay</p>
 <div class="ZmyHeo">Fine sound<span class="teGi1e">READ MORE</span></div>
 <p class="_2mcZGG">Mar, 2024</p><p class="_2V5EHH">Ravi</p></div>
</body></html>"""


def test_extract_rules(spark):
    pages = spark.createDataFrame(
        [(1, "https://shop.example/dp/B0ABCDEFGH?x=1", PAGE_A, "Amazon"), (2, "https://b.example/p/q?page=1", PAGE_B, "flipkart")],
        "page_id long, url string, html string, source string",
    )
    got = sorted(extract_reviews(pages, product_id="p1").collect(), key=lambda r: (r.page_id, r.pos))
    a = [r for r in got if r.page_id == 1]
    assert [(r.rating, r.title, r.text) for r in a] == [(4, "Great sound", "Lovely & loud"), (0, "", "No stars here")]
    assert a[0].date == "2024-03-05" and a[0].reviewer_id == "amzn1.account.XYZ"
    assert a[1].reviewer_id == "Asha"
    b = [r for r in got if r.page_id == 2]
    assert [(r.rating, r.title, r.text, r.date, r.reviewer_id) for r in b] == [(3, "Okay", "Fine sound", "2024-03-01", "Ravi")]


def test_page_cutoff(spark):
    rows = [("L", 1, True, 5), ("L", 2, False, 0), ("L", 3, True, 0), ("L", 4, True, 5), ("L", 5, True, 5), ("M", 1, True, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, listing string, page_no int, fetched boolean, n_reviews long")
    kept = sorted((r.listing, r.page_no) for r in page_cutoff(df).collect())
    assert kept == [("L", 1), ("M", 1)]  # failed page 2 skipped; empty page 3 stops the listing


def test_adhoc_guard(spark):
    views = {"t": spark.range(5).withColumnRenamed("id", "x")}
    assert adhoc_select(spark, "SELECT 1 AS one", views).first().one == 1
    assert adhoc_select(spark, "WITH a AS (SELECT x FROM t) SELECT count(*) AS n FROM a;", views).first().n == 5
    for bad in ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SELECT reflect('java.util.UUID', 'randomUUID')"]:
        with pytest.raises(Exception):
            adhoc_select(spark, bad, views)
    with pytest.raises(QueryRejected):
        adhoc_select(spark, "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", views)


def test_router(spark):
    qs = spark.createDataFrame(
        [("How is ANC on Product 1?",), ("Compare battery life complaints",), ("top 1-star reasons",), ("which has better comfort",), ("balance?",), ("hello",)],
        "text string",
    )
    got = [r.template for r in route_questions(qs).collect()]
    assert got == ["theme_by_sentiment", "complaints_by_product", "one_star_reasons", "praise_by_product", "total_reviews", "total_reviews"]


def test_page_urls(spark):
    from revq.sources.html import crawl_frontier

    rows = [
        ("amazon", "https://shop.example/Some-Item/dp/B0ABCDEFGH/ref=x?th=1"),
        ("Amazon", "https://shop.example/product-reviews/B0ABCDEFGH?pageNumber=4&sort=new"),
        ("amazon", "https://shop.example/product-reviews/B0ABCDEFGH"),
        ("flipkart", "https://b.example/item/reviews?pid=7&page=9"),
        ("amazon", "https://m.example/gp/help"),
        ("amazon", ""),
        ("flipkart", None),
        (None, "https://b.example/item"),
        ("web", "https://b.example/item"),
    ]
    got = {(r.listing, r.page_no): r.page_url for r in crawl_frontier(spark.createDataFrame(rows, "source string, url string"), 2).collect()}
    assert len(got) == 8
    assert sorted(u for (_, n), u in got.items() if n == 2) == [
        "https://b.example/item/reviews?page=2",
        "https://shop.example/product-reviews/B0ABCDEFGH?pageNumber=2",
        "https://shop.example/product-reviews/B0ABCDEFGH?pageNumber=2&sort=new",
        "https://www.amazon.in/product-reviews/B0ABCDEFGH/ref=cm_cr_arp_d_paging_btm_next_2?ie=UTF8&reviewerType=all_reviews&pageNumber=2",
    ]


def test_unreadable_pages_and_sources(spark):
    """Deep nesting is read, an unknown source or blank URL gives nothing, markup that
    the parser refuses is an error row."""
    from revq.sources.html import extract_raw

    deep = PAGE_B.replace("Fine sound", "<i>" * 5000 + "Fine sound" + "</i>" * 5000)
    pages = spark.createDataFrame(
        [(1, "https://b.example/p", deep, "FLIPKART"), (2, "", PAGE_B, "flipkart"), (3, None, PAGE_B, "flipkart"),
         (4, "https://b.example/p", PAGE_B, "web"), (5, "https://b.example/p", PAGE_B, None), (6, "https://b.example/p", None, "flipkart")],
        "page_id long, url string, html string, source string",
    )
    assert [(r.page_id, r.text, r.error) for r in extract_raw(pages).collect()] == [(1, "Fine sound", None)]


def test_review_error_is_kept_apart(monkeypatch):
    from revq.sources import html as H

    real = H._author
    monkeypatch.setattr(H, "_author", lambda c, rules: 1 / 0 if "No stars" in c.text() else real(c, rules))
    got = list(H.extract_page(PAGE_A, H.MARKETPLACE_A))
    assert [r["pos"] for r in got if r["error"]] == [1] and len(got) == 4


def test_elements_that_no_rule_names_are_not_searched(monkeypatch):
    """A body in 1,000 nested elements: the selectors look at the few that rules name."""
    from revq.sources import html as H

    visited, real = [], H.Node.iter
    monkeypatch.setattr(H.Node, "iter", lambda self: (visited.append(n) or n for n in real(self)))
    page = PAGE_A.replace("Lovely &amp; loud", "<b>" * 1000 + "Lovely &amp; <em>lo</em>ud" + "</b>" * 1000)
    got = list(H.extract_page(page, H.MARKETPLACE_A))
    assert [r["text"] for r in got] == ["Lovely &loud", "No stars here", "", "bad stars"]
    assert len(visited) < 200


def test_standard_parser_reads_only_other_markup(monkeypatch):
    """Plain tags and texts never reach it; what does reach it gives the tree
    that it makes of the whole page."""
    from revq.sources import html as H

    other = (
        "<!DOCTYPE html>", "<!-- <p>old</p> -->", '<script>if (a < b) {"</p>"}</script>', "<br/>", "a < b &amp c", "<p class='z9E0IG'>",
        '<p class="x" title="1 > 0">', '<a href="?a=1&amp;b=2">', "<x-y>", "<![if x]>", "</ p>", "<TEXTAREA><b></TEXTAREA>", "<!--", "<i", "<script>", "&am",
    )

    def tree(n):
        return [c if isinstance(c, str) else (c.tag, c.attrs, tree(c)) for c in n.children]

    def fed_whole(page, wanted):
        b = H._Builder(wanted | H.SKIP_TEXT)
        b.feed(page)
        b.close()
        return b.root

    wanted = H._tags(H.MARKETPLACE_B)
    at = PAGE_B.index("Fine sound")
    for o in other:
        page = PAGE_B[:at] + o + PAGE_B[at:] + o
        assert tree(H.parse_html(page, wanted)) == tree(fed_whole(page, wanted)), o

    fed, real = [], H._Builder.feed
    monkeypatch.setattr(H._Builder, "feed", lambda self, data: (fed.append(data), real(self, data)) and None)
    deep = PAGE_B.replace("Fine sound", "<b>" * 1000 + "Fine sound" + "</b>" * 1000)
    assert [r["text"] for r in H.extract_page(deep, H.MARKETPLACE_B)] == ["Fine sound"] and fed == []
    assert [r["text"] for r in H.extract_page("<!DOCTYPE html>" + deep, H.MARKETPLACE_B)] == ["Fine sound"] and fed == ["<!DOCTYPE html>"]


def test_star_title_cleanup_only_for_marketplace_a(spark):
    page_b = PAGE_B.replace('<p class="z9E0IG">Okay</p>', '<p class="z9E0IG">5 out of 5 stars Okay</p>')
    pages = spark.createDataFrame([(3, "https://b.example/p", page_b, "flipkart")], "page_id long, url string, html string, source string")
    assert [r.title for r in extract_reviews(pages).collect()] == ["5 out of 5 stars Okay"]


def test_rating_whole_text_for_marketplace_b(spark):
    page_b = PAGE_B.replace('<div class="XQDdHH">3</div>', '<div class="XQDdHH">4 stars</div>')
    pages = spark.createDataFrame([(4, "https://b.example/p", page_b, "flipkart")], "page_id long, url string, html string, source string")
    assert extract_reviews(pages).count() == 0  # int(float("4 stars")) fails: the review is dropped


def test_adhoc_guard_by_plan(spark):
    views = {"t": spark.range(5).withColumnRenamed("id", "x"), "words": spark.createDataFrame([("reflect (it)",)], "w string")}
    before = dict(spark.conf.getAll)
    assert adhoc_select(spark, "SELECT 'reflect (' AS a, x FROM t WHERE x = 1", views).first().a == "reflect ("
    assert adhoc_select(spark, "SELECT count(*) AS n FROM words WHERE w LIKE '%reflect (%'", views).first().n == 1
    assert adhoc_select(spark, "```sql\nSQL SELECT max(x) AS m FROM t;\n```", views).first().m == 4
    assert adhoc_select(spark, "SELECT x FROM t WHERE x IN (SELECT max(x) FROM t) AND EXISTS (SELECT 1 FROM words)", views).first().x == 4
    assert adhoc_select(spark, "SELECT x, row_number() OVER (ORDER BY x DESC) AS r FROM t ORDER BY r LIMIT 1", views).first().x == 4
    assert adhoc_select(spark, "SELECT a.x FROM t a JOIN t b ON a.x = b.x + 1 UNION SELECT 9 AS x", views).count() == 5
    spark.range(3).createOrReplaceTempView("of_the_caller")
    spark.udf.register("own_udf", lambda x: x, "long")
    refused = [
        "SELECT r FROM (SELECT reflect('java.util.UUID', 'randomUUID') AS r)",
        "WITH a AS (SELECT java_method('java.lang.System', 'nanoTime') AS r) SELECT r FROM a",
        "SELECT x FROM t WHERE x = (SELECT max(length(try_reflect('java.util.UUID', 'randomUUID'))) FROM t)",
        "SELECT * FROM of_the_caller",
        "SELECT own_udf(x) FROM t",
        "SELECT * FROM json.`/tmp`",
        "SELECT * FROM t; DROP VIEW t",
        "DELETE FROM t",
        "SHOW TABLES",
    ]
    for bad in refused:
        with pytest.raises(QueryRejected):
            adhoc_select(spark, bad, views)
    assert dict(spark.conf.getAll) == before


def test_adhoc_from_two_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    def ask(n):
        return adhoc_select(spark, f"SELECT sum(x) AS s FROM t WHERE x < {n}", {"t": spark.range(n + 3).withColumnRenamed("id", "x")}).first().s

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(ask, range(1, 9))) == [n * (n - 1) // 2 for n in range(1, 9)]


def test_one_failing_query_leaves_the_others(spark):
    from revq.operators.adhoc import run_queries

    views = {"t": spark.range(5).withColumnRenamed("id", "x")}
    queries = {"a": "SELECT max(x) AS m FROM t", "b": "SELECT nothing FROM t", "c": "DROP TABLE t", "d": "SELECT x FROM t WHERE x > 9"}
    got = {r.name: r for r in run_queries(spark, queries, views).collect()}
    assert (got["a"].status, got["a"].results) == ("ok", ['{"m":4}'])
    assert got["b"].status == got["c"].status == "error" and got["b"].error and got["b"].results == []
    assert (got["d"].status, got["d"].n_rows, got["d"].results) == ("ok", 0, [])
