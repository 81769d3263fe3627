"""Theme trends, report sections and weekly alerts on micro-tables."""

from revq.operators import report as R
from revq.operators.mentions import theme_mentions, theme_trends
from revq.operators.weekly import weekly_spikes

MENTION_SCHEMA = (
    "arrival_seq long, review_id string, product_id string, source string, rating int, "
    "sentiment string, date string, ingested_at timestamp_ntz, pos int, theme string"
)


def test_theme_trends_edge_cases(spark):
    rows = [
        (1, "a", "p", "s", 5, "Positive", "2024-01-01", None, 1, ["Call Quality", "Call Quality"]),
        (2, "b", "p", "s", None, None, "2024-01-01", None, 1, [" Sound Quality "]),
        (3, "c", "p", "s", 2, "Negative", "2024-01-01", None, 1, []),
        (4, "d", "p", "s", 1, "Negative", "2024-01-01", None, 1, None),
        (5, "e", "p", "s", 4, "Positive", "2024-01-01", None, 1, ["Sound Quality"]),
    ]
    schema = (
        "arrival_seq long, review_id string, product_id string, source string, rating int, sentiment string, "
        "date string, ingested_at timestamp_ntz, processed int, themes array<string>"
    )
    t = {r.theme: r for r in theme_trends(theme_mentions(spark.createDataFrame(rows, schema))).collect()}
    assert set(t) == {"Call Quality", "Sound Quality"}
    assert t["Call Quality"].mentions == 2 and t["Call Quality"].rating_sum == 10  # repeat counts twice
    assert t["Sound Quality"].mentions == 2 and t["Sound Quality"].rating_sum == 4  # NULL rating -> 0
    assert t["Sound Quality"].other_sentiment == 1  # NULL sentiment -> 'unknown'
    assert t["Call Quality"].first_seen < t["Sound Quality"].first_seen and t["Call Quality"].first_pos == 0


def test_long_theme_lists_do_not_touch_the_next_review(spark):
    """A place beyond 4,096 in one list is still before the first place of the next review."""
    long = [f"T{i}" for i in range(5000)]
    rows = [(1, "a", "p", "s", 5, "Positive", "2024-01-01", None, 1, long), (2, "b", "p", "s", 5, "Positive", "2024-01-01", None, 1, ["X"])]
    schema = (
        "arrival_seq long, review_id string, product_id string, source string, rating int, sentiment string, "
        "date string, ingested_at timestamp_ntz, processed int, themes array<string>"
    )
    trends = theme_trends(theme_mentions(spark.createDataFrame(rows, schema)))
    order = [r.theme for r in trends.orderBy(*R.trend_order()).collect()]
    assert order == [*long, "X"]


def _trends(spark, rows):
    return spark.createDataFrame(
        rows, "theme string, mentions long, positive long, negative long, avg_rating double, first_seen long, first_pos int"
    )


def test_top_k_then_drop_zero(spark):
    rows = [(f"T{i}", 10 - i, 5 if i < 2 else 0, i, 3.0, i, 0) for i in range(6)]
    got = R.messaging_opportunities(_trends(spark, rows)).collect()
    assert [r.theme for r in got] == ["T0", "T1"]  # top 5 first, then the zero rows go
    assert [r.theme for r in R.faq_candidates(_trends(spark, rows)).collect()] == ["T0", "T1", "T2", "T3", "T4"]


def test_critical_and_wins_thresholds(spark):
    rows = [("A", 10, 3, 1, 3.0, 1, 0), ("B", 10, 2, 2, 3.0, 2, 0)]  # 10% negative is not > 10%
    crit = [r.theme for r in R.critical_issues(_trends(spark, rows)).collect()]
    wins = [r.theme for r in R.wins(_trends(spark, rows)).collect()]
    assert crit == ["B"] and wins == ["A"]  # 20% positive is not > 20%


def test_weekly_spikes_rules(spark):
    def mentions(theme, n, date, start):
        return [(start + i, f"{theme}{date}{i}", "p", "s", 3, "Neutral", date, None, 0, theme) for i in range(n)]

    rows = []
    rows += mentions("A", 26, "2024-02-21", 0) + mentions("A", 38, "2024-02-14", 1000)
    rows += mentions("B", 12, "2024-02-21", 2000) + mentions("B", 10, "2024-02-14", 3000)
    rows += mentions("C", 3, "2024-02-21", 4000)
    rows += mentions("D", 2, "2024-02-21", 5000)
    m = spark.createDataFrame(rows, MENTION_SCHEMA)
    got = {r.theme: r for r in weekly_spikes(m, "2024-02-27", mode="intended").collect()}
    assert (got["A"].alert, got["A"].change_pct) == ("DOWN", -32)
    assert got["B"].alert is None and got["B"].change_pct == 20
    assert got["C"].alert == "NEW TREND"
    assert got["D"].alert is None
    # observed: the previous window has no upper bound, so it contains this week
    obs = {r.theme: r for r in weekly_spikes(m, "2024-02-27", mode="observed").collect()}
    assert obs["C"].prev_count == 3 and obs["C"].alert is None


def test_quotes_observed_and_intended(spark):
    rows = [
        (1, "a", "p1", "s", 1, "Negative", "2024-01-01", None, 0, "Call Quality"),
        (2, "b", "p0", "s", 1, "Negative", "2024-01-01", None, 0, "Call Quality"),
    ]
    texts = spark.createDataFrame([(1, "first overall"), (2, "x" * 200)], "arrival_seq long, text string")
    m = spark.createDataFrame(rows, MENTION_SCHEMA).join(texts, "arrival_seq")
    t = theme_trends(m)
    obs = R.critical_issues(t, R.first_quotes(m, ["product_id"]), "p0").first()
    assert obs.quote == "x" * 150 + "…"  # fixed product p0, truncated with an ellipsis
    intended = R.critical_issues(t, R.first_quotes(m, []), None).collect()
    assert [r.quote for r in intended] == ["first overall"]  # one row, first arrival overall


def _reviews(spark, rows):
    return spark.createDataFrame(
        rows,
        "arrival_seq long, review_id string, product_id string, source string, rating int, sentiment string, date string, "
        "ingested_at timestamp_ntz, processed int, themes array<string>, text string",
    )


def test_report_documents_round_trip(spark, tmp_path):
    import datetime as dt

    from revq.plans.reports import global_report, read_reports, report_context, weekly_report

    t0 = dt.datetime(2024, 2, 22)
    rows = [
        (1, "a", "p0", "s", 1, "Negative", "2024-02-21", t0, 1, ["Call Quality"], "bad\n- **Call** line\n  indented\n\n## no heading"),
        (2, "b", "p0", "s", 5, "Positive", "2024-02-21", t0, 1, ["Call Quality", "Sound Quality"], ""),
        (3, "c", "p1", "s", 1, "Negative", "2024-02-22", t0, 1, ["Call Quality"], None),
        (4, "d", "p1", "s", None, None, None, t0, 0, None, "x" * 200),
    ]
    r = _reviews(spark, rows)
    p = spark.createDataFrame([("p0", "Product 0"), ("p1", "Product 1"), ("p2", "Without reviews")], "product_id string, name string")
    for make, name in ((lambda **k: global_report(r, p, "p0", **k), "global"), (lambda **k: weekly_report(r, p, "2024-02-27", quote_product="p0", **k), "weekly")):
        plain = make()["lines"].collect()
        back = make(path=str(tmp_path / name))
        assert sorted(map(tuple, plain)) == sorted(map(tuple, back["lines"].select("section", "ord", "line").collect()))
        assert sum(s.count() for k, s in back.items() if k != "lines") == len(plain)
        assert any("Without reviews" in x.line for x in plain)
    critical = [x.line for x in global_report(r, p, "p0")["critical_issues"].collect()]
    assert any("bad\n- **Call** line" in x for x in critical)
    both = read_reports(spark, str(tmp_path / "global"), str(tmp_path / "weekly"), str(tmp_path / "none"))
    assert {x.document for x in both.collect()} == {"global", "weekly"}
    context = report_context(spark, str(tmp_path / "weekly"), str(tmp_path / "global")).first().context
    assert context.startswith("--- global ---\n# Review Intelligence Report") and "--- weekly ---\n# Weekly change report" in context
    assert read_reports(spark, str(tmp_path / "none")).collect() == []


def test_reports_of_an_empty_store(spark):
    from revq.plans.reports import global_report, weekly_report

    p = spark.createDataFrame([("p0", "Product 0")], "product_id string, name string")
    lines = global_report(_reviews(spark, []), p)["lines"].collect()
    assert [x.line for x in lines if x.section == 1 and x.ord == 1] == ["| Product 0 | 0 | 0.0/5 | 0% | N/A | N/A |"]
    assert [x.line for x in lines if (x.section, x.ord) == (0, 1)] == ["Total reviews: 0 | Period: N/A to N/A"]
    weekly = weekly_report(_reviews(spark, []), p, "2024-02-27")
    assert [x.line for x in weekly["per_product"].collect() if "Product 0" in x.line]
    assert "New reviews this week: 0 | vs last week: N/A" in weekly["head"].first().line
    assert "No significant spikes detected this week." in [x.line for x in weekly["spikes"].collect()]
