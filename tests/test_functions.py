"""Scalar rules on hand-built micro-tables (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from revq.functions.classify import keyword_themes, match_blob, rating_confidence, rating_sentiment
from revq.functions.dates import normalize_date
from revq.functions.keys import clean_title, parse_rating, review_key, url_tail
from revq.functions.labels import sanitize_answer
from revq.functions.text import py_strip, safe_pct, truncate


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_dates(spark):
    cases = {
        "5 March 2024": "2024-03-05",
        "5 Mar 2024": "2024-03-05",
        "March 5, 2024": "2024-03-05",
        "Mar 05, 2024": "2024-03-05",
        "05-03-2024": "2024-03-05",
        "05/03/2024": "2024-03-05",
        "Reviewed in India on 5 March 2024": "2024-03-05",
        "Mar, 2024": "2024-03-01",
        "Certified Buyer, March, 2024": "2024-03-01",
        # unparsed: the raw text is kept
        "5 March 24": "5 March 24",
        "31 February 2024": "31 February 2024",
        "3 months ago": "3 months ago",
        "": "",
        "Reviewed in the United States on March 5, 2024": "Reviewed in the United States on March 5, 2024",
    }
    got = _one(spark, [(k,) for k in cases], "raw string", normalize_date("raw"))
    assert got == list(cases.values())


def test_percent_half_even(spark):
    rows = [(9, 40), (31, 40), (1, 200), (6, 52), (5, 0)]
    got = _one(spark, rows, "n long, d long", safe_pct("n", "d"))
    assert got == [22, 78, 0, 12, 0]


def test_three_averages(spark):
    """{5, 0, NULL}: trend avg 1.667, summary avg 2.5, weekly avg 5.0."""
    df = spark.createDataFrame([(5,), (0,), (None,)], "rating int")
    r = df.agg(
        (F.sum(F.coalesce("rating", F.lit(0))) / F.count(F.lit(1))).alias("a7"),
        F.avg("rating").alias("a10"),
        F.avg(F.nullif(F.col("rating"), F.lit(0))).alias("a22"),
    ).first()
    assert round(r.a7, 3) == 1.667 and r.a10 == 2.5 and r.a22 == 5.0


def test_keywords_substring_and_whole_word(spark):
    df = spark.createDataFrame([("hear this year", ""), ("nothing matches", ""), ("Great BASS and battery", "")], "text string, title string")
    b = df.select(match_blob("text", "title").alias("b"))
    sub = [r[0] for r in b.select(keyword_themes("b")).collect()]
    whole = [r[0] for r in b.select(keyword_themes("b", whole_word=True)).collect()]
    assert sub[0] == ["Comfort & Fit"]  # "ear" inside "hear"/"year"
    assert whole[0] == ["Sound Quality"]  # no whole word -> default
    assert sub[1] == ["Sound Quality"]  # no match -> default theme
    assert sub[2] == ["Sound Quality", "Battery Life"]  # taxonomy order


def test_sentiment_and_confidence(spark):
    df = spark.createDataFrame([(5,), (4,), (3,), (2,), (1,), (0,), (None,)], "rating int")
    got = df.select(rating_sentiment("rating"), rating_confidence("rating")).collect()
    assert [r[0] for r in got] == ["Positive", "Positive", "Neutral", "Negative", "Negative", "Negative", "Neutral"]
    assert [r[1] for r in got] == [0.85, 0.65, 0.65, 0.65, 0.85, 0.65, 0.65]


def test_rating_title_url_strip(spark):
    assert _one(spark, [("4.5 out of 5 stars",), ("abc",), ("5",)], "s string", parse_rating("s")) == [4, None, 5]
    assert _one(spark, [("5.0 out of 5 stars Great",), ("Plain",)], "s string", clean_title("s")) == ["Great", "Plain"]
    urls = [("https://x.com/gp/profile/amzn1.account.ABC?ref=x",), ("https://x.com/a/ref=cm_cr",)]
    assert _one(spark, urls, "u string", url_tail("u")) == ["amzn1.account.ABC", "ref=cm_cr"]
    assert _one(spark, [("\t x \n",), (" y ",)], "s string", py_strip("s")) == ["x", "y"]
    assert _one(spark, [("a" * 151,), ("short",)], "s string", truncate("s", 150)) == ["a" * 150 + "…", "short"]


def test_review_key_md5(spark):
    import hashlib

    got = _one(spark, [("u1", "2024-01-02", "prod_0")], "r string, d string, p string", review_key("r", "d", "p"))
    assert got == [hashlib.md5(b"u12024-01-02prod_0").hexdigest()]


def test_sanitize_answers(spark):
    cases = [
        ('{"sentiment":"Positive","themes":["Call Quality","Bogus"],"confidence":0.9}', ("Positive", ["Call Quality"], 0.9, False)),
        ('```json\n{"sentiment":"Negative","themes":["Sound Quality"],"confidence":"0.7"}\n```', ("Negative", ["Sound Quality"], 0.7, False)),
        ('{"sentiment":"Mixed"}', ("Neutral", ["Sound Quality"], 0.5, False)),
        ('{"themes":null}', ("Neutral", ["Sound Quality"], 0.1, True)),
        ('{"themes":"Call Quality"}', ("Neutral", ["Sound Quality"], 0.5, False)),
        ('{"confidence":"abc"}', ("Neutral", ["Sound Quality"], 0.1, True)),
        ('{"confidence":7}', ("Neutral", ["Sound Quality"], 1.0, False)),
        ('[{"sentiment":"Positive"}]', ("Neutral", ["Sound Quality"], 0.1, True)),
        ("not json", ("Neutral", ["Sound Quality"], 0.1, True)),
        ('{"confidence": NaN}', ("Neutral", ["Sound Quality"], 1.0, False)),
        ('{"confidence": -Infinity, "sentiment": "Positive"}', ("Positive", ["Sound Quality"], 0.0, False)),
    ]
    got = _one(spark, [(c[0],) for c in cases], "raw string", sanitize_answer("raw"))
    assert [tuple(g) for g in got] == [c[1] for c in cases]


def test_parse_rating_odd_numbers(spark):
    from revq.functions.keys import parse_rating

    cases = {"4.5 out of 5 stars": 4, "99999999999 out of 5": None, "4d out of 5": None, "4.5f": None, "nan": None, "-1.9 x": -1, "": None}
    df = spark.createDataFrame(list(cases.items()), "s string, want int")
    assert all(r.got == r.want for r in df.select("want", parse_rating("s").alias("got")).collect())


def test_labels_are_made_below_the_dedup(spark):
    """No exchange of the theme table carries the text."""
    import re

    from revq.plans import catalog

    plan = catalog.QUERIES["theme_trends"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scans = [x for x in lines if "FileScan" in x and "text#" in x]
    assert scans and not any(re.search(r"\btext#|title#", x) for x in lines if "Exchange" in x or re.search(r"\bSort \[", x))
    at = next(i for i, x in enumerate(lines) if "text#" in x and "FileScan" in x)
    between = [x for x in lines[:at] if "Exchange" in x]
    assert between  # the shuffle stands above the projection that reads the text
    projected = [x for x in lines if re.search(r"Project \[.*text#\d+", x) and "contains" not in x.lower() and "coalesce(text" not in x]
    assert not projected or all("AS" in x for x in projected)


def test_answer_types_decide(spark):
    """Nested keys and texts that look like other types do not change an answer's reading."""
    cases = [
        ('{"x": {"themes": null}, "sentiment": "Positive", "themes": ["Battery Life"], "confidence": 0.8}', "Positive", ["Battery Life"], 0.8, False),
        ('{"sentiment": "Positive", "themes": "[\\"Battery Life\\"]", "confidence": 0.8}', "Positive", None, 0.8, False),
        ('{"sentiment": "Positive", "themes": ["Battery Life"], "confidence": "0.9f"}', None, None, None, True),
        ('{"sentiment": "Positive", "themes": ["Battery Life"], "confidence": " 0.9 "}', "Positive", ["Battery Life"], 0.9, False),
        ('{"sentiment": "Positive", "themes": ["Battery Life", 3, null], "confidence": true}', "Positive", ["Battery Life"], 1.0, False),
        ('{"sentiment": "Positive", "themes": {"Battery Life": 1}}', "Positive", ["Battery Life"], 0.5, False),
        ('{"sentiment": "Positive", "themes": null}', None, None, None, True),
        ('{"sentiment": 3, "themes": [], "confidence": NaN}', "Neutral", None, 1.0, False),
        ("[1]", None, None, None, True),
        ("", None, None, None, True),
        (None, None, None, None, True),
    ]
    from pyspark.sql import functions as F

    from revq.functions.labels import sanitize_answer
    from revq.schema import FALLBACK_CONFIDENCE, FALLBACK_SENTIMENT, FALLBACK_THEMES

    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, raw string")
    got = {r.k: r.a for r in df.select("k", sanitize_answer(F.col("raw")).alias("a")).collect()}
    for k, (raw, sentiment, themes, confidence, fallback) in enumerate(cases):
        if fallback:
            sentiment, confidence = FALLBACK_SENTIMENT, FALLBACK_CONFIDENCE
        want = (sentiment, themes or list(FALLBACK_THEMES), confidence, fallback)
        assert (got[k].sentiment, got[k].themes, got[k].confidence, got[k].fallback) == want, raw
