"""Pluggable scorer (I7), batch alignment (I6) and analysis write-back."""

import json

import pandas as pd

from revq.operators.classify import apply_analysis, batch_align, classify_batch


def test_pluggable_scorer(spark):
    # defined inside the test: closures are shipped to the Python workers by value
    def _scorer(batches):
        """Stands in for a model: answers as JSON text, some fenced, one broken."""
        for pdf in batches:
            out = []
            for rid, text in zip(pdf["review_id"], pdf["text"]):
                if "broken" in text:
                    raw = "{not json"
                else:
                    raw = json.dumps({"sentiment": "Positive" if "good" in text else "Negative", "themes": ["Battery Life", "Nope"], "confidence": 2})
                    if "fence" in text:
                        raw = "```json\n" + raw + "\n```"
                out.append((rid, raw))
            yield pd.DataFrame(out, columns=["review_id", "raw"])

    df = spark.createDataFrame(
        [("r1", "good battery", "", 5), ("r2", "bad, fence", "", 1), ("r3", "broken answer", "", 3)],
        "review_id string, text string, title string, rating int",
    )
    got = {r.review_id: r for r in classify_batch(df, scorer=_scorer, classifier="model").collect()}
    assert (got["r1"].sentiment, got["r1"].themes, got["r1"].confidence) == ("Positive", ["Battery Life"], 1.0)
    assert got["r2"].sentiment == "Negative"
    assert (got["r3"].sentiment, got["r3"].themes, got["r3"].confidence) == ("Neutral", ["Sound Quality"], 0.1)
    assert {r.classifier for r in got.values()} == {"model"}


def test_batch_align_by_key(spark):
    ans = lambda s: {"sentiment": s, "themes": ["Call Quality"], "confidence": 0.8}
    assign = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d"), (2, 1, "e"), (2, 2, "f"), (3, 0, "g"), (3, 1, "h"), (3, 2, "i")],
        "batch_id long, pos int, review_id string",
    )
    answers = spark.createDataFrame(
        [
            (1, json.dumps([ans("Positive"), ans("Negative")])),  # one short
            (2, json.dumps([ans("Positive")] * 4)),  # one extra: dropped
            (3, '[{"sentiment": "Positive"'),  # broken: all fallback
        ],
        "batch_id long, raw string",
    )
    got = {r.review_id: (r.sentiment, r.fallback) for r in batch_align(assign, answers).collect()}
    assert got["a"] == ("Positive", False) and got["b"] == ("Negative", False) and got["c"] == ("Neutral", True)
    assert all(got[k] == ("Positive", False) for k in "def")
    assert all(got[k] == ("Neutral", True) for k in "ghi")


def test_latest_analysis_wins(spark):
    raw = spark.createDataFrame([("a", 1), ("b", 2)], "review_id string, arrival_seq long")
    analysis = spark.createDataFrame(
        [
            ("a", "Negative", ["Sound Quality"], 0.5, "r", "2024-01-01 00:00:00"),
            ("a", "Positive", ["Call Quality"], 0.9, "r", "2024-01-02 00:00:00"),
            ("zz", "Positive", ["Call Quality"], 0.9, "r", "2024-01-02 00:00:00"),  # unknown key: no-op
        ],
        "review_id string, sentiment string, themes array<string>, confidence double, classifier string, analyzed_at string",
    ).withColumn("analyzed_at", __import__("pyspark.sql.functions", fromlist=["col"]).col("analyzed_at").cast("timestamp_ntz"))
    v = {r.review_id: r for r in apply_analysis(raw, analysis).collect()}
    assert set(v) == {"a", "b"}
    assert (v["a"].sentiment, v["a"].processed) == ("Positive", 1)
    assert (v["b"].sentiment, v["b"].processed) == (None, 0)
