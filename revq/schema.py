"""Schemas and small fixed dimensions.

The taxonomy, keyword map, fallback label and sentiment names below are
fixed values: classification results must equal the reference's, so they
are stated here verbatim, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the reference) --------------------------------
THEME_TAXONOMY = [
    "Sound Quality",
    "Battery Life",
    "Comfort & Fit",
    "ANC (Active Noise Cancellation)",
    "App Experience",
    "Price & Value",
    "Build Quality",
    "Delivery & Packaging",
    "Call Quality",
    "Connectivity (Bluetooth)",
    "Heat & Sweat Resistance",
]

# keyword -> theme, substring rules, in the reference's order
KEYWORD_THEMES = [
    ("sound", "Sound Quality"),
    ("audio", "Sound Quality"),
    ("bass", "Sound Quality"),
    ("treble", "Sound Quality"),
    ("vocal", "Sound Quality"),
    ("driver", "Sound Quality"),
    ("battery", "Battery Life"),
    ("charge", "Battery Life"),
    ("hours", "Battery Life"),
    ("comfort", "Comfort & Fit"),
    ("fit", "Comfort & Fit"),
    ("ear", "Comfort & Fit"),
    ("anc", "ANC (Active Noise Cancellation)"),
    ("noise cancel", "ANC (Active Noise Cancellation)"),
    ("noise", "ANC (Active Noise Cancellation)"),
    ("app", "App Experience"),
    ("eq", "App Experience"),
    ("price", "Price & Value"),
    ("value", "Price & Value"),
    ("money", "Price & Value"),
    ("worth", "Price & Value"),
    ("build", "Build Quality"),
    ("plastic", "Build Quality"),
    ("quality", "Build Quality"),
    ("delivery", "Delivery & Packaging"),
    ("packaging", "Delivery & Packaging"),
    ("call", "Call Quality"),
    ("mic", "Call Quality"),
    ("microphone", "Call Quality"),
    ("bluetooth", "Connectivity (Bluetooth)"),
    ("connect", "Connectivity (Bluetooth)"),
    ("disconnect", "Connectivity (Bluetooth)"),
    ("pair", "Connectivity (Bluetooth)"),
    ("sweat", "Heat & Sweat Resistance"),
    ("gym", "Heat & Sweat Resistance"),
    ("workout", "Heat & Sweat Resistance"),
    ("water", "Heat & Sweat Resistance"),
]

SENTIMENTS = ["Positive", "Negative", "Neutral"]
UNKNOWN_SENTIMENT = "unknown"

# answer used when a model answer cannot be read at all
FALLBACK_SENTIMENT = "Neutral"
FALLBACK_THEMES = ["Sound Quality"]
FALLBACK_CONFIDENCE = 0.1
DEFAULT_CONFIDENCE = 0.5

# the keyword classifier picks a random theme when nothing matches; we use a
# fixed default so that results are reproducible
DEFAULT_THEME = "Sound Quality"

# report thresholds (strict comparisons)
CRITICAL_NEG_SHARE = 0.10
WIN_POS_SHARE = 0.20
SPIKE_PCT = 20
NEW_TREND_MIN = 3

# report texts and cuts
NO_VALUE = "N/A"
NO_QUOTE = "No matching review found."
NO_PREVIOUS_WEEK = "N/A (no previous week data)"
NO_THEMES_YET = "No analysed data yet"
NO_SPIKES = "No significant spikes detected this week."
ACTIONS = {"UP": "Investigate root cause and prioritise fix", "DOWN": "Monitor — trend improving"}
QUOTE_CHARS = 150
ELLIPSIS = "…"
# --- end of fixed values -----------------------------------------------------


def keywords_by_theme() -> list[tuple[str, list[str]]]:
    """Group the keyword map by theme, in taxonomy order."""
    out: dict[str, list[str]] = {t: [] for t in THEME_TAXONOMY}
    for kw, theme in KEYWORD_THEMES:
        out[theme].append(kw)
    return [(t, kws) for t, kws in out.items() if kws]


REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("arrival_seq", T.LongType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
    ]
)

ANALYSIS_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("themes", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("classifier", T.StringType()),
        T.StructField("analyzed_at", T.TimestampNTZType()),
    ]
)

INGESTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_date", T.TimestampNTZType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("new_reviews", T.LongType()),
        T.StructField("total_reviews", T.LongType()),
    ]
)

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_date", T.DateType()),
        T.StructField("run_timestamp", T.TimestampNTZType()),
        T.StructField(
            "products",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("new_reviews", T.LongType()),
                        T.StructField("sources", T.MapType(T.StringType(), T.LongType())),
                    ]
                ),
            ),
        ),
        T.StructField("total_new", T.LongType()),
        T.StructField("total_in_db", T.LongType()),
    ]
)


def taxonomy_df(spark: SparkSession) -> DataFrame:
    """Theme dimension (theme, ord); 11 rows."""
    return spark.createDataFrame(
        [(t, i) for i, t in enumerate(THEME_TAXONOMY)], "theme string, ord int"
    )


def keyword_df(spark: SparkSession) -> DataFrame:
    """Keyword dimension (keyword, theme, ord); 37 rows."""
    return spark.createDataFrame(
        [(k, t, i) for i, (k, t) in enumerate(KEYWORD_THEMES)],
        "keyword string, theme string, ord int",
    )
