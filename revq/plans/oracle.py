"""Independent DuckDB SQL for every query with an exact oracle.

Each string runs in DuckDB over the driver's pre-registered views. The base
CTEs re-derive the store and its labels in plain SQL (window first-wins,
CASE keyword rules) so the Spark plans are checked against a second engine.
"""

from __future__ import annotations

from revq.sources.fixtures import REVIEWS_IN_SQL

# --- fixed values, stated here once more: the oracle takes no rule from the engine
THEMES = [
    ("Sound Quality", ["sound", "audio", "bass", "treble", "vocal", "driver"]),
    ("Battery Life", ["battery", "charge", "hours"]),
    ("Comfort & Fit", ["comfort", "fit", "ear"]),
    ("ANC (Active Noise Cancellation)", ["anc", "noise cancel", "noise"]),
    ("App Experience", ["app", "eq"]),
    ("Price & Value", ["price", "value", "money", "worth"]),
    ("Build Quality", ["build", "plastic", "quality"]),
    ("Delivery & Packaging", ["delivery", "packaging"]),
    ("Call Quality", ["call", "mic", "microphone"]),
    ("Connectivity (Bluetooth)", ["bluetooth", "connect", "disconnect", "pair"]),
    ("Heat & Sweat Resistance", ["sweat", "gym", "workout", "water"]),
]
DEFAULT_THEME = "Sound Quality"
ROUTE_SQL = """CASE
  WHEN contains(lower(text), 'anc') AND contains(lower(text), 'product 1') THEN 'theme_by_sentiment'
  WHEN contains(lower(text), 'battery life complaints') AND contains(lower(text), 'compare') THEN 'complaints_by_product'
  WHEN contains(lower(text), '1-star') AND (contains(lower(text), 'top') OR contains(lower(text), 'reasons')) THEN 'one_star_reasons'
  WHEN contains(lower(text), 'comfort') AND contains(lower(text), 'better') THEN 'praise_by_product'
  ELSE 'total_reviews' END"""
# --- end of fixed values

AS_OF = "2024-02-27"
FRESH_AS_OF = "2024-03-10"
SINCE = "2024-02-01"
LOAD_SPLIT = "2024-02-01"
PRODUCT = "prod_1"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _theme_list_sql(blob: str = "b") -> str:
    parts = []
    for theme, kws in THEMES:
        cond = " OR ".join(f"contains({blob}, {_lit(k)})" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN {_lit(theme)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _themes_sql(hits: str = "h") -> str:
    return f"CASE WHEN len({hits}) > 0 THEN {hits}[1:3] ELSE [{_lit(DEFAULT_THEME)}] END"


SENT_SQL = "CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' ELSE 'Neutral' END"
CONF_SQL = "CASE WHEN rating IN (1, 5) THEN 0.85 ELSE 0.65 END"

BASE = f"""
reviews_in AS ({REVIEWS_IN_SQL}),
store AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS rn
    FROM reviews_in WHERE review_id IS NOT NULL) t
  WHERE rn = 1),
hits AS (
  SELECT *, {_theme_list_sql()} AS h
  FROM (SELECT *, lower(concat(coalesce(text, ''), ' ', coalesce(title, ''))) AS b FROM store) s0),
reviews AS (
  SELECT arrival_seq, product_id, reviewer_id, review_id, rating, title, text, date, source,
         ingested_at, processed,
         CASE WHEN processed = 1 THEN {SENT_SQL} END AS sentiment,
         CASE WHEN processed = 1 THEN {_themes_sql()} END AS themes,
         CASE WHEN processed = 1 THEN {CONF_SQL} END AS confidence
  FROM hits),
mentions AS (
  SELECT arrival_seq, review_id, product_id, source, rating, sentiment, date, ingested_at,
         regexp_replace(theme, '^\\s+|\\s+$', '', 'g') AS theme, pos
  FROM (SELECT *, unnest(themes) AS theme, generate_subscripts(themes, 1) - 1 AS pos
        FROM reviews WHERE processed = 1 AND themes IS NOT NULL) u),
products AS (
  SELECT DISTINCT product_id, regexp_replace(product_id, '^prod_', 'Product ') AS name FROM store)
"""


def trends_sql(src: str = "mentions", by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""
  SELECT {g}theme, count(*) AS mentions,
         CAST(sum(coalesce(rating, 0)) AS BIGINT) AS rating_sum,
         count(*) FILTER (WHERE coalesce(sentiment, 'unknown') = 'Positive') AS positive,
         count(*) FILTER (WHERE coalesce(sentiment, 'unknown') = 'Negative') AS negative,
         count(*) FILTER (WHERE coalesce(sentiment, 'unknown') = 'Neutral') AS neutral,
         count(*) FILTER (WHERE coalesce(sentiment, 'unknown') NOT IN ('Positive','Negative','Neutral')) AS other_sentiment,
         min(arrival_seq) AS first_seen, arg_min(pos, struct_pack(a := arrival_seq, p := pos))::INTEGER AS first_pos,
         round_even(CAST(sum(coalesce(rating, 0)) AS DOUBLE) / count(*), 2) AS avg_rating
  FROM {src} GROUP BY {g}theme"""


def with_base(body: str, extra: str = "") -> str:
    ctes = BASE + (",\n" + extra if extra else "")
    return f"WITH {ctes}\n{body}"


def pct(n: str, d: str) -> str:
    return f"CAST(CASE WHEN {d} = 0 THEN 0 ELSE round_even(CAST({n} AS DOUBLE) * 100.0 / {d}, 0) END AS BIGINT)"
