"""Query catalog: every registered query with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Column names are aliased identically on both sides. Queries without an
oracle entry are checked on row counts only (non-SQL operators).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.operators import report as R
from revq.operators import stats as S
from revq.operators import weekly as W
from revq.operators.mentions import filter_mentions, theme_by_source, theme_mentions, theme_sentiment, theme_trends, theme_trends_of
from revq.plans import oracle as O
from revq.plans.oracle import AS_OF, FRESH_AS_OF, PRODUCT, SINCE, pct, trends_sql, with_base
from revq.plans.base import mentions as _mentions
from revq.plans.base import reviews as _reviews
from revq.plans.base import report_reviews as _mat
from revq.sources.fixtures import reviews_in, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


TREND_COLS = "theme, mentions, rating_sum, avg_rating, positive, negative, neutral, other_sentiment, first_seen, first_pos"


def _trends(spark, sf, by=None):
    return theme_trends(_mentions(spark, sf), by=by)


def _products(spark, sf):
    """Products seen in the batch = products of the store (every product has
    a first row); read from the narrow batch columns, not the deduped store."""
    return S.products_dim(reviews_in(spark, sf))


# ---------------------------------------------------------------- theme trends
@register("theme_trends", with_base(f"SELECT {TREND_COLS} FROM ({trends_sql()}) t"))
def q_theme_trends(spark, sf):
    return _trends(spark, sf).select(*TREND_COLS.split(", "))


@register(
    "theme_trends_by_product",
    with_base(f"SELECT product_id, {TREND_COLS} FROM ({trends_sql(by='product_id')}) t"),
)
def q_theme_trends_by_product(spark, sf):
    return _trends(spark, sf, by=["product_id"]).select("product_id", *TREND_COLS.split(", "))


@register(
    "theme_trends_since",
    with_base(
        f"SELECT {TREND_COLS} FROM ({trends_sql(src='m2')}) t",
        f"m2 AS (SELECT * FROM mentions WHERE date >= '{SINCE}')",
    ),
)
def q_theme_trends_since(spark, sf):
    m = filter_mentions(_mentions(spark, sf), since=SINCE)
    return theme_trends(m).select(*TREND_COLS.split(", "))


@register(
    "theme_trends_since_intended",
    with_base(
        f"SELECT {TREND_COLS} FROM ({trends_sql(src='m2')}) t",
        f"m2 AS (SELECT * FROM mentions WHERE TRY_CAST(date AS DATE) >= DATE '{SINCE}')",
    ),
)
def q_theme_trends_since_intended(spark, sf):
    m = filter_mentions(_mentions(spark, sf), since=SINCE, mode="intended")
    return theme_trends(m).select(*TREND_COLS.split(", "))


@register(
    "theme_trends_json",
    with_base(
        f"SELECT {TREND_COLS} FROM ({trends_sql(src='mj')}) t",
        "mj AS (SELECT * FROM mentions WHERE arrival_seq % 13 NOT IN (5, 7, 11))",
    ),
)
def q_theme_trends_json(spark, sf):
    """Themes stored as JSON text, as the reference keeps them; some rows hold
    '', invalid JSON or NULL (by arrival) and are skipped."""
    from revq.operators.mentions import themes_from_json

    r = _reviews(spark, sf)
    v = F.col("arrival_seq") % 13
    js = (
        F.when(v == 5, F.lit(""))
        .when(v == 7, F.lit("[not json"))
        .when(v == 11, F.lit(None).cast("string"))
        .otherwise(F.to_json("themes"))
    )
    stored = r.withColumn("themes_json", js).drop("themes")
    back = stored.withColumn("themes", themes_from_json("themes_json"))
    return theme_trends(theme_mentions(back)).select(*TREND_COLS.split(", "))


@register(
    "theme_sentiment",
    with_base(
        "SELECT theme, coalesce(sentiment, 'unknown') AS sentiment, count(*) AS n "
        "FROM mentions GROUP BY theme, coalesce(sentiment, 'unknown')"
    ),
)
def q_theme_sentiment(spark, sf):
    return theme_sentiment(_mentions(spark, sf))


@register(
    "theme_by_source",
    with_base("SELECT theme, source, count(*) AS n FROM mentions GROUP BY theme, source"),
)
def q_theme_by_source(spark, sf):
    return theme_by_source(_mentions(spark, sf))


@register(
    "theme_table",
    with_base(
        f"SELECT theme, mentions, {pct('positive', 'mentions')} AS pos_pct, "
        f"{pct('negative', 'mentions')} AS neg_pct, avg_rating, first_seen, first_pos FROM ({trends_sql()}) t"
    ),
)
def q_theme_table(spark, sf):
    return R.theme_table(_trends(spark, sf))


# ---------------------------------------------------------------------- stats
@register(
    "stats_overview",
    with_base(
        "SELECT count(*) AS total_reviews, count(*) FILTER (WHERE processed = 1) AS processed_count, "
        "count(*) FILTER (WHERE processed = 0) AS unprocessed_count FROM reviews"
    ),
)
def q_stats_overview(spark, sf):
    return S.stats_overview(_reviews(spark, sf))


@register("stats_by_product", with_base("SELECT product_id, count(*) AS cnt FROM reviews GROUP BY product_id"))
def q_stats_by_product(spark, sf):
    return S.count_by(_reviews(spark, sf), "product_id")


@register(
    "stats_by_sentiment",
    with_base("SELECT sentiment, count(*) AS cnt FROM reviews WHERE sentiment IS NOT NULL GROUP BY sentiment"),
)
def q_stats_by_sentiment(spark, sf):
    return S.count_by(_reviews(spark, sf), "sentiment", drop_null=True)


@register("stats_by_source", with_base("SELECT source, count(*) AS cnt FROM reviews GROUP BY source"))
def q_stats_by_source(spark, sf):
    return S.count_by(_reviews(spark, sf), "source")


@register(
    "stats_grouping_sets",
    with_base(
        """SELECT CASE g WHEN 7 THEN 'product_id' WHEN 11 THEN 'sentiment' WHEN 13 THEN 'source'
                        WHEN 14 THEN 'processed' ELSE 'total' END AS dimension,
                  CASE g WHEN 7 THEN product_id WHEN 11 THEN sentiment WHEN 13 THEN source
                        WHEN 14 THEN processed END AS value,
                  cnt
           FROM (SELECT product_id, sentiment, source, CAST(processed AS VARCHAR) AS processed,
                        count(*) AS cnt, GROUPING(product_id, sentiment, source, processed) AS g
                 FROM reviews
                 GROUP BY GROUPING SETS ((product_id), (sentiment), (source), (processed), ())) t"""
    ),
)
def q_stats_grouping_sets(spark, sf):
    return S.stats_grouping_sets(_reviews(spark, sf))


@register(
    "stats_pct",
    with_base(
        f"""SELECT sentiment, cnt, {pct('cnt', 'total')} AS pct,
                  repeat('█', CAST(floor({pct('cnt', 'total')} / 5) AS INTEGER)) AS bar
           FROM (SELECT sentiment, cnt, sum(cnt) OVER () AS total FROM
                 (SELECT sentiment, count(*) AS cnt FROM reviews WHERE sentiment IS NOT NULL GROUP BY sentiment) a) b"""
    ),
)
def q_stats_pct(spark, sf):
    return S.stats_pct(S.count_by(_reviews(spark, sf), "sentiment", drop_null=True), "sentiment")


@register(
    "stats_named",
    with_base(
        "SELECT c.product_id, coalesce(p.name, c.product_id) AS name, c.cnt "
        "FROM (SELECT product_id, count(*) AS cnt FROM reviews GROUP BY product_id) c "
        "LEFT JOIN products p ON c.product_id = p.product_id"
    ),
)
def q_stats_named(spark, sf):
    r = _reviews(spark, sf)
    return S.stats_named(r, _products(spark, sf))


INGEST_LOG_SQL = """ilog AS (
  SELECT run_date, product_id, new_reviews,
         CAST(sum(new_reviews) OVER (PARTITION BY product_id ORDER BY run_date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_reviews
  FROM (SELECT CAST(ingested_at AS DATE) AS run_date, product_id, count(*) AS new_reviews
        FROM reviews GROUP BY 1, 2) r)"""


@register(
    "ingestion_log",
    with_base("SELECT run_date, product_id, new_reviews, total_reviews FROM ilog", INGEST_LOG_SQL),
)
def q_ingestion_log(spark, sf):
    return S.ingestion_log(_reviews(spark, sf))


@register("last_ingestion", with_base("SELECT max(run_date) AS last_run FROM ilog", INGEST_LOG_SQL))
def q_last_ingestion(spark, sf):
    return S.last_ingestion(S.ingestion_log(_reviews(spark, sf)))


def _freshness_sql(as_of: str) -> str:
    return with_base(
        f"""SELECT last_run, CAST(DATE '{as_of}' - last_run AS INTEGER) AS days_since,
                  (last_run IS NULL OR DATE '{as_of}' - last_run > 6) AS is_stale
           FROM (SELECT max(run_date) AS last_run FROM ilog) t""",
        INGEST_LOG_SQL,
    )


@register("freshness_recent", _freshness_sql("2024-03-03"))
def q_freshness_recent(spark, sf):
    return S.freshness(S.ingestion_log(_reviews(spark, sf)), "2024-03-03")


@register("freshness", _freshness_sql(FRESH_AS_OF))
def q_freshness(spark, sf):
    return S.freshness(S.ingestion_log(_reviews(spark, sf)), FRESH_AS_OF)


# ---------------------------------------------------------------- global report
@register(
    "date_extent",
    with_base(
        "SELECT min(date) AS earliest, max(date) AS latest, min(TRY_CAST(date AS DATE)) AS earliest_date, "
        "max(TRY_CAST(date AS DATE)) AS latest_date FROM reviews"
    ),
)
def q_date_extent(spark, sf):
    return R.date_extent(_reviews(spark, sf))


PRODUCT_SUMMARY_SQL = f"""psum AS (
  SELECT p.product_id, p.name,
         coalesce(a.total_reviews, 0) AS total_reviews,
         coalesce(a.rating_sum, 0) AS rating_sum,
         coalesce(a.rated_reviews, 0) AS rated_reviews,
         coalesce(CASE WHEN a.rated_reviews > 0
                       THEN round_even(CAST(a.rating_sum AS DOUBLE) / a.rated_reviews, 1) END, 0.0) AS avg_rating,
         coalesce(a.positive, 0) AS positive, coalesce(a.negative, 0) AS negative,
         coalesce(a.neutral, 0) AS neutral,
         {pct('coalesce(a.positive, 0)', 'coalesce(a.total_reviews, 0)')} AS positive_pct
  FROM products p LEFT JOIN (
    SELECT product_id, count(*) AS total_reviews, CAST(sum(rating) AS BIGINT) AS rating_sum,
           count(rating) AS rated_reviews,
           count(*) FILTER (WHERE sentiment = 'Positive') AS positive,
           count(*) FILTER (WHERE sentiment = 'Negative') AS negative,
           count(*) FILTER (WHERE sentiment = 'Neutral') AS neutral
    FROM reviews GROUP BY product_id) a ON p.product_id = a.product_id)"""


@register(
    "product_summary",
    with_base(
        "SELECT product_id, name, total_reviews, rating_sum, rated_reviews, avg_rating, positive, negative, "
        "neutral, positive_pct FROM psum",
        PRODUCT_SUMMARY_SQL,
    ),
)
def q_product_summary(spark, sf):
    r = _reviews(spark, sf)
    return R.product_summary(r, _products(spark, sf))


TOP_SQL = f"""tp AS ({trends_sql(by='product_id')}),
topc AS (
  SELECT p.product_id,
         coalesce((SELECT theme FROM tp WHERE tp.product_id = p.product_id AND negative > 0
                   ORDER BY negative DESC, mentions DESC, first_seen, first_pos LIMIT 1), 'N/A') AS top_complaint,
         coalesce((SELECT theme FROM tp WHERE tp.product_id = p.product_id AND positive > 0
                   ORDER BY positive DESC, mentions DESC, first_seen, first_pos LIMIT 1), 'N/A') AS top_praise
  FROM products p)"""


@register("top_complaint_praise", with_base("SELECT product_id, top_complaint, top_praise FROM topc", TOP_SQL))
def q_top_complaint_praise(spark, sf):
    return R.top_complaint_praise(theme_trends(theme_mentions(_mat(spark, sf)), by=["product_id"]), _products(spark, sf))


@register(
    "exec_summary",
    with_base(
        "SELECT s.product_id, s.name, s.total_reviews, s.avg_rating, s.positive_pct, t.top_complaint, t.top_praise "
        "FROM psum s JOIN topc t ON s.product_id = t.product_id",
        PRODUCT_SUMMARY_SQL + ",\n" + TOP_SQL,
    ),
)
def q_exec_summary(spark, sf):
    return R.exec_summary(_mat(spark, sf), _products(spark, sf))


@register(
    "exec_summary_long",
    with_base(
        """SELECT metric, product_id, value FROM (
             SELECT 'total_reviews' AS metric, s.product_id, CAST(s.total_reviews AS VARCHAR) AS value FROM psum s
             UNION ALL SELECT 'avg_rating', s.product_id, concat(CAST(s.avg_rating AS VARCHAR), '/5') FROM psum s
             UNION ALL SELECT 'positive_pct', s.product_id, concat(CAST(s.positive_pct AS VARCHAR), '%') FROM psum s
             UNION ALL SELECT 'top_complaint', t.product_id, t.top_complaint FROM topc t
             UNION ALL SELECT 'top_praise', t.product_id, t.top_praise FROM topc t) u""",
        PRODUCT_SUMMARY_SQL + ",\n" + TOP_SQL,
    ),
)
def q_exec_summary_long(spark, sf):
    s = R.exec_summary(_mat(spark, sf), _products(spark, sf))
    return R.exec_summary_long(s).select("metric", "product_id", "value")


@register(
    "exec_summary_wide",
    with_base(
        """SELECT metric, max(CASE WHEN product_id = 'prod_0' THEN value END) AS prod_0, max(CASE WHEN product_id = 'prod_1' THEN value END) AS prod_1, max(CASE WHEN product_id = 'prod_2' THEN value END) AS prod_2, max(CASE WHEN product_id = 'prod_3' THEN value END) AS prod_3 FROM (
             SELECT 'total_reviews' AS metric, s.product_id, CAST(s.total_reviews AS VARCHAR) AS value FROM psum s
             UNION ALL SELECT 'avg_rating', s.product_id, concat(CAST(s.avg_rating AS VARCHAR), '/5') FROM psum s
             UNION ALL SELECT 'positive_pct', s.product_id, concat(CAST(s.positive_pct AS VARCHAR), '%') FROM psum s
             UNION ALL SELECT 'top_complaint', t.product_id, t.top_complaint FROM topc t
             UNION ALL SELECT 'top_praise', t.product_id, t.top_praise FROM topc t) u GROUP BY metric""",
        PRODUCT_SUMMARY_SQL + ",\n" + TOP_SQL,
    ),
)
def q_exec_summary_wide(spark, sf):
    """The summary table with one column per product of the product dimension."""
    return R.exec_summary_wide(q_exec_summary_long(spark, sf), R.product_list(_products(spark, sf)))


QUOTES_SQL = """quotes AS (
  SELECT f.product_id, f.theme, f.sentiment,
         CASE WHEN r.text IS NOT NULL AND r.text <> ''
              THEN concat(substr(r.text, 1, 150), CASE WHEN length(r.text) > 150 THEN '…' ELSE '' END)
              ELSE 'No matching review found.' END AS quote
  FROM (SELECT product_id, theme, sentiment, min(arrival_seq) AS arrival_seq
        FROM mentions WHERE sentiment IS NOT NULL GROUP BY product_id, theme, sentiment) f
  LEFT JOIN reviews r ON f.arrival_seq = r.arrival_seq)"""


@register("sample_quotes", with_base("SELECT product_id, theme, sentiment, quote FROM quotes", QUOTES_SQL))
def q_sample_quotes(spark, sf):
    return R.first_quotes(theme_mentions(_mat(spark, sf, with_text=True), with_text=True), ["product_id"])


QUOTE_PRODUCT = "prod_0"


@register(
    "critical_issues",
    with_base(
        f"""SELECT t.theme, negative, mentions, {pct('negative', 'mentions')} AS neg_pct, avg_rating, first_seen, first_pos,
                   coalesce(q.quote, 'No matching review found.') AS quote
            FROM ({trends_sql()}) t
            LEFT JOIN (SELECT theme, quote FROM quotes WHERE sentiment = 'Negative' AND product_id = '{QUOTE_PRODUCT}') q
              ON t.theme = q.theme
            WHERE mentions > 0 AND CAST(negative AS DOUBLE) / mentions > 0.10""",
        QUOTES_SQL,
    ),
)
def q_critical_issues(spark, sf):
    r = _mat(spark, sf, with_text=True)
    m = theme_mentions(r, with_text=True)
    quotes = R.first_quotes(m, ["product_id"])
    return R.critical_issues(theme_trends(m), quotes, QUOTE_PRODUCT)


@register(
    "wins",
    with_base(
        f"""SELECT theme, positive, mentions, {pct('positive', 'mentions')} AS pos_pct, avg_rating, first_seen, first_pos
            FROM ({trends_sql()}) t WHERE mentions > 0 AND CAST(positive AS DOUBLE) / mentions > 0.20"""
    ),
)
def q_wins(spark, sf):
    return R.wins(_trends(spark, sf))


def _top_sql(col: str, k: int, cols: str, drop_zero: bool = True) -> str:
    where = f"WHERE {col} > 0" if drop_zero else ""
    order = f"{col} DESC, mentions DESC, first_seen, first_pos" if col != "mentions" else "mentions DESC, first_seen, first_pos"
    return with_base(
        f"""SELECT {cols} FROM (
              SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
              FROM ({trends_sql()}) t ORDER BY {order} LIMIT {k}) x {where}"""
    )


@register("messaging_opportunities", _top_sql("positive", 5, "rank, theme, positive, avg_rating"))
def q_messaging(spark, sf):
    return R.messaging_opportunities(_trends(spark, sf))


@register("claims_to_retire", _top_sql("negative", 3, "rank, theme, negative"))
def q_claims(spark, sf):
    return R.claims_to_retire(_trends(spark, sf))


@register("faq_candidates", _top_sql("mentions", 5, "rank, theme, mentions", drop_zero=False))
def q_faq(spark, sf):
    return R.faq_candidates(_trends(spark, sf))


def _escalation_sql(cond: str, k: int) -> str:
    return with_base(
        f"""SELECT CAST(row_number() OVER (ORDER BY cnt DESC, themes_label) AS INTEGER) AS rank, themes_label, cnt FROM (
              SELECT array_to_string(themes, ', ') AS themes_label, count(*) AS cnt
              FROM reviews WHERE {cond} AND processed = 1 AND themes IS NOT NULL
              GROUP BY themes ORDER BY cnt DESC, themes_label LIMIT {k}) t"""
    )


@register("escalation_patterns", _escalation_sql("rating <= 2", 5))
def q_escalation(spark, sf):
    return R.escalation_patterns(_reviews(spark, sf))


@register(
    "escalation_patterns_canonical",
    with_base(
        """SELECT CAST(row_number() OVER (ORDER BY cnt DESC, themes_label) AS INTEGER) AS rank, themes_label, cnt FROM (
              SELECT array_to_string(list_sort(themes), ', ') AS themes_label, count(*) AS cnt
              FROM reviews WHERE rating <= 2 AND processed = 1 AND themes IS NOT NULL
              GROUP BY list_sort(themes) ORDER BY cnt DESC, themes_label LIMIT 5) t"""
    ),
)
def q_escalation_canonical(spark, sf):
    """A13 with order-insensitive theme sets (the same set is one group)."""
    return R.escalation_patterns(_reviews(spark, sf), canonical=True)


# ---------------------------------------------------------------------- weekly
SINCE_W, PREV_W = W.week_bounds(AS_OF)


@register(
    "weekly_volume",
    with_base(
        f"""SELECT '{SINCE_W}' AS since, this_week, prev_week,
                  CASE WHEN prev_week > 0 THEN CAST(round_even((this_week - prev_week) * 100.0 / prev_week, 0) AS BIGINT) END AS change_pct,
                  CASE WHEN prev_week > 0 THEN concat(CASE WHEN round_even((this_week - prev_week) * 100.0 / prev_week, 0) >= 0 THEN '+' ELSE '' END,
                       CAST(CAST(round_even((this_week - prev_week) * 100.0 / prev_week, 0) AS BIGINT) AS VARCHAR), '%')
                       ELSE 'N/A (no previous week data)' END AS change_label
           FROM (SELECT count(*) FILTER (WHERE ingested_at >= TIMESTAMP '{SINCE_W}') AS this_week,
                        count(*) FILTER (WHERE ingested_at >= TIMESTAMP '{PREV_W}' AND ingested_at < TIMESTAMP '{SINCE_W}') AS prev_week
                 FROM reviews) v"""
    ),
)
def q_weekly_volume(spark, sf):
    return W.weekly_volume(_reviews(spark, sf), AS_OF)


def _spikes_sql(mode: str, since: str = SINCE_W, prev: str = PREV_W) -> str:
    prev_cond = f"date >= '{prev}'" + ("" if mode == "observed" else f" AND date < '{since}'")
    chg = "CASE WHEN p > 0 THEN CAST(round_even((c - p) * 100.0 / p, 0) AS BIGINT) END"
    return with_base(
        f"""SELECT theme, c AS this_count, p AS prev_count, {chg} AS change_pct,
                   CASE WHEN p > 0 THEN CASE WHEN {chg} > 0 THEN 'UP' ELSE 'DOWN' END END AS direction,
                   CASE WHEN p > 0 AND abs({chg}) > 20 THEN CASE WHEN {chg} > 0 THEN 'UP' ELSE 'DOWN' END
                        WHEN p = 0 AND c >= 3 THEN 'NEW TREND' END AS alert,
                   first_seen, first_pos
            FROM (SELECT t.theme, t.mentions AS c, coalesce(pv.mentions, 0) AS p, t.first_seen, t.first_pos
                  FROM ({trends_sql(src='mt')}) t
                  LEFT JOIN ({trends_sql(src='mp')}) pv ON t.theme = pv.theme) j""",
        f"mt AS (SELECT * FROM mentions WHERE date >= '{since}'),\nmp AS (SELECT * FROM mentions WHERE {prev_cond})",
    )


@register("weekly_spikes", _spikes_sql("observed"))
def q_weekly_spikes(spark, sf):
    return W.weekly_spikes(theme_mentions(_mat(spark, sf)), AS_OF, mode="observed")


@register("weekly_spikes_intended", _spikes_sql("intended"))
def q_weekly_spikes_intended(spark, sf):
    return W.weekly_spikes(theme_mentions(_mat(spark, sf)), AS_OF, mode="intended")


FIRST_WEEK, SECOND_WEEK = "2024-01-08", "2024-01-15"  # as-of days at the start of the data


@register("weekly_spikes_new", _spikes_sql("intended", *W.week_bounds(FIRST_WEEK)))
def q_weekly_spikes_new(spark, sf):
    """No week before the first one: every theme is a new trend."""
    return W.weekly_spikes(theme_mentions(_mat(spark, sf)), FIRST_WEEK, mode="intended")


@register("weekly_spikes_rise", _spikes_sql("intended", *W.week_bounds(SECOND_WEEK)))
def q_weekly_spikes_rise(spark, sf):
    """All that came after the first week against it: themes go up."""
    return W.weekly_spikes(theme_mentions(_mat(spark, sf)), SECOND_WEEK, mode="intended")


@register(
    "weekly_product",
    with_base(
        f"""SELECT p.product_id, p.name, coalesce(v.new_reviews, 0) AS new_reviews,
                   coalesce(round_even(v.avg_r, 1), 0.0) AS avg_rating,
                   coalesce(t.top_themes, 'No analysed data yet') AS top_themes
            FROM products p
            LEFT JOIN (SELECT product_id, count(*) AS new_reviews, avg(CAST(nullif(rating, 0) AS DOUBLE)) AS avg_r
                       FROM reviews WHERE ingested_at >= TIMESTAMP '{SINCE_W}' GROUP BY product_id) v
              ON p.product_id = v.product_id
            LEFT JOIN (SELECT product_id, string_agg(concat(theme, ' (', CAST(mentions AS VARCHAR), ')'), ', ' ORDER BY rn) AS top_themes
                       FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, first_seen, first_pos) AS rn
                             FROM ({trends_sql(src='mt', by='product_id')}) x) y
                       WHERE rn <= 3 GROUP BY product_id) t
              ON p.product_id = t.product_id""",
        f"mt AS (SELECT * FROM mentions WHERE date >= '{SINCE_W}')",
    ),
)
def q_weekly_product(spark, sf):
    r = _mat(spark, sf)
    return W.weekly_product(r, theme_mentions(r), _products(spark, sf), AS_OF)


@register(
    "weekly_series",
    """SELECT week_start, event_type, n, value_sum, prev_n,
              CASE WHEN prev_n > 0 THEN CAST(round_even((n - prev_n) * 100.0 / prev_n, 0) AS BIGINT) END AS change_pct
       FROM (SELECT week_start, event_type, n, value_sum,
                    CASE WHEN lag(week_start) OVER w + INTERVAL 7 DAY = week_start THEN lag(n) OVER w END AS prev_n
             FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type,
                          count(*) AS n, sum(value) AS value_sum
                   FROM events GROUP BY 1, 2) a
             WINDOW w AS (PARTITION BY event_type ORDER BY week_start)) b""",
)
def q_weekly_series(spark, sf):
    return W.weekly_series(table(spark, sf, "events"))


# ===================================================================== ingest
from revq.functions.classify import rating_confidence, rating_sentiment, themes_of  # noqa: E402
from revq.functions.dates import normalize_date, parse_review_date  # noqa: E402
from revq.functions.keys import clean_title, parse_rating, review_key, url_tail  # noqa: E402
from revq.operators import adhoc as A  # noqa: E402
from revq.operators import ingest as I  # noqa: E402
from revq.operators.classify import apply_analysis, classify_batch, classify_rules, run_tally, with_hits, with_keywords  # noqa: E402
from revq.operators.dedup import dedup_append, first_per_key  # noqa: E402
from revq.plans.oracle import LOAD_SPLIT, CONF_SQL, SENT_SQL  # noqa: E402
from revq.sources import html as H  # noqa: E402


def _split_loads(spark, sf):
    """Two loads of the batch by ingest time: the first builds the store, the
    second is appended against it (every row is read in one of the loads)."""
    b = reviews_in(spark, sf)
    cut = F.lit(LOAD_SPLIT).cast("timestamp_ntz")
    store = first_per_key(b.filter(F.col("ingested_at") < cut))
    batch2 = b.filter(F.col("ingested_at") >= cut)
    return store, batch2


LOADS_SQL = f"""s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS rn
                     FROM reviews_in WHERE ingested_at < TIMESTAMP '{LOAD_SPLIT}' AND review_id IS NOT NULL) t WHERE rn = 1),
b2 AS (SELECT * FROM reviews_in WHERE ingested_at >= TIMESTAMP '{LOAD_SPLIT}'),
acc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS rn
                       FROM b2 WHERE review_id IS NOT NULL) t
        WHERE rn = 1 AND review_id NOT IN (SELECT review_id FROM s1))"""


@register("dedup_append", with_base("SELECT review_id, arrival_seq, product_id FROM acc", LOADS_SQL))
def q_dedup_append(spark, sf):
    store, batch2 = _split_loads(spark, sf)
    return dedup_append(batch2, store).select("review_id", "arrival_seq", "product_id")


@register(
    "ingest_summary",
    with_base(
        """SELECT a.product_id, a.source, a.attempted, coalesce(n.new_count, 0) AS new_count,
                  a.attempted - coalesce(n.new_count, 0) AS skipped_count, t.total_in_db
           FROM (SELECT product_id, source, count(*) AS attempted FROM b2 GROUP BY 1, 2) a
           LEFT JOIN (SELECT product_id, source, count(*) AS new_count FROM acc GROUP BY 1, 2) n
             ON a.product_id = n.product_id AND a.source = n.source
           LEFT JOIN (SELECT product_id, count(*) AS total_in_db FROM
                        (SELECT product_id FROM s1 UNION ALL SELECT product_id FROM acc) u GROUP BY 1) t
             ON a.product_id = t.product_id""",
        LOADS_SQL,
    ),
)
def q_ingest_summary(spark, sf):
    store, batch2 = _split_loads(spark, sf)
    return I.ingest_summary(batch2, store).select(
        "product_id", "source", "attempted", "new_count", "skipped_count", "total_in_db"
    )


@register(
    "overlap_proof",
    with_base(
        """SELECT attempted, new_count, already_stored,
                  attempted - new_count - already_stored - null_keys AS in_batch_duplicates, null_keys
           FROM (SELECT count(*) AS attempted, count(*) FILTER (WHERE review_id IS NULL) AS null_keys,
                        (SELECT count(*) FROM acc) AS new_count,
                        (SELECT count(*) FROM b2 WHERE review_id IN (SELECT review_id FROM s1)) AS already_stored
                 FROM b2) t""",
        LOADS_SQL,
    ),
)
def q_overlap_proof(spark, sf):
    store, batch2 = _split_loads(spark, sf)
    return I.overlap_proof(batch2, store)


@register(
    "normalize_reviews",
    with_base(
        "SELECT md5(concat(reviewer_id, date, product_id)) AS review_id, product_id, lower(source) AS source, "
        "rating, date, reviewer_id FROM reviews_in WHERE text <> ''"
    ),
)
def q_normalize_reviews(spark, sf):
    b = reviews_in(spark, sf).drop("review_id")
    return I.normalize_reviews(b).select("review_id", "product_id", "source", "rating", "date", "reviewer_id")


@register(
    "scan_product",
    with_base(f"SELECT review_id, arrival_seq, rating, date FROM reviews WHERE product_id = '{PRODUCT}'"),
)
def q_scan_product(spark, sf):
    return _reviews(spark, sf).filter(F.col("product_id") == PRODUCT).select("review_id", "arrival_seq", "rating", "date")


@register("unprocessed", with_base("SELECT review_id, product_id, arrival_seq FROM reviews WHERE processed = 0"))
def q_unprocessed(spark, sf):
    from revq.operators.classify import unprocessed

    return unprocessed(_reviews(spark, sf)).select("review_id", "product_id", "arrival_seq")


RUNLOG_SQL = """rl AS (
  SELECT run_date, product_id, source, source_new,
         sum(source_new) OVER (PARTITION BY run_date, product_id) AS product_new,
         sum(source_new) OVER (PARTITION BY run_date) AS total_new
  FROM (SELECT CAST(ingested_at AS DATE) AS run_date, product_id, source, count(*) AS source_new
        FROM reviews GROUP BY 1, 2, 3) a),
rt AS (SELECT run_date, CAST(sum(total_new) OVER (ORDER BY run_date) AS BIGINT) AS total_in_db
       FROM (SELECT DISTINCT run_date, total_new FROM rl) b)"""


DELTA_LOG_SQL = with_base(
    "SELECT rl.run_date, product_id, source, source_new, CAST(product_new AS BIGINT) AS product_new, "
    "CAST(total_new AS BIGINT) AS total_new, total_in_db FROM rl JOIN rt ON rl.run_date = rt.run_date",
    RUNLOG_SQL,
)


@register("delta_log_entry", DELTA_LOG_SQL)
def q_delta_log_entry(spark, sf):
    return I.run_totals(I.run_rows(_reviews(spark, sf)))


@register("delta_log_flat", DELTA_LOG_SQL)
def q_delta_log_flat(spark, sf):
    """Round trip through the JSON sink: write the run log, read it back."""
    from revq.session import scratch_dir

    path = scratch_dir(spark, "runlog")
    I.write_run_rows(I.run_rows(_reviews(spark, sf)), path)
    return I.run_totals(I.read_run_rows(spark, path))


# ============================================================= classification
@register(
    "rating_sentiment",
    with_base(f"SELECT review_id, rating, {SENT_SQL} AS sentiment, CAST({CONF_SQL} AS DOUBLE) AS confidence FROM store"),
)
def q_rating_sentiment(spark, sf):
    s = first_per_key(reviews_in(spark, sf))
    return s.select("review_id", "rating", rating_sentiment("rating").alias("sentiment"), rating_confidence("rating").alias("confidence"))


@register(
    "keyword_themes",
    with_base(
        f"SELECT review_id, array_to_string({O._themes_sql()}, '|') AS themes_label, "
        "CAST(len(h) AS INTEGER) AS n_hits FROM hits"
    ),
)
def q_keyword_themes(spark, sf):
    s = first_per_key(with_hits(reviews_in(spark, sf)))
    return s.select("review_id", F.array_join(themes_of(F.col("hits")), "|").alias("themes_label"), F.size("hits").alias("n_hits"))


def _kw_values() -> str:
    return ", ".join(f"({O._lit(k)}, {O._lit(t)})" for t, ks in O.THEMES for k in ks)


@register(
    "keyword_hits",
    with_base(
        f"""SELECT k.keyword, k.theme, count(*) AS n_reviews
            FROM hits h JOIN (VALUES {_kw_values()}) AS k(keyword, theme) ON contains(h.b, k.keyword)
            GROUP BY k.keyword, k.theme"""
    ),
)
def q_keyword_hits(spark, sf):
    """Per keyword, reviews whose text contains it (J5). The 37 keywords are
    an in-expression array, so this is a filter + explode, not a join."""
    hit = first_per_key(with_keywords(reviews_in(spark, sf))).select(F.explode_outer("found").alias("k")).filter("k is not null")
    return hit.groupBy("k.keyword", "k.theme").agg(F.count(F.lit(1)).alias("n_reviews"))


CLASSIFY_SQL = f"""cb AS (
  SELECT review_id, {SENT_SQL} AS sentiment, {O._themes_sql()} AS themes, CAST({CONF_SQL} AS DOUBLE) AS confidence
  FROM hits WHERE processed = 0)"""


@register(
    "classify_batch",
    with_base("SELECT review_id, sentiment, array_to_string(themes, '|') AS themes_label, confidence FROM cb", CLASSIFY_SQL),
)
def q_classify_batch(spark, sf):
    un = _reviews(spark, sf).filter(F.col("processed") == 0)
    a = classify_batch(un)
    return a.select("review_id", "sentiment", F.array_join("themes", "|").alias("themes_label"), "confidence")


@register(
    "run_tally",
    with_base(
        """SELECT 'processed' AS kind, 'all' AS label, count(*) AS cnt FROM cb
           UNION ALL SELECT 'sentiment', sentiment, count(*) FROM cb GROUP BY sentiment
           UNION ALL SELECT 'theme', t, count(*) FROM (SELECT unnest(themes) AS t FROM cb) u GROUP BY t""",
        CLASSIFY_SQL,
    ),
)
def q_run_tally(spark, sf):
    un = _reviews(spark, sf).filter(F.col("processed") == 0)
    return run_tally(classify_batch(un))


def _ww_sql() -> str:
    parts = []
    for theme, kws in O.THEMES:
        alt = "|".join(kws)
        parts.append(f"CASE WHEN regexp_matches(b, '(^|[^a-z0-9_])({alt})([^a-z0-9_]|$)') THEN {O._lit(theme)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


UPSERT_SQL = f"""ww AS (SELECT review_id, {SENT_SQL} AS sentiment, {O._themes_sql('w')} AS themes
                        FROM (SELECT *, {_ww_sql()} AS w FROM hits WHERE ingested_at >= TIMESTAMP '{LOAD_SPLIT}') x),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ver DESC) AS rn FROM (
      SELECT review_id, sentiment, themes, 1 AS ver FROM reviews WHERE processed = 1
      UNION ALL SELECT review_id, sentiment, themes, 2 AS ver FROM ww) u) v WHERE rn = 1)"""


@register(
    "analysis_upsert",
    with_base(
        """SELECT s.review_id, l.sentiment, array_to_string(l.themes, '|') AS themes_label,
                  CASE WHEN l.sentiment IS NOT NULL THEN 1 ELSE 0 END AS processed
           FROM store s LEFT JOIN latest l ON s.review_id = l.review_id""",
        UPSERT_SQL,
    ),
)
def q_analysis_upsert(spark, sf):
    """Two analysis runs appended; the later one re-labels recent reviews with
    whole-word keyword rules; the view resolves the latest label per key."""
    r = _reviews(spark, sf)
    run1 = classify_batch(r.filter(F.col("processed") == 1), analyzed_at=F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    recent = r.filter(F.col("ingested_at") >= F.lit(LOAD_SPLIT).cast("timestamp_ntz"))
    ww = classify_rules(recent.select("review_id", "title", "text", "rating"), whole_word=True)
    run2 = ww.select(
        "review_id", "sentiment", "themes", "confidence",
        F.lit("keyword_rules_whole_word").alias("classifier"),
        F.lit("2024-03-02 00:00:00").cast("timestamp_ntz").alias("analyzed_at"),
    )
    raw = r.drop("sentiment", "themes", "confidence", "processed")
    v = apply_analysis(raw, run1.unionByName(run2))
    return v.select("review_id", "sentiment", F.array_join("themes", "|").alias("themes_label"), "processed")


@register(
    "themes_json_roundtrip",
    with_base("SELECT review_id, CAST(to_json(themes) AS VARCHAR) AS themes_json, true AS roundtrip_ok FROM reviews WHERE processed = 1"),
)
def q_themes_json_roundtrip(spark, sf):
    r = _reviews(spark, sf).filter(F.col("processed") == 1)
    j = r.select("review_id", "themes", F.to_json("themes").alias("themes_json"))
    back = F.from_json("themes_json", "array<string>")
    return j.select("review_id", "themes_json", (back == F.col("themes")).alias("roundtrip_ok"))


@register(
    "theme_contains",
    with_base(
        "SELECT product_id, count(*) AS cnt FROM reviews WHERE processed = 1 "
        "AND len(list_filter(themes, lambda t: contains(lower(t), 'quality'))) > 0 GROUP BY product_id"
    ),
)
def q_theme_contains(spark, sf):
    r = _reviews(spark, sf).filter((F.col("processed") == 1) & A.theme_fragment("Quality"))
    return r.groupBy("product_id").agg(F.count(F.lit(1)).alias("cnt"))


# ================================================================= templates
def _frag_sql(frag: str) -> str:
    return f"len(list_filter(themes, lambda t: contains(lower(t), '{frag.lower()}'))) > 0"


@register(
    "q_theme_by_sentiment",
    with_base(
        f"""SELECT sentiment, count(*) AS review_count, round(avg(rating), 1) AS avg_rating FROM reviews
            WHERE product_id = '{PRODUCT}' AND {_frag_sql('ANC')} AND processed = 1 GROUP BY sentiment"""
    ),
)
def q_theme_by_sentiment(spark, sf):
    return A.theme_sentiment_for(_reviews(spark, sf), PRODUCT, "ANC")


@register(
    "q_complaints_by_product",
    with_base(
        f"""SELECT product_id, count(*) AS complaints FROM reviews
            WHERE sentiment = 'Negative' AND {_frag_sql('Call')} AND processed = 1 GROUP BY product_id"""
    ),
)
def q_complaints_by_product(spark, sf):
    return A.complaints_by_product(_reviews(spark, sf), "Call")


@register(
    "one_star_reasons",
    with_base(
        """SELECT array_to_string(themes, ', ') AS themes_label, count(*) AS "count" FROM reviews
           WHERE rating = 1 AND processed = 1 AND themes IS NOT NULL
           GROUP BY themes ORDER BY "count" DESC, themes_label LIMIT 3"""
    ),
)
def q_one_star_reasons(spark, sf):
    return A.one_star_reasons(_reviews(spark, sf))


@register(
    "q_praise_by_product",
    with_base(
        f"""SELECT product_id, count(*) AS positive_mentions, round(avg(rating), 1) AS avg_rating FROM reviews
            WHERE {_frag_sql('Comfort')} AND sentiment = 'Positive' AND processed = 1 GROUP BY product_id"""
    ),
)
def q_praise_by_product(spark, sf):
    return A.praise_by_product(_reviews(spark, sf), "Comfort")


@register("q_total_reviews", with_base('SELECT count(*) AS "count" FROM reviews'))
def q_total_reviews(spark, sf):
    return A.total_reviews(_reviews(spark, sf))


ADHOC_TEXT = (
    "SELECT product_id, sentiment, COUNT(*) AS cnt, ROUND(AVG(rating), 1) AS avg_rating "
    "FROM reviews WHERE processed = 1 GROUP BY product_id, sentiment;"
)


@register("adhoc_select", with_base(ADHOC_TEXT.rstrip(";")))
def q_adhoc_select(spark, sf):
    r = _reviews(spark, sf)
    views = {"reviews": r, "theme_mentions": theme_mentions(r), "ingestion_log": S.ingestion_log(r)}
    return A.adhoc_select(spark, ADHOC_TEXT, views)


@register(
    "route_questions",
    f"SELECT conv_id, turn, {O.ROUTE_SQL} AS template FROM conversations WHERE role = 'user'",
)
def q_route_questions(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return A.route_questions(c).select("conv_id", "turn", "template")


ANSWER_PARAMS = {"product_id": PRODUCT, "anc_fragment": "ANC", "complaint_fragment": "Call", "praise_fragment": "Comfort"}


ANSWERS_SQL = f"""an AS (
  SELECT 'theme_by_sentiment' AS template, concat(count(*), ' reviews of {PRODUCT} mention ANC.') AS answer
  FROM reviews WHERE product_id = '{PRODUCT}' AND {_frag_sql('ANC')} AND processed = 1
  UNION ALL
  SELECT 'complaints_by_product', concat('Negative mentions of Call by product — ',
         coalesce(string_agg(concat(product_id, ': ', n), '; ' ORDER BY product_id), 'none'), '.')
  FROM (SELECT product_id, count(*) AS n FROM reviews
        WHERE sentiment = 'Negative' AND {_frag_sql('Call')} AND processed = 1 GROUP BY product_id) c
  UNION ALL
  SELECT 'one_star_reasons', concat('Top reasons behind 1-star reviews: ',
         coalesce(string_agg(label, '; ' ORDER BY n DESC, label), 'none'), '.')
  FROM (SELECT array_to_string(themes, ', ') AS label, count(*) AS n FROM reviews
        WHERE rating = 1 AND processed = 1 AND themes IS NOT NULL GROUP BY themes ORDER BY n DESC, label LIMIT 3) o
  UNION ALL
  SELECT * FROM (SELECT 'praise_by_product', concat(product_id, ' leads on Comfort with ', count(*),
                        ' positive mentions (avg ', round(avg(rating), 1), '/5).')
                 FROM reviews WHERE {_frag_sql('Comfort')} AND sentiment = 'Positive' AND processed = 1
                 GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 1) p
  UNION ALL
  SELECT 'total_reviews', concat(count(*), ' reviews in total.') FROM reviews)"""


@register(
    "answer_lines",
    with_base(
        f"""SELECT q.template, conv_id, turn, answer
            FROM (SELECT conv_id, turn, {O.ROUTE_SQL} AS template FROM conversations WHERE role = 'user') q
            LEFT JOIN an ON q.template = an.template""",
        ANSWERS_SQL,
    ),
)
def q_answer_lines(spark, sf):
    """Routed user turns joined to the grounded answer of their template."""
    c = A.route_questions(table(spark, sf, "conversations").filter(F.col("role") == "user"))
    answers = A.answer_lines(_reviews(spark, sf), ANSWER_PARAMS)
    # answers has at most one row per template (5 one-row aggregates): a
    # bound fixed by construction, so the broadcast needs no size check
    return c.select("conv_id", "turn", "template").join(F.broadcast(answers), "template", "left")


QUESTION_SQL = {
    "theme_by_sentiment": f"SELECT sentiment, count(*) AS review_count FROM reviews WHERE product_id = '{PRODUCT}' AND processed = 1 "
    "AND array_contains(themes, 'ANC (Active Noise Cancellation)') GROUP BY sentiment",
    "complaints_by_product": "SELECT product_id, count(*) AS complaints FROM reviews WHERE sentiment = 'Negative' GROUP BY product_id",
    "one_star_reasons": "SELECT theme, count(*) AS n FROM theme_mentions WHERE rating = 1 GROUP BY theme",
    "praise_by_product": "SELECT product_id, count(*) AS praise FROM reviews WHERE feeling = 'Positive' GROUP BY product_id",  # no such column
    "total_reviews": 'SELECT count(*) AS "count" FROM reviews',
}


def _question_run_sql() -> str:
    def arm(name: str, sql: str) -> str:
        if name == "praise_by_product":
            return f"SELECT '{name}' AS template, 'error' AS status, 0::BIGINT AS n_rows, '' AS results"
        sql = sql.replace("theme_mentions", "mentions")
        return f"""SELECT '{name}', 'ok', count(j), coalesce(string_agg(j, chr(10) ORDER BY j), '') FROM (SELECT to_json(t)::VARCHAR AS j FROM ({sql}) t) x"""

    runs = " UNION ALL ".join(arm(n, QUESTION_SQL[n]) for n in ["praise_by_product", *(n for n in QUESTION_SQL if n != "praise_by_product")])
    return with_base(
        f"""SELECT conv_id, turn, q.template, status, n_rows, results
            FROM (SELECT conv_id, turn, {O.ROUTE_SQL} AS template FROM conversations WHERE role = 'user') q JOIN runs USING (template)""",
        f"runs AS ({runs})",
    )


@register("question_run", _question_run_sql())
def q_question_run(spark, sf):
    """Q4: every user turn with the status and result rows of its template's
    query; one template's query is refused and says so, the others answer."""
    r = _reviews(spark, sf)
    queries = {n: s.replace('"', "`") for n, s in QUESTION_SQL.items()}
    runs = A.run_queries(spark, queries, {"reviews": r, "theme_mentions": theme_mentions(r)})
    runs = runs.select(F.col("name").alias("template"), "status", "n_rows", F.array_join("results", "\n").alias("results"))
    turns = A.route_questions(table(spark, sf, "conversations").filter(F.col("role") == "user"))
    # a row per template: a bound fixed by construction, so the broadcast needs no size check
    return turns.select("conv_id", "turn", "template").join(F.broadcast(runs), "template")


# ============================================================ cleaning rules
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def _raw_dates(store):
    d = F.col("date").try_cast("date")
    day, mon, yr = F.dayofmonth(d), F.month(d), F.year(d)
    full = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), mon)
    abbr = F.substring(full, 1, 3)
    dd = F.lpad(day.cast("string"), 2, "0")
    mm = F.lpad(mon.cast("string"), 2, "0")
    v = F.col("arrival_seq") % 10
    forms = [
        F.format_string("%d %s %d", day, full, yr),
        F.format_string("%d %s %d", day, abbr, yr),
        F.format_string("%s %d, %d", full, day, yr),
        F.format_string("%s %s, %d", abbr, dd, yr),
        F.format_string("%s-%s-%d", dd, mm, yr),
        F.format_string("%s/%s/%d", dd, mm, yr),
        F.format_string("Reviewed in India on %d %s %d", day, full, yr),
        F.format_string("Certified Buyer, %s, %d", abbr, yr),
        F.format_string("Reviewed in the United States on %s %d, %d", full, day, yr),
        F.format_string("%d %s %s", day, full, F.substring(yr.cast("string"), 3, 2)),
    ]
    expr = None
    for i, f in enumerate(forms):
        expr = F.when(v == i, f) if expr is None else expr.when(v == i, f)
    return store.select("arrival_seq", "date", expr.alias("raw"))


def _raw_dates_sql() -> str:
    months = "[" + ", ".join(O._lit(m) for m in MONTHS) + "]"
    full = f"({months})[month(d)]"
    abbr = f"substr({full}, 1, 3)"
    day, yr = "CAST(day(d) AS VARCHAR)", "CAST(year(d) AS VARCHAR)"
    dd, mm = "lpad(CAST(day(d) AS VARCHAR), 2, '0')", "lpad(CAST(month(d) AS VARCHAR), 2, '0')"
    forms = [
        f"concat({day}, ' ', {full}, ' ', {yr})",
        f"concat({day}, ' ', {abbr}, ' ', {yr})",
        f"concat({full}, ' ', {day}, ', ', {yr})",
        f"concat({abbr}, ' ', {dd}, ', ', {yr})",
        f"concat({dd}, '-', {mm}, '-', {yr})",
        f"concat({dd}, '/', {mm}, '/', {yr})",
        f"concat('Reviewed in India on ', {day}, ' ', {full}, ' ', {yr})",
        f"concat('Certified Buyer, ', {abbr}, ', ', {yr})",
        f"concat('Reviewed in the United States on ', {full}, ' ', {day}, ', ', {yr})",
        f"concat({day}, ' ', {full}, ' ', substr({yr}, 3, 2))",
    ]
    arms = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return f"CASE arrival_seq % 10 {arms} END"


@register(
    "parse_date",
    with_base(
        f"""SELECT arrival_seq, raw,
                   CASE WHEN v IN (8, 9) THEN raw WHEN v = 7 THEN strftime(date_trunc('month', d), '%Y-%m-%d')
                        ELSE strftime(d, '%Y-%m-%d') END AS normalized,
                   CASE WHEN v IN (8, 9) THEN NULL WHEN v = 7 THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS review_date
            FROM (SELECT arrival_seq, d, arrival_seq % 10 AS v, {_raw_dates_sql()} AS raw
                  FROM (SELECT arrival_seq, CAST(date AS DATE) AS d FROM store) s) t"""
    ),
)
def q_parse_date(spark, sf):
    """Raw review-date strings in the ten layouts a marketplace page shows,
    rendered from each stored review's date, then normalised (H1)."""
    s = first_per_key(reviews_in(spark, sf))
    raw = _raw_dates(s)
    return raw.select("arrival_seq", "raw", normalize_date("raw").alias("normalized"), parse_review_date("raw").alias("review_date"))


@register(
    "review_key",
    with_base(
        "SELECT review_id, md5(concat(reviewer_id, date, product_id)) AS key_plain, "
        "md5(concat_ws(chr(31), reviewer_id, date, product_id, lower(source))) AS key_strict FROM reviews_in"
    ),
)
def q_review_key(spark, sf):
    b = reviews_in(spark, sf)
    return b.select(
        "review_id",
        review_key("reviewer_id", "date", "product_id").alias("key_plain"),
        review_key("reviewer_id", "date", "product_id", "source", strict=True).alias("key_strict"),
    )


@register(
    "parse_rating",
    with_base(
        """SELECT arrival_seq, star_text, CASE WHEN v IN (3, 4) THEN NULL ELSE r END AS rating_parsed
           FROM (SELECT arrival_seq, arrival_seq % 5 AS v, CAST(coalesce(rating, 0) AS INTEGER) AS r,
                        CASE arrival_seq % 5
                          WHEN 0 THEN concat(CAST(coalesce(rating, 0) AS VARCHAR), '.0 out of 5 stars')
                          WHEN 1 THEN concat(CAST(coalesce(rating, 0) AS VARCHAR), '.5 out of 5 stars')
                          WHEN 2 THEN CAST(coalesce(rating, 0) AS VARCHAR)
                          WHEN 3 THEN 'abc out of 5 stars'
                          ELSE '' END AS star_text
                 FROM store) t"""
    ),
)
def q_parse_rating(spark, sf):
    """Star labels rendered from each stored rating in five shapes, parsed back (H3)."""
    s = first_per_key(reviews_in(spark, sf))
    r = F.coalesce("rating", F.lit(0)).cast("string")
    v = F.col("arrival_seq") % 5
    star = (
        F.when(v == 0, F.concat(r, F.lit(".0 out of 5 stars")))
        .when(v == 1, F.concat(r, F.lit(".5 out of 5 stars")))
        .when(v == 2, r)
        .when(v == 3, F.lit("abc out of 5 stars"))
        .otherwise(F.lit(""))
    )
    t = s.select("arrival_seq", star.alias("star_text"))
    return t.withColumn("rating_parsed", parse_rating("star_text"))


@register(
    "clean_title",
    with_base(
        """SELECT arrival_seq, title_raw, regexp_replace(title_raw, '^\\d+\\.?\\d*\\s+out of \\d+ stars\\s*', '') AS title_clean
           FROM (SELECT arrival_seq, CASE arrival_seq % 3
                   WHEN 0 THEN concat(CAST(coalesce(rating, 0) AS VARCHAR), '.0 out of 5 stars ', title)
                   WHEN 1 THEN concat(CAST(coalesce(rating, 0) AS VARCHAR), ' out of 5 stars', title)
                   ELSE title END AS title_raw FROM store) t"""
    ),
)
def q_clean_title(spark, sf):
    s = first_per_key(reviews_in(spark, sf))
    r = F.coalesce("rating", F.lit(0)).cast("string")
    v = F.col("arrival_seq") % 3
    raw = (
        F.when(v == 0, F.concat(r, F.lit(".0 out of 5 stars "), "title"))
        .when(v == 1, F.concat(r, F.lit(" out of 5 stars"), "title"))
        .otherwise(F.col("title"))
    )
    t = s.select("arrival_seq", raw.alias("title_raw"))
    return t.withColumn("title_clean", clean_title("title_raw"))


@register(
    "url_tail",
    "SELECT page_id, url, split_part(string_split(url, '/')[-1], '?', 1) AS tail FROM pages",
)
def q_url_tail(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", url_tail("url").alias("tail"))


@register(
    "crawl_frontier",
    """SELECT listing, CAST(p AS INTEGER) AS page_no, concat(listing, '?page=', CAST(p AS VARCHAR)) AS page_url
       FROM (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS listing FROM pages) l, range(1, 11) r(p)""",
)
def q_crawl_frontier(spark, sf):
    listings = table(spark, sf, "pages").select(H.url_base("url").alias("url"), F.lit("flipkart").alias("source"))
    return H.crawl_frontier(listings).select("listing", "page_no", "page_url")


@register(
    "page_cutoff",
    """SELECT page_id, listing, page_no, fetched, n_reviews FROM (
         SELECT *, min(CASE WHEN fetched AND n_reviews = 0 THEN page_no END) OVER (PARTITION BY listing) AS first_empty
         FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS listing,
                      CASE WHEN regexp_extract(url, '[?&](?:page|pageNumber)=(\\d+)', 1) = '' THEN 1
                           ELSE CAST(regexp_extract(url, '[?&](?:page|pageNumber)=(\\d+)', 1) AS INTEGER) END AS page_no,
                      html IS NOT NULL AS fetched,
                      coalesce(CAST((length(html) - length(replace(html, '<article', ''))) // 8 AS BIGINT), 0) AS n_reviews
               FROM pages) a) b
       WHERE fetched AND (first_empty IS NULL OR page_no < first_empty)""",
)
def q_page_cutoff(spark, sf):
    return H.page_cutoff(H.page_listing(table(spark, sf, "pages")))


@register("extract_reviews_html")
def q_extract_reviews_html(spark, sf):
    """Review rows parsed from every crawled page (article rule set)."""
    p = table(spark, sf, "pages").withColumn("source", F.lit("article"))
    return H.extract_reviews(p).select("page_id", "pos", "product_id", "review_id", "rating", "title", "date", "reviewer_id", F.length("text").alias("text_chars"))


@register("sample_rows", with_base("SELECT review_id, product_id, rating, sentiment FROM reviews ORDER BY md5(review_id || '42'), review_id LIMIT 10"))
def q_sample_rows(spark, sf, k: int = 10, seed: int = 42):
    """A seeded sample of k stored reviews (the limit is the feature);
    hash order instead of rand() so reruns and retries give the same rows."""
    r = _reviews(spark, sf)
    return r.orderBy(F.md5(F.concat("review_id", F.lit(str(seed)))), "review_id").limit(k).select("review_id", "product_id", "rating", "sentiment")


# ============================================================ model answers
def _labels_raw(labels):
    """Model-style answers rendered from the ``labels`` table in twelve
    shapes (clean, fenced, bad sentiment, foreign themes, missing / null /
    string themes, string / bad / out-of-range confidence, array, prose)."""
    s = F.when(F.col("quality") == 1, F.lit("Positive")).otherwise(F.lit("Negative"))
    t = F.when(F.col("toxic") == 1, F.lit('["Call Quality"]')).otherwise(F.lit('["Sound Quality","Comfort & Fit"]'))
    v = F.col("doc_id") % 12

    def obj(sent, themes, conf):
        parts = []
        if sent is not None:
            parts.append(F.concat(F.lit('"sentiment":"'), sent, F.lit('"')))
        if themes is not None:
            parts.append(F.concat(F.lit('"themes":'), themes))
        if conf is not None:
            parts.append(F.concat(F.lit('"confidence":'), conf))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    base = obj(s, t, F.lit("0.9"))
    forms = [
        base,
        F.concat(F.lit("```json\n"), base, F.lit("\n```")),
        obj(F.lit("Mixed"), t, F.lit("0.9")),
        obj(s, F.lit('["Sound","Comfort & Fit","Bogus"]'), F.lit("0.9")),
        obj(s, None, F.lit("0.9")),
        obj(s, F.lit("null"), F.lit("0.9")),
        obj(s, F.lit('"Call Quality"'), F.lit("0.9")),
        obj(s, t, F.lit('"0.9"')),
        obj(s, t, F.lit('"abc"')),
        obj(s, t, F.lit("7")),
        F.concat(F.lit("["), obj(s, None, None), F.lit("]")),
        F.concat(F.lit("Sentiment: "), s),
    ]
    expr = None
    for i, f in enumerate(forms):
        expr = F.when(v == i, f) if expr is None else expr.when(v == i, f)
    return labels.select("doc_id", expr.alias("raw"))


@register(
    "sanitize_labels",
    """SELECT doc_id,
              CASE WHEN fb THEN 'Neutral' WHEN v = 2 THEN 'Neutral' ELSE s END AS sentiment,
              CASE WHEN fb THEN 'Sound Quality'
                   WHEN v = 3 THEN 'Comfort & Fit'
                   WHEN v IN (4, 6) THEN 'Sound Quality' ELSE t END AS themes_label,
              CAST(CASE WHEN fb THEN 0.1 WHEN v = 9 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence,
              fb AS fallback
       FROM (SELECT doc_id, doc_id % 12 AS v, v IN (5, 8, 10, 11) AS fb,
                    CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS s,
                    CASE WHEN toxic = 1 THEN 'Call Quality' ELSE 'Sound Quality|Comfort & Fit' END AS t
             FROM labels) x""",
)
def q_sanitize_labels(spark, sf):
    from revq.functions.labels import sanitize_answer

    raw = _labels_raw(table(spark, sf, "labels"))
    a = raw.select("doc_id", sanitize_answer("raw").alias("a"))
    return a.select(
        "doc_id",
        "a.sentiment",
        F.array_join("a.themes", "|").alias("themes_label"),
        "a.confidence",
        "a.fallback",
    )


BATCH = 10


@register(
    "batch_align",
    with_base(
        f"""SELECT review_id,
                  CASE WHEN fb THEN 'Neutral' ELSE sentiment END AS sentiment,
                  array_to_string(CASE WHEN fb THEN ['Sound Quality'] ELSE themes END, '|') AS themes_label,
                  CAST(CASE WHEN fb THEN 0.1 ELSE confidence END AS DOUBLE) AS confidence,
                  fb AS fallback
           FROM (SELECT *, (batch_id % 4 = 3) OR (batch_id % 4 = 1 AND pos = n - 1) AS fb FROM (
                   SELECT review_id, sentiment, themes, confidence, arrival_seq // {BATCH} AS batch_id,
                          row_number() OVER (PARTITION BY arrival_seq // {BATCH} ORDER BY arrival_seq) - 1 AS pos,
                          count(*) OVER (PARTITION BY arrival_seq // {BATCH}) AS n
                   FROM reviews WHERE processed = 1) a) b"""
    ),
)
def q_batch_align(spark, sf):
    """Reviews sent to a model ten per call; the calls' answers come back
    exact, one short, one long or broken (by call id); alignment by key."""
    from pyspark.sql.window import Window as Wn

    from revq.operators.classify import batch_align

    r = _reviews(spark, sf).filter(F.col("processed") == 1)
    bid = F.floor(F.col("arrival_seq") / BATCH).cast("long")
    w = Wn.partitionBy("batch_id").orderBy("arrival_seq")
    assign = r.select("review_id", "arrival_seq", "sentiment", "themes", "confidence", bid.alias("batch_id")).withColumn(
        "pos", F.row_number().over(w) - 1
    )
    item = F.to_json(F.struct("sentiment", "themes", "confidence"))
    calls = assign.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("j")))).alias("items"))
    js = F.transform("items", lambda x: x["j"])
    v = F.col("batch_id") % 4
    short = F.slice(js, 1, F.greatest(F.size(js) - 1, F.lit(0)))
    extra = F.concat(js, F.array(F.lit('{"sentiment":"Positive","themes":["Sound Quality"],"confidence":0.5}')))
    arr = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    full = arr(js)
    raw = (
        F.when(v == 0, full)
        .when(v == 1, arr(short))
        .when(v == 2, arr(extra))
        .otherwise(F.regexp_replace(full, r"\]$", ""))  # unterminated array
    )
    answers = calls.select("batch_id", raw.alias("raw"))
    out = batch_align(assign.select("batch_id", "pos", "review_id"), answers)
    return out.select(
        "review_id", "sentiment", F.array_join("themes", "|").alias("themes_label"), "confidence", "fallback"
    )


@register(
    "batch_retry",
    with_base(
        f"""SELECT review_id, mode, fb AS fallback,
                  CASE WHEN fb THEN 'Neutral' ELSE sentiment END AS sentiment,
                  array_to_string(CASE WHEN fb THEN ['Sound Quality'] ELSE themes END, '|') AS themes_label,
                  CAST(CASE WHEN fb THEN 0.1 WHEN mode = 'single' THEN 0.5 ELSE confidence END AS DOUBLE) AS confidence
           FROM (SELECT *, CASE WHEN mode = 'single' THEN arrival_seq % 7 = 0 ELSE batch_id % 3 = 1 AND pos = n - 1 END AS fb FROM (
                   SELECT review_id, arrival_seq, sentiment, themes, confidence, arrival_seq // {BATCH} AS batch_id,
                          CASE WHEN (arrival_seq // {BATCH}) % 3 = 2 THEN 'single' ELSE 'batch' END AS mode,
                          row_number() OVER (PARTITION BY arrival_seq // {BATCH} ORDER BY arrival_seq) - 1 AS pos,
                          count(*) OVER (PARTITION BY arrival_seq // {BATCH}) AS n
                   FROM reviews WHERE processed = 1) a) b"""
    ),
)
def q_batch_retry(spark, sf):
    """Every third call of ten fails (cut short, or with an element that cannot
    be read) and its reviews are scored singly; some single answers fail too."""
    from pyspark.sql.window import Window as Wn

    from revq.operators.classify import align_with_retry

    r = _reviews(spark, sf).filter(F.col("processed") == 1)
    r = r.select("review_id", "arrival_seq", "sentiment", "themes", "confidence", F.floor(F.col("arrival_seq") / BATCH).cast("long").alias("batch_id"))
    assign = r.withColumn("pos", F.row_number().over(Wn.partitionBy("batch_id").orderBy("arrival_seq")) - 1)
    calls = assign.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.to_json(F.struct("sentiment", "themes", "confidence")).alias("j")))).alias("items"))
    js, v = F.transform("items", lambda x: x["j"]), F.col("batch_id") % 6
    js = F.when(v % 3 == 1, F.slice(js, 1, F.size(js) - 1)).when(v == 5, F.concat(js, F.array(F.lit('{"confidence":null}')))).otherwise(js)
    raw = F.concat(F.lit("["), F.array_join(js, ","), F.when(v == 2, F.lit("")).otherwise(F.lit("]")))

    def score_single(reviews: DataFrame) -> DataFrame:
        answer = F.to_json(F.struct("sentiment", "themes"))
        return reviews.select("review_id", F.when(F.col("arrival_seq") % 7 == 0, F.lit("I cannot tell")).otherwise(answer).alias("raw"))

    out = align_with_retry(assign.select("review_id", "batch_id", "pos"), calls.select("batch_id", raw.alias("raw")), r, score_single)
    return out.select("review_id", "mode", "fallback", "sentiment", F.array_join("themes", "|").alias("themes_label"), "confidence")


# ================================================================ streaming
DELIVERIES = 4
ARRIVALS = f"ends AS (SELECT min(arrival_seq) AS lo, (max(arrival_seq) - min(arrival_seq)) // {DELIVERIES} + 1 AS step FROM reviews_in)"


def _delivered(spark, sf, **more):
    """Land the batch as consecutive arrival ranges (arrival order is the
    insert order of the store) and run the incremental ingest after each
    delivery; returns the stream with its folders."""
    from revq.session import scratch_dir
    from revq.streaming.ingest import ReviewStream

    base = scratch_dir(spark, "stream")
    b = reviews_in(spark, sf)
    lo, hi = b.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    step = (hi - lo) // DELIVERIES + 1
    folders = {k: f"{base}/{k}" for k in more.pop("also", ())}
    rs = ReviewStream(f"{base}/landing", f"{base}/store", f"{base}/checkpoint", b.schema, **folders, **more)
    for k in range(DELIVERIES):
        seq = F.col("arrival_seq")
        part = b.filter((seq >= lo + k * step) & (seq < lo + (k + 1) * step))
        part.write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
    return rs


@register("stream_ingest", with_base("SELECT review_id, arrival_seq, product_id FROM store"))
def q_stream_ingest(spark, sf):
    """Incremental ingest equals the batch store."""
    return _delivered(spark, sf).stored(spark).select("review_id", "arrival_seq", "product_id")


@register(
    "stream_classify",
    with_base("SELECT review_id, sentiment, array_to_string(themes, '|') AS themes_label FROM reviews WHERE processed = 1"),
)
def q_stream_classify(spark, sf):
    """Rows accepted by each run are classified in the same micro-batch."""
    rs = _delivered(spark, sf, also=["analysis"], classify_filter="processed = 1")
    return rs.analysed(spark).select("review_id", "sentiment", F.array_join("themes", "|").alias("themes_label"))


# which rows an epoch of the backlog query analyses: only rated ones, but for the third, which takes all that wait
RATED_ONLY = {0, 1, 3}


@register(
    "stream_backlog",
    with_base(
        f"""SELECT review_id, accepted, CASE WHEN rating IS NOT NULL THEN accepted WHEN accepted <= 2 THEN 2 END AS analysed,
                   CASE WHEN rating IS NOT NULL OR accepted <= 2 THEN {O.SENT_SQL} END AS sentiment,
                   CASE WHEN rating IS NOT NULL OR accepted <= 2 THEN array_to_string({O._themes_sql()}, '|') END AS themes_label
            FROM (SELECT hits.*, (arrival_seq - lo) // step AS accepted FROM hits, ends) h""",
        ARRIVALS,
    ),
)
def q_stream_backlog(spark, sf):
    """Rows that an epoch leaves out wait in the backlog and are analysed
    by the first epoch that takes them; what still waits has no analysis."""
    rs = _delivered(spark, sf, also=["analysis"], classify_filter=lambda e: "rating is not null" if e in RATED_ONLY else None)
    done = rs.analysed(spark).select(
        "review_id", "accepted", F.col("epoch").cast("long").alias("analysed"), "sentiment", F.array_join("themes", "|").alias("themes_label")
    )
    none = F.lit(None)
    left = rs.backlog(spark).select(
        "review_id", "accepted", none.cast("long").alias("analysed"), none.cast("string").alias("sentiment"), none.cast("string").alias("themes_label")
    )
    return done.unionByName(left)


@register(
    "stream_theme_trends",
    with_base(
        f"SELECT d AS delivery, {TREND_COLS} FROM ({trends_sql(src='seen', by='d')}) t",
        ARRIVALS + """,
analysed AS (
  SELECT arrival_seq, product_id, source, rating, date, ingested_at, """ + f"{O.SENT_SQL} AS sentiment, {O._themes_sql()} AS themes FROM hits" + f"""),
every AS (
  SELECT arrival_seq, rating, sentiment, unnest(themes) AS theme, generate_subscripts(themes, 1) - 1 AS pos FROM analysed),
seen AS (
  SELECT every.*, CAST(d AS INTEGER) AS d FROM every, ends, range({DELIVERIES}) r(d) WHERE arrival_seq < lo + (d + 1) * step)""",
    ),
)
def q_stream_theme_trends(spark, sf):
    """The theme counts kept by the stream, as they stood after each delivery."""
    rs = _delivered(spark, sf, also=["analysis", "counts"])
    parts = rs.theme_counts(spark).withColumn("delivery", F.explode(F.sequence(F.col("epoch").cast("int"), F.lit(DELIVERIES - 1))))
    return theme_trends_of(parts, by=["delivery"]).select("delivery", *TREND_COLS.split(", "))


# ================================================================== reports
def _section(n: int, order: str, line: str, rows: str) -> str:
    return f"SELECT {n} AS section, row_number() OVER (ORDER BY {order}) AS ord, {line} AS line FROM ({rows}) s{n}"


def _heading(n: int, text: str) -> str:
    return f"SELECT {n}, 0, {O._lit(text)}"


def _report_sql() -> str:
    trend = "mentions DESC, first_seen, first_pos"
    table_sql = with_base(
        f"SELECT theme, mentions, {pct('positive', 'mentions')} AS pos_pct, {pct('negative', 'mentions')} AS neg_pct, avg_rating, first_seen, first_pos "
        f"FROM ({trends_sql()}) t"
    )
    head = with_base("SELECT count(*) AS n, min(date) AS lo, max(date) AS hi FROM reviews")
    return "\nUNION ALL\n".join([
        _section(0, "n", "concat('Total reviews: ', n, ' | Period: ', coalesce(lo, 'N/A'), ' to ', coalesce(hi, 'N/A'))", head),
        _heading(0, "# Review Intelligence Report"),
        _heading(1, "## Executive summary\n| Product | Reviews | Avg rating | Positive % | Top complaint | Top praise |"),
        _section(1, "product_id", "concat('| ', name, ' | ', total_reviews, ' | ', avg_rating, '/5 | ', positive_pct, '% | ', top_complaint, ' | ', top_praise, ' |')", ORACLE["exec_summary"]),
        _heading(2, "## Product team: critical issues"),
        _section(2, trend, "concat('**', theme, ':** ', negative, ' negative mentions (', neg_pct, '% of ', mentions, ') - average rating when mentioned ', avg_rating, '/5', chr(10), '> Evidence: \"', quote, '\"')", ORACLE["critical_issues"]),
        _heading(3, "## Product team: wins"),
        _section(3, trend, "concat('**', theme, ':** ', positive, ' positive mentions (', pos_pct, '% positive) - avg rating ', avg_rating, '/5')", ORACLE["wins"]),
        _heading(4, "## Marketing: messaging opportunities"),
        _section(4, "rank", "concat('- **', theme, '** - ', positive, ' positive mentions (avg ', avg_rating, '/5)')", ORACLE["messaging_opportunities"]),
        _heading(5, "## Marketing: claims to retire"),
        _section(5, "rank", "concat('- **', theme, '** - ', negative, ' negative mentions')", ORACLE["claims_to_retire"]),
        _heading(6, "## Support: FAQ candidates"),
        _section(6, "rank", "concat('- **', theme, '** - ', mentions, ' mentions')", ORACLE["faq_candidates"]),
        _heading(7, "## Support: escalation patterns"),
        _section(7, "rank", "concat('- **', themes_label, '** - ', cnt, ' reviews rated 2 stars or less')", ORACLE["escalation_patterns"]),
        _heading(8, "## Theme analysis\n| Theme | Mentions | Positive % | Negative % | Avg rating |"),
        _section(8, trend, "concat('| ', theme, ' | ', mentions, ' | ', pos_pct, '% | ', neg_pct, '% | ', avg_rating, '/5 |')", table_sql),
    ])


def _weekly_report_sql() -> str:
    quotes = with_base(
        f"SELECT theme, quote FROM quotes WHERE sentiment = 'Negative' AND product_id = '{QUOTE_PRODUCT}'", QUOTES_SQL
    )
    spikes = f"""SELECT s.*, coalesce(q.quote, 'No matching review found.') AS quote
                 FROM ({ORACLE['weekly_spikes']}) s LEFT JOIN ({quotes}) q ON s.theme = q.theme WHERE alert IS NOT NULL"""
    line = """CASE WHEN alert = 'NEW TREND' THEN concat('**', theme, ' - NEW TREND (', this_count, ' mentions)** - not seen last week; monitor')
              ELSE concat('**', theme, ' - ', alert, ' ', abs(change_pct), '%** (previous ', prev_count, ', this week ', this_count, ')', chr(10),
                          '- Key review: "', quote, '"', chr(10), '- Action: ',
                          CASE WHEN alert = 'UP' THEN 'Investigate root cause and prioritise fix'
                               ELSE 'Monitor — trend improving' END) END"""
    volume = "concat('# Weekly change report - week of ', since, chr(10), 'New reviews this week: ', this_week, ' | vs last week: ', change_label)"
    product = "concat(name, ': ', new_reviews, ' new reviews | avg rating ', avg_rating, '/5 | top themes: ', top_themes)"
    return "\nUNION ALL\n".join([
        _section(0, "since", volume, ORACLE["weekly_volume"]),
        _heading(1, "## Spikes and alerts (>20% change)"),
        _section(1, "this_count DESC, first_seen, first_pos", line, spikes),
        f"SELECT 1, 1, 'No significant spikes detected this week.' WHERE NOT EXISTS (SELECT 1 FROM ({spikes}) none)",
        _heading(2, "## Per product"),
        _section(2, "product_id", product, ORACLE["weekly_product"]),
    ])


@register("report_lines", _report_sql())
def q_report_lines(spark, sf):
    """K9: the global action report as ordered lines."""
    from revq.plans.reports import global_report_lines

    return global_report_lines(_mat(spark, sf, with_text=True), _products(spark, sf), QUOTE_PRODUCT)


@register("weekly_report_lines", _weekly_report_sql())
def q_weekly_report_lines(spark, sf):
    """K7/K8: the weekly change report as ordered lines."""
    from revq.plans.reports import weekly_report_lines

    return weekly_report_lines(_mat(spark, sf, with_text=True), _products(spark, sf), AS_OF, quote_product=QUOTE_PRODUCT)


@register(
    "report_documents",
    f"""SELECT 'global' AS document, section, ord, line FROM ({_report_sql()}) g
        UNION ALL SELECT 'weekly', section, ord, line FROM ({_weekly_report_sql()}) w""",
)
def q_report_documents(spark, sf):
    """Both documents written as text, and read back as relations."""
    from revq.plans.reports import global_report_lines, read_reports, weekly_report_lines, write_report
    from revq.session import scratch_dir

    base, r, p = scratch_dir(spark, "reports"), _mat(spark, sf, with_text=True), _products(spark, sf)
    write_report(global_report_lines(r, p, QUOTE_PRODUCT), f"{base}/global")
    write_report(weekly_report_lines(r, p, AS_OF, quote_product=QUOTE_PRODUCT), f"{base}/weekly")
    return read_reports(spark, f"{base}/global", f"{base}/weekly", f"{base}/not_made_yet")


# ============================================================ stored tables
@register(
    "store_roundtrip",
    with_base("SELECT review_id, product_id, sentiment, array_to_string(themes, '|') AS themes_label, processed FROM reviews"),
)
def q_store_roundtrip(spark, sf):
    """Two loads through the persistent store (split at the load date), then
    one analysis run over the processed rows; the view equals the in-memory
    in-memory plan."""
    from revq.session import scratch_dir
    from revq.sources.store import ReviewStore

    st = ReviewStore(spark, scratch_dir(spark, "store"))
    b = reviews_in(spark, sf)
    cut = F.lit(LOAD_SPLIT).cast("timestamp_ntz")
    st.append(b.filter(F.col("ingested_at") < cut), 1, "2024-02-01 00:00:00")
    st.append(b.filter(F.col("ingested_at") >= cut), 2, "2024-03-01 00:00:00")
    st.analyse(1, predicate="processed = 1")
    v = st.reviews()
    return v.select("review_id", "product_id", "sentiment", F.array_join("themes", "|").alias("themes_label"), "processed")
