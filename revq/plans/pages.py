"""Registered queries of the ingest side: marketplace pages (S1, S2), page
URLs and sources (S4-S6), batches (U1, Z8, P10-P12), the run log as one
document (S8), rows still to analyse by key (P1), the run's top theme (Z6)
and weekly counts of a stream (Z4).

Page markup is rendered from the derived review batch, one page a review, in
every shape the selector rules know; the oracle states the expected rows
from the same batch in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.operators import classify as C
from revq.operators import ingest as I
from revq.operators.dedup import first_per_key
from revq.plans import oracle as O
from revq.plans.base import reviews as _reviews
from revq.plans.catalog import CLASSIFY_SQL, RUNLOG_SQL, register
from revq.plans.oracle import LOAD_SPLIT, SINCE, with_base
from revq.sources import html as H
from revq.sources.fixtures import reviews_in, table

DEEP = 3000  # nested tags around a body
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
STARS_SQL = r"'^\d+\.?\d*\s+out of \d+ stars\s*'"


def _strip_sql(col: str) -> str:
    return f"trim({col}, {O._lit(SPACES)})"


def _escaped(col: str) -> Column:
    c = F.replace(F.col(col), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(open_tag: str, inner: Column, close: str) -> Column:
    return F.concat(F.lit(open_tag), inner, F.lit(close))


def _deep(c: Column) -> Column:
    return F.concat(F.lit("<b>" * DEEP), c, F.lit("</b>" * DEEP))


def _page_rows(b, source: str, html: Column):
    url = F.concat(F.lit("https://shop.example/item/"), F.col("arrival_seq").cast("string"), F.lit("?page=1"))
    return b.select(F.col("arrival_seq").alias("page_id"), url.alias("url"), html.alias("html"), F.lit(source).alias("source"))


def _extracted(pages):
    return H.extract_reviews(pages).select(
        "page_id", "pos", "product_id", "review_id", "rating", "title", "date", "reviewer_id", F.md5("text").alias("text_md5")
    )


def _extracted_sql(rating: str, title: str, date: str, reviewer: str, kept: str) -> str:
    return with_base(
        f"""SELECT page_id, CAST(0 AS INTEGER) AS pos, product_id, md5(concat(reviewer_id, date, product_id)) AS review_id,
                   rating, title, date, reviewer_id, md5(body) AS text_md5
            FROM (SELECT arrival_seq AS page_id, concat('https://shop.example/item/', CAST(arrival_seq AS VARCHAR)) AS product_id,
                         CAST({rating} AS INTEGER) AS rating, {title} AS title, {date} AS date, {reviewer} AS reviewer_id,
                         {_strip_sql('text')} AS body, {kept} AS kept
                  FROM (SELECT *, arrival_seq % 8 AS v8, arrival_seq % 9 AS v9 FROM reviews_in) r) t
            WHERE kept AND body <> ''"""
    )


@register(
    "extract_reviews_a",
    _extracted_sql(
        rating="CASE WHEN v8 = 1 THEN 0 ELSE coalesce(rating, 0) END",
        title=f"regexp_replace({_strip_sql('title')}, {STARS_SQL}, '')",
        date="date",
        reviewer="CASE v8 WHEN 4 THEN 'anonymous' ELSE reviewer_id END",
        kept="v8 NOT IN (2, 3)",
    ),
)
def q_extract_reviews_a(spark, sf):
    """Marketplace A, by arrival_seq % 8: no star (1), star text that fails
    (2), empty body (3), no author (4), author name (5), star label in the
    title (6), deeply nested body (7). A second container has no body."""
    b = reviews_in(spark, sf)
    v = F.col("arrival_seq") % 8
    stars = F.concat(F.coalesce("rating", F.lit(0)).cast("string"), F.lit(".0 out of 5 stars"))
    label = F.when(v == 2, F.lit("abc out of 5")).otherwise(stars)
    star = F.when(v == 1, F.lit("")).otherwise(_tag('<i data-hook="review-star-rating"><span> ', label, "</span></i>"))
    title = F.when(
        v == 6, _tag('<span data-hook="review-title">5.0 out of 5 stars ', _escaped("title"), "</span>")
    ).otherwise(_tag('<a data-hook="review-title">', _escaped("title"), "</a>"))
    text = F.when(v == 3, F.lit(" ")).when(v == 7, _deep(_escaped("text"))).otherwise(_escaped("text"))
    date = F.date_format(F.col("date").try_cast("date"), "d MMMM yyyy")
    author = (
        F.when(v == 4, F.lit(""))
        .when(v == 5, _tag('<span class="a-profile-name">', F.col("reviewer_id"), "</span>"))
        .otherwise(_tag('<a class="a-profile author" href="/gp/profile/', F.col("reviewer_id"), '?ref=x">x</a>'))
    )
    html = F.concat(
        F.lit('<html><body><div data-hook="review">'),
        star,
        title,
        _tag('<span data-hook="review-body">', text, "</span>"),
        _tag('<span data-hook="review-date">Reviewed in India on ', date, "</span>"),
        author,
        F.lit('</div><div data-hook="review"><span data-hook="review-body"> </span></div></body></html>'),
    )
    return _extracted(_page_rows(b, "Amazon", html))


@register(
    "extract_reviews_b",
    _extracted_sql(
        rating="CASE WHEN v9 = 1 THEN 0 ELSE coalesce(rating, 0) END",
        title=_strip_sql("title"),
        date="CASE v9 WHEN 5 THEN '' ELSE concat(substr(date, 1, 8), '01') END",
        reviewer="CASE v9 WHEN 0 THEN 'anonymous' ELSE reviewer_id END",
        kept="v9 NOT IN (2, 4)",
    ),
)
def q_extract_reviews_b(spark, sf):
    """Marketplace B: three container classes (arrival_seq % 3); by
    arrival_seq % 9 no reviewer (0), no star (1), star text that fails (2),
    other title class (3), only READ MORE in the body (4), no date (5), other
    name class (6), deeply nested body (7), no READ MORE (8)."""
    b = reviews_in(spark, sf)
    v = F.col("arrival_seq") % 9
    box = F.element_at(F.array(F.lit("RcXBOT"), F.lit("col _2wzgFH K0kLPL"), F.lit("x EKFha-9z")), (v % 3 + 1).cast("int"))
    stars = F.concat(F.coalesce("rating", F.lit(0)).cast("string"), F.when(v == 2, F.lit(" stars")).otherwise(F.lit(".7")))
    star = F.when(v == 1, F.lit("")).otherwise(_tag('<div class="XQDdHH">', stars, "</div>"))
    title_open = F.when(v == 3, F.lit('<p class="_2-N8zT">')).otherwise(F.lit('<p class="z9E0IG">'))
    text = F.when(v == 4, F.lit("")).when(v == 7, _deep(_escaped("text"))).otherwise(_escaped("text"))
    body = F.when(v == 8, _tag('<div class="t-ZTKy">', text, "</div>")).otherwise(
        _tag('<div class="ZmyHeo">', text, '<span class="teGi1e">READ MORE</span></div>')
    )
    date = F.date_format(F.col("date").try_cast("date"), "MMM, yyyy")
    posted = F.when(v == 5, F.lit("")).otherwise(_tag('<p class="_2mcZGG">Certified Buyer, ', date, "</p>"))
    name_open = F.when(v == 6, F.lit('<p class="MrFlB3">')).otherwise(F.lit('<p class="_2V5EHH">'))
    name = F.when(v == 0, F.lit("")).otherwise(F.concat(name_open, F.col("reviewer_id"), F.lit("</p>")))
    html = F.concat(
        _tag('<html><body><div class="', box, '">'), star, title_open, _escaped("title"), F.lit("</p>"),
        body, posted, name, F.lit("</div></body></html>"),
    )
    return _extracted(_page_rows(b, "flipkart", html))


LISTINGS_SQL = """listings AS (
  SELECT CASE v WHEN 2 THEN 'AMAZON' WHEN 5 THEN 'flipkart' WHEN 6 THEN 'web' ELSE 'amazon' END AS source,
         CASE v WHEN 0 THEN concat('https://m.shop.example/item/dp/', code, '/ref=x?th=1')
                WHEN 1 THEN concat('https://shop.example/product-reviews/', code, '?pageNumber=4&reviewerType=critical')
                WHEN 2 THEN concat('https://shop.example/product-reviews/', code, '?sortBy=recent')
                WHEN 3 THEN concat('https://shop.example/gp/help/', code)
                WHEN 4 THEN '' ELSE url END AS url, code, v
  FROM (SELECT url, page_id % 7 AS v, upper(substr(md5(CAST(page_id AS VARCHAR)), 1, 10)) AS code FROM pages) p)"""


@register(
    "crawl_frontier_sources",
    f"""WITH {LISTINGS_SQL}
        SELECT DISTINCT lower(source) AS source, url AS listing, CAST(p AS INTEGER) AS page_no,
               CASE v WHEN 0 THEN concat('https://www.amazon.in/product-reviews/', code, '/ref=cm_cr_arp_d_paging_btm_next_', p,
                                         '?ie=UTF8&reviewerType=all_reviews&pageNumber=', p)
                      WHEN 1 THEN concat('https://shop.example/product-reviews/', code, '?pageNumber=', p, '&reviewerType=critical')
                      WHEN 2 THEN concat('https://shop.example/product-reviews/', code, '?sortBy=recent&pageNumber=', p)
                      ELSE concat(split_part(url, '?', 1), '?page=', p) END AS page_url
        FROM listings, range(1, 11) r(p) WHERE v IN (0, 1, 2, 5) AND url <> ''""",
)
def q_crawl_frontier_sources(spark, sf):
    """Page URLs of both marketplaces; a help page, a blank URL and
    an unknown source give none."""
    v = F.col("page_id") % 7
    code = F.upper(F.substring(F.md5(F.col("page_id").cast("string")), 1, 10))
    url = (
        F.when(v == 0, F.concat(F.lit("https://m.shop.example/item/dp/"), code, F.lit("/ref=x?th=1")))
        .when(v == 1, F.concat(F.lit("https://shop.example/product-reviews/"), code, F.lit("?pageNumber=4&reviewerType=critical")))
        .when(v == 2, F.concat(F.lit("https://shop.example/product-reviews/"), code, F.lit("?sortBy=recent")))
        .when(v == 3, F.concat(F.lit("https://shop.example/gp/help/"), code))
        .when(v == 4, F.lit(""))
        .otherwise(F.col("url"))
    )
    source = F.when(v == 2, F.lit("AMAZON")).when(v == 5, F.lit("flipkart")).when(v == 6, F.lit("web")).otherwise(F.lit("amazon"))
    return H.crawl_frontier(table(spark, sf, "pages").select(source.alias("source"), url.alias("url")))


@register(
    "configured_sources",
    with_base(
        """SELECT c.product_id, c.source, c.v > 2 AS configured,
                  CAST(CASE WHEN c.v > 2 THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS new_reviews
           FROM (SELECT product_id, source, min(arrival_seq) % 6 AS v FROM reviews_in GROUP BY 1, 2) c
           LEFT JOIN (SELECT product_id, lower(source) AS s, count(*) AS n FROM store GROUP BY 1, 2) n
             ON c.product_id = n.product_id AND lower(c.source) IS NOT DISTINCT FROM n.s"""
    ),
)
def q_configured_sources(spark, sf):
    """New reviews a (product, source), 0 where the URL is blank or one
    of the placeholders."""
    b = reviews_in(spark, sf)
    config = b.groupBy("product_id", "source").agg((F.min("arrival_seq") % 6).alias("v"))
    url = (
        F.when(F.col("v") == 0, F.lit(""))
        .when(F.col("v") == 1, F.lit("https://shop.example/PRODUCT_ID_HERE"))
        .when(F.col("v") == 2, F.lit("https://shop.example/product-url-here"))
        .otherwise(F.lit("https://shop.example/dp/B000000000"))
    )
    return I.source_counts(config.select("product_id", "source", url.alias("url")), first_per_key(b))


@register(
    "union_batches",
    with_base(
        f"""SELECT md5(concat(reviewer_id, date, product_id)) AS review_id, product_id, source, rating, title, date
            FROM (SELECT reviewer_id, date, product_id, 'amazon' AS source, rating, '' AS title
                  FROM reviews_in WHERE ingested_at < TIMESTAMP '{LOAD_SPLIT}' AND rating IS NOT NULL AND text <> ''
                    AND CAST(date AS DATE) > DATE '{SINCE}'
                  UNION ALL
                  SELECT reviewer_id, date, 'prod_x', lower(source), rating, title
                  FROM reviews_in WHERE ingested_at >= TIMESTAMP '{LOAD_SPLIT}' AND rating IS NOT NULL AND text <> '') u"""
    ),
)
def q_union_batches(spark, sf):
    """A load without titles, relabelled by source and read
    since a day, and one relabelled by product; rows without a rating come
    with an empty body and go."""
    b = reviews_in(spark, sf).drop("review_id")
    b = b.withColumn("text", F.when(F.col("rating").isNotNull(), F.col("text")).otherwise(F.lit("")))
    cut = F.lit(LOAD_SPLIT).cast("timestamp_ntz")
    early = I.normalize_reviews(b.filter(F.col("ingested_at") < cut).drop("title"), source="Amazon", since=SINCE)
    late = I.normalize_reviews(b.filter(F.col("ingested_at") >= cut), product_id="prod_x")
    return I.union_batches([early, late]).select("review_id", "product_id", "source", "rating", "title", "date")


@register(
    "delta_log_document",
    with_base(
        "SELECT rl.run_date, product_id, source, source_new, CAST(product_new AS BIGINT) AS product_new, "
        "CAST(total_new AS BIGINT) AS total_new, total_in_db FROM rl JOIN rt ON rl.run_date = rt.run_date",
        RUNLOG_SQL,
    ),
)
def q_delta_log_document(spark, sf):
    """Log documents, each an indented array or a single entry, read back."""
    from revq.session import scratch_dir

    path = scratch_dir(spark, "runlog_documents")
    log = I.run_log(_reviews(spark, sf))
    entry = F.to_json(F.struct(*log.columns), {"pretty": "true"})
    whole = F.when(F.dayofmonth("run_date") % 2 == 0, F.concat(F.lit("[\n"), entry, F.lit("\n]"))).otherwise(entry)
    log.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return I.flatten_run_log(I.read_run_log(spark, path, document=True))


@register("unprocessed_by_key", with_base("SELECT review_id, product_id, arrival_seq FROM store WHERE processed = 1"))
def q_unprocessed_by_key(spark, sf):
    """Rows without an analysis, by anti join with the analysis table."""
    s = _reviews(spark, sf)
    analysis = C.classify_batch(s.filter(F.col("processed") == 0))
    return C.unprocessed(s, analysis).select("review_id", "product_id", "arrival_seq")


@register(
    "top_new_theme",
    with_base("SELECT t AS theme, count(*) AS cnt FROM (SELECT unnest(themes) AS t FROM cb) u GROUP BY t ORDER BY cnt DESC, theme LIMIT 1", CLASSIFY_SQL),
)
def q_top_new_theme(spark, sf):
    """The most frequent theme of one run (the single row is the feature)."""
    return C.top_new_theme(C.classify_batch(_reviews(spark, sf).filter(F.col("processed") == 0)))


@register(
    "weekly_counts_stream",
    with_base(
        """SELECT CAST(week_start AS DATE) AS week_start, product_id, n
           FROM (SELECT date_trunc('week', ingested_at) AS week_start, product_id, count(*) AS n FROM reviews_in GROUP BY 1, 2) w,
                (SELECT max(ingested_at) AS latest FROM reviews_in) m
           WHERE week_start + INTERVAL 7 DAY <= latest - INTERVAL 1 DAY"""
    ),
)
def q_weekly_counts_stream(spark, sf):
    """Weeks that the watermark has closed, written by the stream."""
    from revq.session import scratch_dir
    from revq.streaming.ingest import weekly_counts_stream

    base = scratch_dir(spark, "weekly")
    b = reviews_in(spark, sf).select("product_id", "ingested_at")
    b.write.parquet(f"{base}/landing")
    weeks = weekly_counts_stream(spark.readStream.schema(b.schema).parquet(f"{base}/landing"))
    q = weeks.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
    q.trigger(availableNow=True).start(f"{base}/weeks").awaitTermination()
    out = spark.read.schema(weeks.schema).parquet(f"{base}/weeks")
    return out.select(F.to_date("week_start").alias("week_start"), "product_id", "n")


LISTED_SQL = """listed AS (
  SELECT page_id, concat('listing-', page_id // 12) AS listing, CAST(page_id % 12 + 1 AS INTEGER) AS page_no,
         page_id % 5 <> 3 AND html IS NOT NULL AS fetched,
         CASE WHEN page_id % 17 = 8 THEN 0
              ELSE coalesce(CAST((length(html) - length(replace(html, '<article', ''))) // 8 AS BIGINT), 0) END AS n_reviews
  FROM pages)"""


@register(
    "page_cutoff_gaps",
    f"""WITH {LISTED_SQL}
        SELECT page_id, l.listing, page_no, fetched, n_reviews FROM listed l
        LEFT JOIN (SELECT listing, min(page_no) AS cut FROM listed WHERE fetched AND n_reviews = 0 GROUP BY listing) c
          ON l.listing = c.listing
        WHERE fetched AND (cut IS NULL OR page_no < cut)""",
)
def q_page_cutoff_gaps(spark, sf):
    """S3 with twelve pages a listing, failed fetches and empty pages."""
    i = F.col("page_id")
    listed = H.page_listing(table(spark, sf, "pages")).select(
        "page_id",
        F.concat(F.lit("listing-"), F.floor(i / 12).cast("string")).alias("listing"),
        (i % 12 + 1).cast("int").alias("page_no"),
        (F.col("fetched") & (i % 5 != 3)).alias("fetched"),
        F.when(i % 17 == 8, F.lit(0)).otherwise(F.col("n_reviews")).cast("long").alias("n_reviews"),
    )
    return H.page_cutoff(listed)


# (question, expected template), by conv_id + turn modulo their number
QUESTIONS = [
    ("How is the ANC of Product 1 rated?", "theme_by_sentiment"),
    ("COMPARE the battery life complaints of both", "complaints_by_product"),
    ("What are the top 1-star complaints?", "one_star_reasons"),
    ("Give reasons behind 1-star reviews", "one_star_reasons"),
    ("Which has better comfort?", "praise_by_product"),
    ("1-star reviews, please", "total_reviews"),
    ("battery life complaints only", "total_reviews"),
]


@register(
    "route_questions_all",
    f"""SELECT conv_id, turn, CASE (conv_id + turn) % {len(QUESTIONS)} """
    + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(QUESTIONS))
    + " END AS template FROM conversations WHERE role = 'user'",
)
def q_route_questions_all(spark, sf):
    """Q2: every user turn asks one of seven questions, so all routes are taken."""
    from revq.operators.adhoc import route_questions

    asked = F.element_at(F.array(*[F.lit(q) for q, _ in QUESTIONS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTIONS))) + 1).cast("int"))
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return route_questions(c.select("conv_id", "turn", asked.alias("text"))).select("conv_id", "turn", "template")


@register("store_retry", with_base("SELECT review_id, arrival_seq, product_id FROM store"))
def q_store_retry(spark, sf):
    """The second load ends early and leaves rows without a commit
    mark; a new run with bucketed keys replays both loads. The store is as if
    every load had run once."""
    from revq.session import scratch_dir
    from revq.sources.store import ReviewStore

    root = scratch_dir(spark, "store_retry")
    b = reviews_in(spark, sf)
    cut = F.lit(LOAD_SPLIT).cast("timestamp_ntz")
    early, late = b.filter(F.col("ingested_at") < cut), b.filter(F.col("ingested_at") >= cut)
    first = ReviewStore(spark, root)
    first.append(early, 1, "2024-02-01 00:00:00")
    late.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{first.raw_path}/load=2")
    again = ReviewStore(spark, root, key_buckets=8)
    again.append(early, 1, "2024-02-01 00:00:00")
    for _ in range(2):
        again.append(late, 2, "2024-03-01 00:00:00")
    return again.raw().select("review_id", "arrival_seq", "product_id")
