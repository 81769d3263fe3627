"""Registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.llm import fingerprint, language, licenses, minhash, mixing, negatives, packing, quality, rules, search, secrets, sentencepiece, tokens
from revq.llm.common import table


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, sum of ids, code points decoded, and whether decoding gave the text back."""
    pieces = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents")))
    per_chunk = pieces.select(
        "row", "doc_id", F.size("ids").cast("long").alias("n"),
        F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"),
        F.length("decoded").cast("long").alias("c"), (F.col("text") == F.col("decoded")).alias("same"),
    )
    return per_chunk.groupBy("row", "doc_id").agg(
        F.sum("n").alias("n_pieces"), F.sum("s").alias("id_sum"), F.sum("c").alias("n_chars"), F.min("same").alias("lossless")
    ).drop("row")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("items", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("items")).alias("spans"),
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("h")


def op6_cws_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: notices found, their names and places, and the best coverage."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.array_sort(F.array_distinct("spans.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("best_coverage"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["last"].cast("string"))), ",").alias("spans"),
    )


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = quality.fit(docs, labels, _fold(5) != 0)
    scored = quality.score(docs, trees)
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = language.identify(table(spark, sf_dir, "documents"), _fold(4) != 2)
    return told.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_sentencepiece, op3_source_mix, op4_secret_scan, op5_minhash_dedup, op6_cws_fingerprint,
        op7_license_scan, op8_quality_trees, op9_adaptive_rules, op10_language_hd,
        op11_best_fit_packing, op12_stratified_search, op13_hard_negatives,
    )
}

ORACLE: dict[str, str] = {
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), concat('text:', md5(coalesce(text, '')))))) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
w AS (SELECT *, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, sum(s) OVER ()::BIGINT AS t FROM src),
fill AS (
  SELECT *, coalesce(sum(s) OVER (ORDER BY s * 2 / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         (sum(w) OVER (ORDER BY s * 2 / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_w
  FROM w),
open AS (SELECT *, 4 * s * rest_w >= w * (3 * t - 4 * c) AS is_open FROM fill),
level AS (SELECT c, 3 * t - 4 * c AS rest, rest_w FROM open WHERE is_open ORDER BY c, rest, rest_w LIMIT 1),
target AS (
  SELECT source, src, s AS source_size, t,
         CASE WHEN is_open THEN CAST(w * (SELECT rest FROM level) AS DOUBLE) / CAST(2 * (SELECT rest_w FROM level) AS DOUBLE)
              ELSE CAST(2 * s AS DOUBLE) END AS target
  FROM open),
queued AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.target, t.t,
         coalesce(sum(d.size) OVER (PARTITION BY t.src ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e.epoch, CAST(e.epoch * source_size + before + size AS DOUBLE) / target AS f
  FROM queued q, (VALUES (0), (1)) e(epoch) WHERE size > 0),
run AS (
  SELECT *, sum(size) OVER (ORDER BY f, key, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies),
got AS (SELECT doc_id, key, before, sum(size)::BIGINT AS taken FROM run WHERE upto * 2 <= 3 * t GROUP BY doc_id, key, before)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN got g ON q.doc_id = g.doc_id AND q.key = g.key AND q.before = g.before AND q.size > 0
""",
    "op5_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)
""",
    "op12_stratified_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
sized AS (SELECT row, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
size AS (SELECT count(*)::HUGEINT AS n_docs, coalesce(sum(n), 0)::HUGEINT AS total FROM sized),
asked AS (
  SELECT row, item_id, unnest(list_distinct(t)) AS term FROM (
    SELECT row_number() OVER () AS row, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM benchmark) b),
tf AS (
  SELECT row, doc_id, n, term, count(*)::HUGEINT AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM sized) u
  WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term),
weight AS (
  SELECT term, floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))::HUGEINT AS w
  FROM tf, size GROUP BY term),
impact AS (
  SELECT tf.row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))) AS x
  FROM tf JOIN weight USING (term), size),
scored AS (
  SELECT a.row AS item, a.item_id, i.row, i.doc_id, sum(x)::BIGINT AS score
  FROM asked a JOIN impact i USING (term) GROUP BY a.row, a.item_id, i.row, i.doc_id HAVING sum(x) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored) r
WHERE rank <= 50
""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, v.row, v.vec_id, v.label = a.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON a.row <> v.row WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT a, anchor_id, row, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON p.a = n.a AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
