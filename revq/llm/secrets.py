"""Secret scans: three base kinds, and weak parts linked by nearness.

DataFrame functions only. Base kinds are regular expressions over the whole
text, leftmost and non-overlapping per kind, matches that are too short
dropped: ``assign``, ``access``, ``hex``. Weak parts (an identifier, a short
secret, an endpoint) mean nothing alone. They are joined on intervals: a part
is reported only if at most ``SCOPE`` code points lie between it and a
complementary part of the same text, whichever comes first: an identifier or an endpoint needs a secret,
a weak secret needs an identifier or an endpoint. Base hits count as parts
(access as identifier, assign and hex as secret) and always stay. A credential
that is whole in one place gives its parts too: user and password in an
endpoint or after -u, a header's token, a private key block.

A text is split at its matches; the lengths of what lies between and of the
matches, exploded to rows, give the positions by a running sum per text and
kind. Only matches are shuffled, never texts. Running windows over a text's
parts, one each way, give the latest end before a part and the next start after
it, so the work grows with the number of parts, and no pairs are made.

Nulls and odd input: a null or empty text has no spans (spans is '');
rows that repeat a document and its text get equal rows; matches of any length
and number are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.common import fresh, tidy, written

# fixed: the base kinds, in order
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_VALUE = r"^.*?[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 20
HEX, HEX_LEAST = r"[0-9a-f]{24,}", 24
VALUE_LEAST = 6
# weak parts
SCOPE = 300
# a weak name may follow '_', '-' or another non-letter, a camel-case hump, or one of the usual prefixes
LEAD = (
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    r"|(?<=(?<![A-Za-z])(?i:pg|db|my|sql|mysql|mongo|redis|ldap|ftp|ssh|smtp|imap|http|proxy|aws|git|admin|root)))"
)
SECRET_NAME = r"(?i:pwd|pass|pass[_-]?phrase|auth|credentials?|private[_-]?key|access[_-]?key|secret[_-]?(?:access[_-]?)?key)"
ID_NAME = r"(?i:user|user[_-]?name|login|client[_-]?id|account|access[_-]?key[_-]?id)"
# credentials that are whole in one place: an endpoint's user and password, a command's -u user:password, a header's
# token, a key block; each look-behind is guarded by a shorter one, so that most positions fail at one character
OPTION = r"(?:\s-u|\s--user)[\x20=][\"']?"
SECRET_PLACES = [
    r"(?<=:)(?<=://[^\s/@:\"'<>]{1,99}:)[^\s/@\"'<>]{4,}(?=@)",
    r"(?<=:)(?<=" + OPTION + r"[^\s:\"']{1,99}:)[^\s\"']{4,}",
    r"(?<=\x20)(?<=Bearer\x20)(?=[^\s\"']*[0-9])[A-Za-z0-9._~+/-]{8,}=*",
    r"(?<=\x20)(?<=(?i:authorization)[\"']?[:=]\x20{0,4}[\"']?(?i:basic|token)\x20)[A-Za-z0-9._~+/-]{8,}=*",
    r"-----BEGIN\x20(?:[A-Z]{2,10}\x20){0,3}PRIVATE\x20KEY-----[^-]{16,}(?:-----END\x20(?:[A-Z]{2,10}\x20){0,3}PRIVATE\x20KEY-----)?",
]
ID_PLACES = [
    r"(?<=/)(?<=://)[^\s/@:\"'<>]{1,99}(?=:[^\s/@\"'<>]{4,}@)",
    r"(?<=[\x20=\"'])(?<=" + OPTION + r")[^\s:\"']{1,99}(?=:[^\s\"']{4,})",
]
WEAK = {
    "weak_secret": "|".join(
        [r"(?=[PpAaCcSs])" + LEAD + SECRET_NAME + r"[\"']?\x20*[:=]\x20*[\"']?[^\s\"']{4,}", r"(?<![0-9A-Fa-f])[0-9a-f]{16,23}(?![0-9A-Fa-f])", *SECRET_PLACES]
    ),
    "weak_id": "|".join(
        [r"(?=[UuLlCcAa])" + LEAD + ID_NAME + r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", r"AKIA[A-Z0-9]{4,15}(?![A-Z0-9])", *ID_PLACES]
    ),
    "endpoint": r"(?:https?|ftp|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
SECRETS = ("assign", "access", "hex", "weak_secret")  # kinds without one of which nothing counts
PATTERN = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **WEAK}


def _hit(kind: str) -> Column:
    return F.col("text").rlike(PATTERN[kind])


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, at, gap, match): the matches of every kind in text order.

    ``gap`` is the length of the text between the last match and this one.
    Endpoints and identifiers are sought only in texts that hold a secret, as
    nothing else can make them count.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.withColumn("has", F.array(*(F.when(_hit(k), F.lit(k)) for k in SECRETS)))
    found = found.withColumn("has", F.array_compact("has")).filter(F.size("has") > 0)
    found = found.withColumn("kind", F.explode(F.array_union("has", F.array(F.lit("weak_id"), F.lit("endpoint")))))

    def per_kind(make: dict[str, Column]) -> Column:
        out = None
        for kind, col in make.items():
            out = F.when(F.col("kind") == kind, col) if out is None else out.when(F.col("kind") == kind, col)
        return out

    gaps = per_kind({k: F.transform(F.split("text", PATTERN[k], -1), lambda s: F.length(s)) for k in KINDS})
    matches = per_kind({k: F.regexp_extract_all("text", F.lit(PATTERN[k]), F.lit(0)) for k in KINDS})
    both = found.select("doc_id", "h", "kind", gaps.alias("gaps"), matches.alias("matches"))
    both = both.select("doc_id", "h", "kind", F.posexplode(F.arrays_zip("gaps", "matches")).alias("at", "x"))
    return both.select("doc_id", "h", "kind", "at", F.col("x.gaps").alias("gap"), F.col("x.matches").alias("match")).filter("match is not null")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end): base spans and linked weak ones, once per distinct text of a doc_id."""
    hits = parts(docs)
    measured = hits.select("doc_id", "h", "kind", "at", "gap", F.length("match").alias("len"), _long_enough().alias("ok")).distinct()
    run = Window.partitionBy("doc_id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = measured.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).filter("ok")
    placed = placed.withColumn("start", F.col("end") - F.col("len"))
    so_far = Window.unboundedPreceding, Window.currentRow
    up = Window.partitionBy("doc_id", "h").orderBy("start").rangeBetween(*so_far)
    down = Window.partitionBy("doc_id", "h").orderBy(F.col("start").desc()).rangeBetween(*so_far)

    def near(*roles: str) -> Column:
        """Whether the latest end of those that start before, or the next start, is within the scope."""
        is_part = F.col("kind").isin([k for k in KINDS if ROLE[k] in roles])
        last_end, next_start = F.max(F.when(is_part, F.col("end"))).over(up), F.min(F.when(is_part, F.col("start"))).over(down)
        return F.coalesce(F.col("start") - last_end <= SCOPE, F.lit(False)) | F.coalesce(next_start - F.col("end") <= SCOPE, F.lit(False))

    is_base = F.col("kind").isin(*BASE)
    linked = placed.withColumn("sec", near("secret")).withColumn("ext", near("id", "endpoint"))
    keep = is_base | F.when(F.col("kind") == "weak_secret", F.col("ext")).otherwise(F.col("sec"))
    return linked.filter(keep).select("doc_id", "h", "kind", "start", "end")


def _long_enough() -> Column:
    length, kind = F.length("match"), F.col("kind")
    value = F.length(F.regexp_extract("match", ASSIGN_VALUE, 1))
    return (
        F.when(kind == "assign", value >= VALUE_LEAST)
        .when(kind == "access", length >= ACCESS_LEAST)
        .when(kind == "hex", length >= HEX_LEAST)
        .otherwise(F.lit(True))
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_<kind> ..., items) per row of ``docs``; items: sorted (start, rank, kind, end) spans."""
    found = spans(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    item = F.struct("start", rank.alias("rank"), "kind", "end")
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    items = F.coalesce("items", F.expr("array()").cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    joined = joined.select("doc_id", "h", items.alias("items"))

    def count(kind: str) -> Column:
        return F.size(F.filter("items", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", "h", *map(count, KINDS), "items")


def joined_spans(items: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@tidy
def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents that hold no span; columns as they came.

    A text without any secret part passes on the scan. Only the others, a
    small share, are written, scanned for spans and joined with what was found.
    """
    ref, of_text = fresh(docs, "ref", "of_text")
    text = F.coalesce("text", F.lit(""))
    part = F.lit(False)
    for kind in SECRETS:
        part = part | text.rlike(PATTERN[kind])
    some = written(docs.filter(part), "parts")
    bad = spans(some).select(F.col("doc_id").alias(ref), F.col("h").alias(of_text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(ref)) & (F.xxhash64("text") == F.col(of_text))
    return docs.filter(~part).unionByName(some.join(bad, same, "left_anti"))
