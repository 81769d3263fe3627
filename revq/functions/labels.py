"""Sanitising model answers (H13-H16, I5, I6) as Column expressions.

An answer is JSON text ``{"sentiment", "themes", "confidence"}``, maybe
inside a code fence. Rules, in the reference's order:

* sentiment outside Positive/Negative/Neutral (or missing) -> Neutral;
* themes: keep taxonomy members (duplicates kept); none -> [default];
  a missing key reads as [], a plain string keeps nothing;
* confidence: missing -> 0.5; clamped to [0, 1] (NaN -> 1.0);
* anything the reference would fail on -> the fallback answer: text that is
  not a JSON object, ``themes`` null / number / boolean, ``confidence`` null
  or not a number.

Everything runs on the JVM. The answer is read as a VARIANT, so each value's
own JSON type decides: a string that looks like a list is a string, and only
the top-level keys count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revq.functions.text import _c, py_strip
from revq.schema import (
    DEFAULT_CONFIDENCE,
    FALLBACK_CONFIDENCE,
    FALLBACK_SENTIMENT,
    FALLBACK_THEMES,
    SENTIMENTS,
    THEME_TAXONOMY,
)

ColumnOrName = Column | str

NUMBER = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def strip_fence(raw: ColumnOrName) -> Column:
    """Drop a leading ```lang line and everything from the last ``` on."""
    s = py_strip(_c(raw))
    body = F.regexp_replace(s, r"^[^\n]*\n", "")
    body = F.when(body.contains("```"), F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)
    return F.when(s.startswith("```"), py_strip(body)).otherwise(s)


def quote_non_finite(body: Column) -> Column:
    """Python's JSON reader accepts bare NaN / Infinity / -Infinity values;
    quote them so Spark's reader accepts the object and the number is read
    by ``try_cast`` (which understands those spellings)."""
    return F.regexp_replace(body, r":\s*(-?Infinity|NaN)(\s*[,}\]])", ':"$1"$2')


def sanitize_answer(raw: ColumnOrName) -> Column:
    """STRUCT<sentiment, themes ARRAY<STRING>, confidence DOUBLE, fallback BOOLEAN>."""
    v = F.try_parse_json(quote_non_finite(strip_fence(raw)))
    is_object = F.schema_of_variant(v).startswith("OBJECT<")

    def field(key: str) -> tuple[Column, Column]:
        """(value, its JSON type; NULL where the key is missing)"""
        x = F.try_variant_get(v, f"$.{key}", "variant")
        return x, F.schema_of_variant(x)

    sent, sent_type = field("sentiment")
    sent = F.when(sent_type == "STRING", sent.try_cast("string"))
    sentiment = F.when(sent.isin(*SENTIMENTS), sent).otherwise(F.lit("Neutral"))

    listed, themes_type = field("themes")
    is_list, is_map = themes_type.startswith("ARRAY<"), themes_type.startswith("OBJECT<")
    members = F.when(is_list, F.try_variant_get(v, "$.themes", "array<variant>"))
    texts = F.transform(members, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.try_cast("string")))
    texts = F.when(is_map, F.json_object_keys(F.to_json(listed))).otherwise(texts)
    taxonomy = F.array(*[F.lit(t) for t in THEME_TAXONOMY])
    kept = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.array_contains(taxonomy, t))
    themes = F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(t) for t in FALLBACK_THEMES]))
    themes_bad = themes_type.isNotNull() & ~(is_list | is_map | (themes_type == "STRING"))

    c_raw, conf_type = field("confidence")
    c_text = c_raw.try_cast("string")
    c_num = (
        F.when(conf_type == "BOOLEAN", c_raw.try_cast("boolean").cast("int").cast("double"))
        .when((conf_type == "STRING") & ~py_strip(c_text).rlike(NUMBER), F.lit(None).cast("double"))
        .when(conf_type == "STRING", py_strip(c_text).try_cast("double"))
        .otherwise(c_raw.try_cast("double"))
    )
    conf_bad = conf_type.isNotNull() & c_num.isNull()
    conf = F.when(conf_type.isNotNull(), c_num).otherwise(F.lit(DEFAULT_CONFIDENCE))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))

    failed = F.coalesce(~is_object, F.lit(True)) | themes_bad | conf_bad
    fb = F.struct(
        F.lit(FALLBACK_SENTIMENT).alias("sentiment"),
        F.array(*[F.lit(t) for t in FALLBACK_THEMES]).alias("themes"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        F.lit(True).alias("fallback"),
    )
    ok = F.struct(
        sentiment.alias("sentiment"),
        themes.alias("themes"),
        conf.alias("confidence"),
        F.lit(False).alias("fallback"),
    )
    return F.when(failed, fb).otherwise(ok)


def answer_elements(raw: ColumnOrName) -> Column:
    """ARRAY<STRING> of the elements of a batch answer (each as JSON text).

    NULL when the answer is not a JSON array.
    """
    body = strip_fence(raw)
    return F.when(py_strip(body).startswith("["), F.from_json(body, "array<string>"))
