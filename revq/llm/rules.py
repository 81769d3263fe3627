"""Quality rules with thresholds learned per language and source.

Pass 1 reads each whole text once and makes its counts (words, symbols,
repeated lines, repeated three-word windows). The ratios of all documents go
into KLL quantile sketches per (lang, source); the sketches are merged into
one per language and one for all rows. A document is held against the fences
of its own group, or of the next wider one if its group has fewer than
``MIN_ROWS`` documents. The fence table (a few numbers per group) is joined
back to the counts; no text is shuffled.

A fence lies beyond the group's outer quantile (``OUTER``), by ``SPREAD``
times that quantile's distance from the group's median; so it follows the
group's own habits. Where the two are one, as for a ratio that is 0 in most
documents, a least distance stands in: a few symbols or repeated words in a
document of the group's median length, a small share of lines, a part of a
letter. It lies far under what the ratios of rejected documents are.

Nulls and odd input: a null or empty text has no words and fails the base rule
(fewer than 50 words); null lang or source is a group of its own; repeated
rows are judged alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.common import in_tasks, texts_of, tidy, written
from revq.llm.words import blocks, owners, shingles, word_hashes

MIN_WORDS, MAX_REPEAT = 50, 50  # fixed: base rule
SYMBOLS = b"#*$%&|<>"  # fixed
MIN_ROWS = 200
SPREAD = 3.0
# ratio -> outer quantile of its group: above it lies what a group may hold of junk
OUTER = {"symbols": 0.9, "dup_lines": 0.95, "repeats": 0.9, "word_len": 0.9}
# least distance of that quantile from the median, where a group has hardly any spread: so many symbols or
# repeated words in a document of the group's median length; a share of lines; a part of a letter
LEAST_COUNT = {"symbols": 5, "repeats": 15}
LEAST = {"dup_lines": 0.05, "word_len": 0.1}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def count_block(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    h, bounds = word_hashes(texts)
    n = len(texts)
    x, at = shingles(h, bounds, 3)
    own = owners(bounds)
    hot = np.zeros(len(h), bool)
    if len(x):
        key = own[at]
        order = np.lexsort((x, key))
        same = np.zeros(len(x), bool)
        eq = (x[order][1:] == x[order][:-1]) & (key[order][1:] == key[order][:-1])
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
        first = at[same]
        for i in range(3):
            hot[first + i] = True
    chars, symbols, dup, lines = (np.zeros(n, np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        chars[i] = len(b"".join(t.split()).decode("utf-8"))
        symbols[i] = sum(map(t.count, (SYMBOLS[k : k + 1] for k in range(len(SYMBOLS)))))
        filled = [s for s in t.split(b"\n") if s.strip()]
        lines[i], dup[i] = len(filled), len(filled) - len(set(filled))
    return {
        "n_words": np.diff(bounds), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup,
        "n_repeat_words": np.bincount(own[hot], minlength=n), "n_lines": lines,
    }


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for first, end in blocks(texts):
            made = count_block(texts[first:end])
            kept = [batch.column(c).slice(first, end - first) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v.astype(np.int64)) for v in made.values())], names=["doc_id", "lang", "source", *made]
            )


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts ...) of every row."""
    return docs.select("doc_id", "lang", "source", "text").transform(in_tasks, _counts, f"doc_id long, lang string, source string, {COUNTS}"
    )


def ratios() -> dict[str, F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "word_len": F.col("word_chars") / words,
    }


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, cut) per group, from merged sketches: low, middle and outer quantile of
    every ratio, and the median length.

    Sketches of (lang, source) are made with map-side partial sketches; those
    of a language and of everything are merges of them.
    """
    named = counts.filter("n_words > 0").select("lang", "source", F.col("n_words").cast("double").alias("words"), *(c.alias(k) for k, c in ratios().items()))
    sketched = [*OUTER, "words"]
    leaf = named.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(k).alias(k) for k in sketched)
    )
    leaf = written(leaf, "sketches")

    def merge(*keys: str) -> DataFrame:
        return leaf.groupBy(*keys).agg(
            F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in sketched)
        )

    wanted = {f"{k}_{name}": (k, q) for k, out in OUTER.items() for name, q in (("lo", 1 - out), ("mid", 0.5), ("hi", out))}
    wanted["words_mid"] = ("words", 0.5)

    def cuts(df: DataFrame, prefix: str) -> list[F.Column]:
        made = F.struct(*(F.kll_sketch_get_quantile_double(k, F.lit(q)).alias(name) for name, (k, q) in wanted.items()))
        return [F.col("n").alias(f"{prefix}_n"), made.alias(prefix)]

    own = leaf.select("lang", "source", *cuts(leaf, "own"))
    lang = merge("lang")
    lang = lang.select(F.col("lang").alias("lang_"), *cuts(lang, "wide"))
    every = merge()
    row = {"every_n": 0} if leaf.isEmpty() else every.select(*cuts(every, "every")).first()  # one row of a dozen numbers
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")))
    whole = F.struct(*(F.lit(row["every"][k] if row["every_n"] else None).cast("double").alias(k) for k in wanted))
    pick = F.when(F.col("own_n") >= MIN_ROWS, F.col("own")).when(F.col("wide_n") >= MIN_ROWS, F.col("wide")).otherwise(whole)
    return both.select("lang", "source", pick.alias("cut"))


@tidy
def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and the rules that failed (``reasons``) per row."""
    counts = written(text_counts(docs), "counts")
    cut = written(fences(counts), "fences").select(F.col("lang").alias("l_"), F.col("source").alias("s_"), "cut")
    joined = counts.join(
        cut,
        F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")),
        "left",
    )
    r = ratios()

    def beyond(k: str, side: str) -> F.Column:
        """The fence: the outer quantile and ``SPREAD`` times its distance from the median."""
        end, mid = F.col(f"cut.{k}_{side}"), F.col(f"cut.{k}_mid")
        least = F.lit(LEAST_COUNT[k]) / F.col("cut.words_mid") if k in LEAST_COUNT else F.lit(LEAST[k])
        far = F.lit(SPREAD) * F.greatest(F.abs(end - mid), least)
        return end + far if side == "hi" else end - far

    outside = {k: c > beyond(k, "hi") for k, c in r.items()}
    outside["short_words"] = (F.col("n_words") > 0) & (r["word_len"] < beyond("word_len", "lo"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    reasons = F.filter(
        F.array(F.when(base, "base"), *(F.when(c, k) for k, c in outside.items())), lambda x: x.isNotNull()
    )
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.size(reasons) == 0).alias("kept"), reasons.alias("reasons"),
    )
