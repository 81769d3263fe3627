"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) have the weights 3, 1, 2, repeating,
and share a budget of 150 % of all words; a source gets at most twice its own
words, the excess is shared again by weight. Each source's documents are
shuffled by a hash of doc_id and queued twice in that order; a queued copy's
virtual finish time is (words of its source queued so far) / (source's target).
All copies are put in order of finish time and taken while the total stays
within the budget.

Scale: running totals per source come in three levels of hash prefixes (two
hex digits, four, then rows), so no source is ever one group; the order of
finish times is a range partition into ``GRID`` bins whose totals give the bin
where the budget ends, refined once more, and only that fine bin is sorted.
Text is read once; everything after it is narrow, and pre-aggregated before it
is shuffled. The per-source table (a row per source) is joined by the
planner's choice.

Nulls and odd input: a null text has no words; documents without words are
taken zero times; null source is a source of its own; rows that repeat a
document queue as separate copies; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.common import WORD, fresh, tidy, with_row_key, written

WEIGHTS = (3, 1, 2)  # fixed
EPOCHS = 2  # fixed: a document is taken at most twice
GRID, FINE, LAST = 1024, 4096, 8  # bins of finish time per unit, finer bins of a bin, time of the last bin


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, key): words of each text and its place in the shuffle.

    Rows without doc_id take their places by their texts, so that they do not
    all stand in one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    of_text = F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), of_text)))
    ref = F.lit(None) if row is None else F.col(row)
    return docs.select(ref.cast("decimal(38,0)").alias("row"), "doc_id", "source", size.alias("size"), key.alias("key"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, src, source_size, target): a row per source; ``src`` numbers them."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("s"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    src = by_source.withColumn("src", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("long")
    every = Window.partitionBy()
    # sources that reach twice their size first come first
    fill = Window.orderBy((F.col("s") * 2 / F.col("w")), "src")
    src = src.withColumn("w", weight).withColumn("t", F.sum("s").over(every))
    src = src.withColumn("c", F.coalesce(F.sum("s").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    src = src.withColumn("rest_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("rest", 3 * F.col("t") - 4 * F.col("c"))  # twice the budget not given to capped sources
    src = src.withColumn("open", 4 * F.col("s") * F.col("rest_w") >= F.col("w") * F.col("rest"))
    first = F.min(F.when(F.col("open"), F.struct("c", "rest", "rest_w"))).over(every)
    src = src.withColumn("first", first)
    share = (F.col("w") * F.col("first.rest")).cast("double") / (2 * F.col("first.rest_w")).cast("double")
    target = F.when(F.col("open"), share).otherwise((2 * F.col("s")).cast("double"))
    return src.select("source", "src", F.col("s").alias("source_size"), target.alias("target"))


def queued(sized: DataFrame, target: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and ``before``: the source's words queued ahead in one round."""
    named = sized.join(target, sized["source"].eqNullSafe(target["source"])).select(
        "row", "doc_id", sized["source"], "size", "key", "src", "source_size", "target", F.substring("key", 1, 2).alias("p2"), F.substring("key", 1, 4).alias("p4")
    )
    named = written(named, "queued")
    at4 = named.groupBy("src", "p2", "p4").agg(F.sum("size").alias("x4"))
    at2 = named.groupBy("src", "p2").agg(F.sum("size").alias("x2"))
    ahead = Window.unboundedPreceding, -1
    off2 = F.coalesce(F.sum("x2").over(Window.partitionBy("src").orderBy("p2").rowsBetween(*ahead)), F.lit(0))
    off4 = F.coalesce(F.sum("x4").over(Window.partitionBy("src", "p2").orderBy("p4").rowsBetween(*ahead)), F.lit(0))
    at4 = at4.select("src", "p2", "p4", off4.alias("o4")).join(at2.select("src", "p2", off2.alias("o2")), ["src", "p2"])
    at4 = written(at4.select("src", "p4", (F.col("o2") + F.col("o4")).alias("off")), "offsets")
    own = Window.partitionBy("src", "p4").orderBy("key", "doc_id", "size").rowsBetween(*ahead)
    rows = named.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.join(at4, ["src", "p4"]).withColumn("before", F.col("off") + F.col("inner"))


@tidy
def mix(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken) of every row; ``row`` names a column that tells rows apart."""
    sized = written(sizes(docs, row), "sizes")
    target = written(targets(sized), "targets")
    rows = written(queued(sized, target).select("row", "doc_id", "source", "size", "source_size", "target", "key", "before"), "mixed")
    total = target.agg(F.sum("source_size")).first()[0] or 0

    def finish(epoch: int) -> F.Column:
        return (F.lit(epoch) * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target")

    copies = rows.filter("size > 0").select(
        "size", "key", "doc_id", F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), finish(e).alias("f")) for e in range(EPOCHS)))).alias("copy")
    )
    copies = copies.select("size", F.struct("copy.f", "key", "doc_id", "copy.epoch").alias("place"))
    copies = copies.withColumn("bin", F.least(F.floor(F.col("place.f") * GRID), F.lit(GRID * LAST)))
    copies = copies.withColumn("fine", F.least(F.floor(F.col("place.f") * GRID * FINE), F.lit(GRID * LAST * FINE)))

    def end_of(df: DataFrame, by: str, room: int) -> tuple[int, int] | None:
        """The bin where ``room`` words are used up, and the words before it."""
        run = df.groupBy(by).agg(F.sum("size").alias("x")).withColumn("upto", F.sum("x").over(Window.orderBy(by)))
        row = run.filter(F.col("upto") * 2 > room).orderBy(by).select(by, F.col("upto") - F.col("x")).first()
        return (row[0], room - 2 * row[1]) if row else None

    room = 3 * total  # twice the budget
    last = None
    cut = end_of(copies, "bin", room)
    if cut:
        inside = copies.filter(F.col("bin") == cut[0])
        cut = end_of(inside, "fine", cut[1])
        order = inside.filter(F.col("fine") == cut[0]).withColumn(
            "upto", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        )
        last = order.filter(F.col("upto") * 2 > cut[1]).agg(F.min("place").alias("p")).first()["p"]

    def taken(epoch: int) -> F.Column:
        if last is None:
            inside = F.lit(True)
        else:
            place = F.struct(finish(epoch).alias("f"), "key", "doc_id", F.lit(epoch).alias("epoch"))
            stop = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["epoch"]).alias("epoch"))
            inside = place < stop
        return F.when((F.col("size") > 0) & inside, F.col("size")).otherwise(F.lit(0))

    return rows.select(
        "row", "doc_id", "source", "size", "source_size", "target", sum(map(taken, range(EPOCHS))).cast("long").alias("taken")
    )


@tidy
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them (0, 1 or 2 times); columns as they came.

    Every row has a key of its own, so it comes as often as the mix took that
    row, whatever doc_id and text it shares with others.
    """
    row, times, copy = fresh(docs, "row", "times", "copy")
    rows = with_row_key(docs, row)
    taken = mix(rows, row).filter("taken > 0").select(F.col("row").alias(row), F.expr("cast(taken div size as int)").alias(times))
    joined = rows.join(taken, row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*(F.col(f"`{c}`") for c in docs.columns))
