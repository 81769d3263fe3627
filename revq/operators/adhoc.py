"""Ad-hoc questions.

* ``adhoc_select``: a read-only SELECT (or WITH … SELECT) over given views,
  in a session of its own, admitted by the classes of its analysed plan;
* the four question templates as parameterised DataFrame functions;
* ``route_questions`` picks a template per question with one CASE chain over
  a table of questions (first matching rule wins);
* ``run_queries`` answers several queries in one plan; one that is refused is
  an error row and the others still answer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# plan nodes that a query over views may consist of; anything else (commands, writes, files, foreign tables) is refused
NODES = set(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except SubqueryAlias View Window "
    "WithWindowDefinition Expand Generate WithCTE CTERelationDef CTERelationRef OneRowRelation LocalRelation Range Sample ResolvedHint Pivot Unpivot "
    "LateralJoin RepartitionByExpression Repartition".split()
)
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
# expressions of that package that run code which is not the engine's own
PLANS = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}  # expressions that hold a plan
FOREIGN = ("Reflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "JavaUDF", "Invoke", "NewInstance")


class QueryRejected(ValueError):
    pass


def clean_query(text: str) -> str:
    """A model's query answer without its code fence, a leading 'SQL' and a last ';'."""
    q = text.strip()
    if q.startswith("```"):
        q = q.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    if q.upper().startswith("SQL"):
        q = q[3:].strip()
    return q[:-1].rstrip() if q.endswith(";") else q


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _check(plan, views: set[str]) -> None:
    """Walk an analysed plan down to the given views; refuse any class that is not on the lists."""
    name = plan.getClass().getSimpleName()
    if name not in NODES:
        raise QueryRejected(f"{name} is not allowed in a query")
    if name == "View":
        table = plan.desc().identifier().table().lower()
        if table not in views:
            raise QueryRejected(f"unknown relation {table}")
        return  # what stands behind a given view is the caller's
    for expression in _items(plan.expressions()):
        _check_expression(expression, views)
    for child in _items(plan.children()):
        _check(child, views)


def _check_expression(e, views: set[str]) -> None:
    kind = e.getClass()
    package, name = kind.getName().rpartition(".")[0] + ".", kind.getSimpleName()
    if not package.startswith(EXPRESSIONS) or any(word in name for word in FOREIGN):
        raise QueryRejected(f"{name} is not allowed in a query")
    if name in PLANS:
        _check(e.plan(), views)
    for child in _items(e.children()):
        _check_expression(child, views)


def adhoc_select(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Run a guarded read-only query over ``views``.

    The query is analysed in a session of its own, with the caller's settings
    but for direct file queries, which are off; the caller's session is not
    touched, so two threads may ask at once. The text stands in a sub-query
    position, which admits one query only, and the classes of the analysed
    plan decide whether it runs: they must be on the lists above, and every
    relation must be one of ``views``.
    """
    from pyspark.errors import AnalysisException, ParseException

    q = clean_query(sql)
    head = q.lstrip("(").lstrip().upper()
    if not (head.startswith("SELECT") or head.startswith("WITH")):
        raise QueryRejected("only SELECT queries are allowed")
    own = spark.newSession()
    for key, value in dict(spark.conf.getAll).items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        shared = f"revq_{uuid.uuid4().hex}"  # global views are seen by every session of the application
        df.createGlobalTempView(shared)
        own.sql(f"CREATE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.{shared}")
    try:
        # newline before the bracket: a trailing '--' comment cannot swallow it
        df = own.sql(f"SELECT * FROM (\n{q}\n) AS adhoc_q")
    except ParseException as e:
        raise QueryRejected(f"not a single query: {str(e)[:200]}") from e
    except AnalysisException as e:
        raise QueryRejected(str(e)[:300]) from e
    _check(df._jdf.queryExecution().analyzed(), {v.lower() for v in views})
    return df.limit(limit) if limit is not None else df


SHOWN = 50  # fixed: result rows that an answer is made from


def run_queries(spark: SparkSession, queries: dict[str, str], views: dict[str, DataFrame], shown: int = SHOWN) -> DataFrame:
    """(name, status, error, n_rows, results): every query answered in one plan (Q4).

    ``results`` are the first ``shown`` rows as JSON text in an array, sorted.
    A query that is refused or cannot be analysed gives status 'error', the
    reason and no results; the other queries are not affected.
    """
    out = None
    for name, sql in queries.items():
        try:
            got = adhoc_select(spark, sql, views)
        except QueryRejected as e:
            part = spark.createDataFrame([(name, "error", str(e))], "name string, status string, error string")
            part = part.select("*", F.lit(0).cast("long").alias("n_rows"), F.array().cast("array<string>").alias("results"))
        else:
            rows = got.limit(shown).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in got.columns))).alias("j"))
            part = rows.agg(F.count("j").alias("n_rows"), F.array_sort(F.collect_list("j")).alias("results")).select(
                F.lit(name).alias("name"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), "n_rows", "results"
            )
        out = part if out is None else out.unionByName(part)
    return out


def theme_fragment(fragment: str) -> F.Column:
    """themes contain ``fragment`` case-insensitively (the reference's
    ``themes LIKE '%x%'`` on JSON text). ``%``/``_`` are matched literally."""
    needle = fragment.lower()
    return F.exists("themes", lambda t: F.lower(t).contains(needle))


# ---- question templates (parameterised) ------------------------------------

def theme_sentiment_for(reviews: DataFrame, product_id: str, fragment: str) -> DataFrame:
    """Per sentiment, count and ROUND(AVG(rating), 1) (half-up) of one
    product's processed reviews mentioning the theme fragment."""
    r = reviews.filter((F.col("product_id") == product_id) & theme_fragment(fragment) & (F.col("processed") == 1))
    return r.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("review_count"), F.round(F.avg("rating"), 1).alias("avg_rating")
    )


def complaints_by_product(reviews: DataFrame, fragment: str) -> DataFrame:
    """Negative processed reviews mentioning the fragment, per product."""
    r = reviews.filter((F.col("sentiment") == "Negative") & theme_fragment(fragment) & (F.col("processed") == 1))
    return r.groupBy("product_id").agg(F.count(F.lit(1)).alias("complaints"))


def one_star_reasons(reviews: DataFrame, k: int = 3) -> DataFrame:
    """Theme lists of 1-star processed reviews, top ``k`` (ties by label)."""
    r = reviews.filter((F.col("rating") == 1) & (F.col("processed") == 1) & F.col("themes").isNotNull())
    g = r.groupBy("themes").agg(F.count(F.lit(1)).alias("count"))
    g = g.select(F.array_join("themes", ", ").alias("themes_label"), "count")
    return g.orderBy(F.desc("count"), "themes_label").limit(k)


def praise_by_product(reviews: DataFrame, fragment: str) -> DataFrame:
    """Positive processed reviews mentioning the fragment, per product,
    with ROUND(AVG(rating), 1); ordered by mentions (ties by product)."""
    r = reviews.filter(theme_fragment(fragment) & (F.col("sentiment") == "Positive") & (F.col("processed") == 1))
    return (
        r.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("positive_mentions"), F.round(F.avg("rating"), 1).alias("avg_rating"))
        .orderBy(F.desc("positive_mentions"), "product_id")
    )


def total_reviews(reviews: DataFrame) -> DataFrame:
    """The default answer, COUNT(*) over all rows (processed or not)."""
    return reviews.agg(F.count(F.lit(1)).alias("count"))


# ---- routing --------------------------------------------------------------

# --- fixed values: question rules, first match wins ------------------------
# (template, all of these substrings, at least one of these substrings);
# "{product}" stands for the display name of the product the first template
# is about (a parameter, lower-cased).
ROUTES = [
    ("theme_by_sentiment", ["anc", "{product}"], []),
    ("complaints_by_product", ["battery life complaints", "compare"], []),
    ("one_star_reasons", ["1-star"], ["top", "reasons"]),
    ("praise_by_product", ["comfort", "better"], []),
]
DEFAULT_ROUTE = "total_reviews"
# --- end of fixed values ---------------------------------------------------


def routes(product_name: str) -> list[tuple[str, list[str], list[str]]]:
    p = product_name.lower()
    return [(n, [s.replace("{product}", p) for s in a], b) for n, a, b in ROUTES]


def route_expr(question: F.Column, product_name: str = "product 1") -> F.Column:
    q = F.lower(question)
    expr = None
    for name, all_of, any_of in routes(product_name):
        cond = F.lit(True)
        for s in all_of:
            cond = cond & q.contains(s)
        if any_of:
            alt = F.lit(False)
            for s in any_of:
                alt = alt | q.contains(s)
            cond = cond & alt
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_ROUTE))


def route_questions(questions: DataFrame, text_col: str = "text", product_name: str = "product 1") -> DataFrame:
    return questions.withColumn("template", route_expr(F.col(text_col), product_name))


def answer_lines(reviews: DataFrame, params: dict) -> DataFrame:
    """One grounded answer line per template (H20), all from one pass over the reviews.

    The reviews are added up per (product, theme list of its 1-star reviews):
    everything the five templates ask for is a sum over those few rows, and
    one row with an array of the five lines is made from them.
    """
    done = F.col("processed") == 1
    themes = F.when((F.col("rating") == 1) & done, F.col("themes"))

    def told(fragment: str, when: F.Column) -> F.Column:
        return F.coalesce(when & done & theme_fragment(fragment), F.lit(False))

    # told once per row: a projection of its own, so that no copy of it goes below the classification
    facts = reviews.select(
        "product_id", F.array_join(themes, ", ").alias("reason"), "rating",
        told(params["anc_fragment"], F.col("product_id") == params["product_id"]).alias("asked"),
        told(params["complaint_fragment"], F.col("sentiment") == "Negative").alias("complaint"),
        told(params["praise_fragment"], F.col("sentiment") == "Positive").alias("praise"),
    )
    sums = facts.groupBy("product_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in ("asked", "complaint", "praise")),
        F.sum(F.when(F.col("praise"), F.col("rating"))).cast("long").alias("praise_sum"), F.count(F.when(F.col("praise"), F.col("rating"))).alias("praise_rated"),
    )
    none = F.lit(None).cast("string")
    to = F.array(F.struct(F.lit(True).alias("whole"), "product_id", none.alias("reason")), F.struct(F.lit(False).alias("whole"), none.alias("product_id"), "reason"))
    sums = sums.select(*(c for c in sums.columns if c not in ("product_id", "reason")), F.explode_outer(to).alias("to"))
    sums = sums.groupBy("to.whole", "to.product_id", "to.reason").agg(*(F.sum(c).alias(c) for c in ("n", "asked", "complaint", "praise", "praise_sum", "praise_rated")))
    mean = F.round(F.col("praise_sum") / F.nullif("praise_rated", F.lit(0)), 1).cast("string")
    whole = F.col("whole")
    of_all = sums.agg(
        F.sum(F.when(whole, F.col("n"))).alias("n"), F.sum(F.when(whole, F.col("asked"))).alias("asked"),
        F.array_sort(F.collect_list(F.when(whole & (F.col("complaint") > 0), F.struct("product_id", "complaint")))).alias("complaints"),
        F.min(F.when(whole & (F.col("praise") > 0), F.struct(F.negative("praise").alias("less"), "product_id", mean.alias("mean")))).alias("leader"),
        F.slice(F.array_sort(F.collect_list(F.when(~whole & F.col("reason").isNotNull(), F.struct(F.negative("n").alias("less"), "reason")))), 1, 3).alias("top"),
    )

    def joined(items: str, text) -> F.Column:
        return F.coalesce(F.nullif(F.array_join(F.transform(items, text), "; "), F.lit("")), F.lit("none"))

    def answer(template: str, line: F.Column) -> F.Column:
        return F.struct(F.lit(template).alias("template"), line.alias("answer"))

    lines = F.array(
        answer("theme_by_sentiment", F.format_string("%d reviews of %s mention %s.", "asked", F.lit(params["product_id"]), F.lit(params["anc_fragment"]))),
        answer(
            "complaints_by_product",
            F.format_string(
                "Negative mentions of %s by product — %s.", F.lit(params["complaint_fragment"]),
                joined("complaints", lambda x: F.format_string("%s: %d", x["product_id"], x["complaint"])),
            ),
        ),
        answer("one_star_reasons", F.format_string("Top reasons behind 1-star reviews: %s.", joined("top", lambda x: x["reason"]))),
        answer(
            "praise_by_product",
            F.format_string("%s leads on %s with %d positive mentions (avg %s/5).", "leader.product_id", F.lit(params["praise_fragment"]), F.negative("leader.less"), "leader.mean"),
        ),
        answer(DEFAULT_ROUTE, F.format_string("%d reviews in total.", F.coalesce("n", F.lit(0).cast("long")))),
    )
    rows = of_all.select(F.inline(lines), F.col("leader").isNull().alias("no_leader"))
    return rows.filter(~((F.col("template") == "praise_by_product") & F.col("no_leader"))).drop("no_leader")
