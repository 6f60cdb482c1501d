"""What kind of question it is, whether it stands alone, and how to search for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Markers of questions that depend on earlier turns.
DEPENDENT_MARKERS = ["it", "that", "this", "those", "these", "they", "them", "the second", "the first", "the former", "the latter", "he", "she", "there", "instead", "also", "same", "one"]

# Rules by kind, in order of precedence.
RULES = [
    ("relational", ["who reports to", "connected to", "relationship between", "related to", "linked to", "supplier of", "owns", "acquired"]),
    ("comparative", ["versus", " vs ", "difference between", "compare", "better than", "instead of"]),
    ("aggregate", ["how many", "list all", "count", "rank", "top ", "summarize", "across all"]),
    ("factual", ["when did", "what date", "what is the", "who is the", "where is"]),
]
KINDS = ["factual", "conceptual", "comparative", "relational", "aggregate"]

# Kind, transform, k, rerank.
POLICY = [("factual", None, 5, False), ("conceptual", "hyde", 12, True), ("comparative", "multi_query", 20, True), ("relational", "entities", 15, True), ("aggregate", "multi_query", 30, True)]
# The branch of each kind.
ROUTES = {"factual": "vector", "conceptual": "vector", "relational": "graph", "comparative": "hybrid", "aggregate": "hybrid"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rule_kind(question: Column | str) -> Column:
    """The first kind one of whose markers is a substring of the padded lower-case question; null if none."""
    said, out = F.concat(F.lit(" "), F.lower(_col(question)), F.lit(" ")), F.lit(None).cast("string")
    for kind, markers in reversed(RULES):
        hit = F.lit(False)
        for m in markers:
            hit = hit | said.contains(m)
        out = F.when(hit, kind).otherwise(out)
    return out


def classify(question: Column | str, reply: Column | str | None = None) -> Column:
    """Rules, then the first kind named in a model's reply, then conceptual."""
    out = F.lit("conceptual")
    if reply is not None:
        for kind in reversed(KINDS):
            out = F.when(F.lower(_col(reply)).contains(kind), kind).otherwise(out)
    return F.coalesce(rule_kind(question), out)


def is_dependent(question: Column | str) -> Column:
    """A marker as whole words, or six words at most."""
    q = F.trim(F.regexp_replace(F.lower(_col(question)), r"(?U)[^\w\s]", " "))
    padded = F.concat(F.lit(" "), F.regexp_replace(q, r"(?U)\s+", " "), F.lit(" "))
    hit = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")) <= 6
    for m in DEPENDENT_MARKERS:
        hit = hit | padded.contains(f" {m} ")
    return hit


def guarded_rewrite(question: Column | str, rewrite: Column | str) -> Column:
    """The rewrite, unless it is blank or far longer than the question."""
    q, r = _col(question), F.trim(F.coalesce(_col(rewrite), F.lit("")))
    return F.when((r == "") | (F.length(r) > 4 * F.length(q) + 80), q).otherwise(r)


def last_turns(history: Column | str, n: int = 4) -> Column:
    """The last n of array<struct<role,content>>, a line each."""
    h = _col(history)
    return F.array_join(F.transform(F.slice(h, F.greatest(F.size(h) - n + 1, F.lit(1)), F.lit(n)), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def condense(questions: DataFrame, model=None, question: str = "question", history: str = "history") -> DataFrame:
    """Adds condensed: dependent questions with a history are rewritten, others stay without a model call."""
    needed = is_dependent(question) & (F.size(F.coalesce(F.col(history), F.array().cast(questions.schema[history].dataType))) > 0)
    if model is None:
        return questions.withColumn("condensed", F.col(question))
    asked = questions.where(needed).withColumn("condensed", guarded_rewrite(question, model(tx.fill_template("condense", history=last_turns(history), question=question))))
    return asked.unionByName(questions.where(~F.coalesce(needed, F.lit(False))).withColumn("condensed", F.col(question)))


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "kind string, transform string, k int, rerank boolean")


def hyde(queries: DataFrame, model) -> DataFrame:
    """queries with question replaced by itself and a hypothetical answer, which a model writes; a failed or blank reply leaves it."""
    reply = F.trim(F.coalesce(model(tx.fill_template("hypothetical", question="question")), F.lit("")))
    said = queries.withColumn("__reply", reply)
    return said.withColumn("question", F.when(F.col("__reply") == "", F.col("question")).otherwise(F.concat_ws("\n\n", "question", "__reply"))).drop("__reply")


def hyde_search(queries: DataFrame, search, model, k: int = 5) -> DataFrame:
    """search(queries, k) with hypothetical answers beside the questions."""
    return search(hyde(queries, model), k)


WIDENED = "weak context, widening search"


def adaptive_search(queries: DataFrame, search, *, model=None, judge=None, replies: str | None = None, floor: float = 0.5, attempts: int = 2) -> DataFrame:
    """Rows of search(queries, k) by each question's policy, with kind, attempt and corrections.

    Where the policy says so, a model's hypothetical answer goes along with the question, and judge reranks the rows (which need
    a content then). Questions without a row at the floor try again at twice the rows, and keep all they have on the last
    attempt. replies: a column of a model's classification, asked where no rule fires.
    """
    from tessera.operators.rerank import rerank

    table = F.broadcast(policies(queries.sparkSession))
    left = queries.withColumn("kind", classify("question", replies)).join(table, "kind")
    if model is not None:
        other = left.where(~F.col("transform").eqNullSafe(F.lit("hyde"))).withColumn("asked", F.col("question"))
        hypothetical = hyde(left.where("transform = 'hyde'").withColumn("plain", F.col("question")), model)
        left = other.unionByName(hypothetical.withColumnRenamed("question", "asked").withColumnRenamed("plain", "question"))
    else:
        left = left.withColumn("asked", F.col("question"))
    most, out = max(p[2] for p in POLICY), None
    for attempt in range(attempts):
        found = search(left.withColumn("question", F.col("asked")).select("query_id", "question", *[c for c in ("qvec", "tenant_id") if c in left.columns]), most * 2**attempt)
        within = found.join(left.select("query_id", "kind", "k", F.col("rerank").alias("judged")), "query_id").where(F.col("rank") <= F.col("k") * 2**attempt).drop("k")
        if judge is not None:
            plain = within.where(~F.col("judged"))
            within = plain.unionByName(rerank(within.where("judged"), left.select("query_id", "question"), judge).select(*within.columns))
        told = F.array(*[F.lit(f"attempt {i + 1}: {WIDENED}") for i in range(attempt)]).cast("array<string>")
        within = within.drop("judged").withColumn("attempt", F.lit(attempt + 1)).withColumn("corrections", told)
        strong = within.where(F.col("score") >= floor)
        done = strong.select("query_id").distinct()
        rows = within.join(done, "query_id", "left_anti").unionByName(strong) if attempt == attempts - 1 else strong
        out = rows if out is None else out.unionByName(rows)
        left = left.join(done, "query_id", "left_anti")
    return out
