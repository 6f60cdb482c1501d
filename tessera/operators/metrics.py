"""Retrieval and generation metrics, per case and by segment. Null is 'the judge gave no answer', never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.scratch import materialize

METRICS = ["precision", "recall", "mrr", "ndcg", "hit_rate", "faithfulness", "answer_relevance", "correct_abstention"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def precision_at_k(retrieved: Column | str, relevant: Column | str, k: int) -> Column:
    r = _col(retrieved)
    return F.when(F.lit(k <= 0) | (F.size(r) == 0), 0.0).otherwise(F.size(F.array_intersect(F.slice(r, 1, max(k, 1)), _col(relevant))) / F.least(F.lit(k), F.size(r)))


def recall_at_k(retrieved: Column | str, relevant: Column | str, k: int) -> Column:
    rel = F.array_distinct(_col(relevant))
    return F.when(F.size(rel) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(_col(retrieved), 1, k), rel)) / F.size(rel))


def reciprocal_rank(retrieved: Column | str, relevant: Column | str) -> Column:
    rel = _col(relevant)
    places = F.filter(F.transform(_col(retrieved), lambda x, i: F.when(F.array_contains(rel, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) == 0, 0.0).otherwise(1 / F.array_min(places))


def ndcg_at_k(retrieved: Column | str, grades: Column | str, k: int) -> Column:
    g = _col(grades)
    gain = lambda grade, i: (F.pow(F.lit(2.0), grade.cast("double")) - 1) / F.log2((i + 2).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    real = total(F.transform(F.slice(_col(retrieved), 1, k), lambda x, i: gain(F.coalesce(g[x], F.lit(0)), i)))
    best = total(F.transform(F.slice(F.sort_array(F.map_values(g), asc=False), 1, k), gain))
    return F.when(F.coalesce(best, F.lit(0.0)) == 0, 0.0).otherwise(real / best)


def hit_rate_at_k(retrieved: Column | str, relevant: Column | str, k: int) -> Column:
    return F.arrays_overlap(F.slice(_col(retrieved), 1, k), _col(relevant)).cast("double")


def faithfulness(verdicts: DataFrame, by: str = "case_id") -> DataFrame:
    """(by, faithfulness): supported among readable verdicts(by, verdict); null if there are none."""
    return verdicts.groupBy(by).agg((F.count_if(F.col("verdict") == "SUPPORTED") / F.nullif(F.count("verdict"), F.lit(0))).alias("faithfulness"))


def context_relevance(votes: Column | str) -> Column:
    """The mean of an array of 1, 0 and null votes; 0 without contexts, null without readable votes."""
    v = _col(votes)
    real = F.filter(v, lambda x: x.isNotNull())
    return F.when(F.size(v) == 0, 0.0).when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda s, x: s + x) / F.size(real))


def judge_faithfulness(answers: DataFrame, judge, *, by: str = "case_id", context_chars: int = 6000) -> DataFrame:
    """(by, faithfulness, claims, supported, unsupported, contradicted, reason) of answers(by, answer, context).

    A judge lists an answer's claims and then gives a verdict on each against the context. Without a verdict that can be read the score
    is null and reason tells why. Replies are written to the shared folder, so each prompt is put once.
    """
    listed = answers.select(by, "context", tx.json_array(judge(tx.fill_template("claims", answer="answer"))).alias("raw"))
    listed = materialize(listed.withColumn("claims", F.filter("raw", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")), "claims")
    asked = listed.select(by, "context", F.posexplode("claims").alias("i", "claim"))
    verdict = tx.match_verdict(judge(tx.fill_template("verdict", context=tx.truncate("context", context_chars), claim="claim")))
    said = materialize(asked.select(by, verdict.alias("verdict")), "verdicts")
    counts = said.groupBy(by).agg(F.count("verdict").alias("n"), *[F.count_if(F.col("verdict") == v.upper()).alias(v) for v in ("supported", "unsupported", "contradicted")])
    rows = listed.select(by, "raw", F.size("claims").alias("claims")).join(counts, by, "left").na.fill(0, ["n", "supported", "unsupported", "contradicted"])
    none = F.when(F.col("raw").isNull() | (F.size("raw") == 0), "claim_extraction_failed").when(F.col("claims") == 0, "no_usable_claims").when(F.col("n") == 0, "all_verdicts_unparseable")
    score = F.when(F.col("n") > 0, F.col("supported") / F.col("n"))
    return rows.select(by, score.alias("faithfulness"), F.greatest("claims", F.lit(0)).alias("claims"), "supported", "unsupported", "contradicted", none.alias("reason"))


def judge_answer_relevance(answers: DataFrame, judge, *, by: str = "case_id") -> DataFrame:
    """(by, answer_relevance) of answers(by, question, answer): 1 or 0 by a judge's YES or NO, null if it said neither."""
    return answers.select(by, tx.yes_no(judge(tx.fill_template("relevant", question="question", answer="answer"))).alias("answer_relevance"))


def evaluate(cases: DataFrame, responses: DataFrame, k: int = 5) -> DataFrame:
    """A row of metrics per case: cases joined with responses(case_id, retrieved, abstained[, faithfulness, answer_relevance]).

    Answering what can't be answered, or not answering what can, is 0 in correct_abstention; answers have it null.
    Judged metrics count for answered cases only.
    """
    rows = cases.join(responses, "case_id", "left")
    retrieved = F.coalesce("retrieved", F.array().cast("array<string>"))
    judged = lambda c: F.when(F.col("is_answerable") & ~F.col("abstained"), F.col(c)) if c in responses.columns else F.lit(None).cast("double")
    return rows.select(
        "case_id", "segment", precision_at_k(retrieved, "relevant_chunk_ids", k).alias("precision"), recall_at_k(retrieved, "relevant_chunk_ids", k).alias("recall"),
        reciprocal_rank(retrieved, "relevant_chunk_ids").alias("mrr"), ndcg_at_k(retrieved, "relevance_grades", k).alias("ndcg"),
        hit_rate_at_k(retrieved, "relevant_chunk_ids", k).alias("hit_rate"), judged("faithfulness").alias("faithfulness"), judged("answer_relevance").alias("answer_relevance"),
        F.when(~F.col("is_answerable"), F.col("abstained").cast("double")).when(F.col("abstained"), 0.0).alias("correct_abstention"),
    )


def summarize(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Means without nulls, counts of values and rows, overall (segment null) and by segment, in one pass."""
    names = METRICS if metrics is None else metrics
    aggregates = [F.avg(m).alias(m) for m in names] + [F.count(m).alias(f"n_{m}") for m in names] + [F.count("*").alias("n")]
    return rows.groupingSets([[], ["segment"]], "segment").agg(*aggregates, F.grouping_id().alias("level"))
