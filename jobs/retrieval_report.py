"""Scores retrieval over a question set and compares the run with an earlier one.

Who tunes retrieval has a set of questions and judgements of documents, and wants to know after each change what it did, by kinds of
questions. This job ranks the corpus for every question by BM25, measures precision, recall, reciprocal rank, NDCG and hit rate at k
against the judged documents, and writes

    output/cases     partitioned by (run, segment): a row of metrics for each question
    output/summary   partitioned by run: means by segment and overall ("all"), with the change against a baseline run

Judgements are pooled: the relevant documents of a question are those judged good among its ``pool`` best. Segments are the lengths of
the questions: short (under 150 characters), medium (under 300), long. A question without any hit has a row of zeros, but recall 1 as
it has nothing to find. A metric that falls by more than ``tolerance`` against the baseline marks its segment as regressed.

A run overwrites its own partitions only, so it can be repeated; other runs stay.

    spark-submit jobs/retrieval_report.py --documents ... --questions ... --judgements ... --output ... --run 2024-06-01 --baseline 2024-05-01
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, say
from tessera.operators import metrics, retrieval

NAMES = ["precision", "recall", "mrr", "ndcg", "hit_rate"]
CASES = "case_id string, " + ", ".join(f"{m} double" for m in NAMES) + ", retrieved int, relevant int, run string, segment string"
SUMMARY = "segment string, cases long, " + ", ".join(f"{m} double, {m}_change double" for m in NAMES) + ", regressed boolean, run string"


def segment_of(question: Column) -> Column:
    n = F.length(question)
    return F.when(n < 150, "short").when(n < 300, "medium").otherwise("long")


def measure(questions: DataFrame, corpus: DataFrame, judged: DataFrame, k: int, pool: int) -> DataFrame:
    """A row of metrics for each of questions(query_id, question), over corpus(chunk_id, content) and judged(chunk_id, good)."""
    asked = questions.where("question is not null and query_id is not null").dropDuplicates(["query_id"])
    ranked = retrieval.lexical_search(asked, corpus, pool, all_terms=False).join(judged.where("good"), "chunk_id", "left")
    hits = F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id"), F.coalesce("good", F.lit(False)).alias("good"))))  # pool rows
    listed = ranked.groupBy("query_id").agg(hits.alias("hits"))
    every = asked.join(listed, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(listed.schema["hits"].dataType)))
    ids = lambda a: F.transform(a, lambda x: x["id"])
    good = ids(F.filter("hits", lambda x: x["good"]))
    cases = every.select(
        F.col("query_id").cast("string").alias("case_id"), segment_of(F.col("question")).alias("segment"), F.lit(True).alias("is_answerable"), good.alias("relevant_chunk_ids"),
        F.map_from_entries(F.transform("hits", lambda x: F.struct(x["id"], x["good"].cast("int")))).alias("relevance_grades"), ids("hits").alias("retrieved"),
    )
    scored = metrics.evaluate(cases.drop("retrieved"), cases.select("case_id", "retrieved", F.lit(False).alias("abstained")), k)
    sizes = cases.select("case_id", F.size("retrieved").alias("retrieved"), F.size("relevant_chunk_ids").alias("relevant"))
    return scored.select("case_id", "segment", *NAMES).join(sizes, "case_id")


def summarize(cases: DataFrame, before: DataFrame | None, tolerance: float) -> DataFrame:
    """Means by segment and overall, and their change against those before."""
    means = metrics.summarize(cases, NAMES).select(F.coalesce("segment", F.lit("all")).alias("segment"), F.col("n").alias("cases"), *NAMES)
    if before is None:
        return means.select("segment", "cases", *[c for m in NAMES for c in (F.col(m), F.lit(None).cast("double").alias(f"{m}_change"))], F.lit(False).alias("regressed"))
    joined = means.join(before.select("segment", *[F.col(m).alias(f"old_{m}") for m in NAMES]), "segment", "left")
    change = {m: F.col(m) - F.col(f"old_{m}") for m in NAMES}
    worse = F.greatest(*[F.coalesce(-c, F.lit(0.0)) for c in change.values()]) > tolerance
    return joined.select("segment", "cases", *[c for m in NAMES for c in (F.col(m), change[m].alias(f"{m}_change"))], worse.alias("regressed"))


def run(
    spark: SparkSession, documents: str, questions: str, judgements: str, output: str, run: str = "current", baseline: str = "none", format: str = "parquet",
    k: int = 5, pool: int = 20, tolerance: float = 0.01,
) -> dict[str, Any]:
    """Writes the run's cases and summary; baseline "none" compares with nothing. Returns how many cases and regressed segments there are."""
    say("reads", documents=documents, questions=questions, judgements=judgements)
    read = spark.read.format(format)
    asked = read.load(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    corpus = read.load(documents).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    judged = read.load(judgements).groupBy(F.col("doc_id").alias("chunk_id")).agg((F.max("quality") == 1).alias("good"))

    rows = measure(asked, corpus, judged, k, pool).withColumn("run", F.lit(run))
    # a row for each question is little: a few files for each segment
    rows.repartition("segment").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "segment").parquet(f"{output}/cases")
    mine = cases(spark, output).where(F.col("run") == run)
    before = None if baseline == "none" else summary(spark, output).where(F.col("run") == baseline)
    if before is not None and before.isEmpty():
        raise ValueError(f"no run {baseline} under {output}")
    told = summarize(mine, before, tolerance).withColumn("run", F.lit(run))
    told.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{output}/summary")  # four rows
    n = mine.count()
    worse = [r["segment"] for r in summary(spark, output).where((F.col("run") == run) & F.col("regressed")).select("segment").collect()]  # four rows at most
    say("wrote", output=output, run=run, cases=n, regressed=worse)
    return {"cases": n, "regressed": sorted(worse)}


def cases(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CASES).parquet(f"{output}/cases")


def summary(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(f"{output}/summary")


if __name__ == "__main__":
    main(run, __file__, __doc__)
