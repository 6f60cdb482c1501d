"""The jobs as queries: each runs twice into one new folder and returns what stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import chunk_feed, retrieval_report
from tessera.operators.chunking import SEPARATORS
from tessera.plans.registry import _METRICS, _TEXTS, _split_sql
from tessera.scratch import scratch_path


def job1_chunk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new. The table can be a file or a folder; a stream takes a single file by a pattern."""
    folder = scratch_path(spark, "job1")
    for _ in range(2):
        chunk_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/checkpoint")
    rows = chunk_feed.current(spark, f"{folder}/out")
    return rows.select("doc_id", "position", "chunk_id", "n_chars", "n_tokens", F.sha2("content", 256).alias("content_sha256"), F.col("part").alias("lang"))


JOB1_SQL = f"""
WITH RECURSIVE {_split_sql('k', _TEXTS, 600, 72, SEPARATORS)}
SELECT key AS doc_id, CAST(position AS BIGINT) AS position, substring(sha256(key || '|' || position || '|' || content), 1, 24) AS chunk_id, CAST(length(content) AS BIGINT) AS n_chars,
  CAST(greatest(1, length(content) // 4) AS BIGINT) AS n_tokens, sha256(content) AS content_sha256, lang
FROM k JOIN documents ON doc_id = key
"""


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run overwrites the first one's partitions."""
    folder = scratch_path(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "labels")), folder, run="nightly")
    rows = retrieval_report.cases(spark, folder).select("case_id", "segment", *retrieval_report.NAMES)
    every = retrieval_report.summary(spark, folder).select(F.concat(F.lit("mean of "), "segment").alias("case_id"), "segment", *retrieval_report.NAMES)
    return rows.unionByName(every).select("case_id", "segment", *[F.round(m, 5).alias(m) for m in retrieval_report.NAMES])


_NAMED = ", ".join(f'"{m}"' for m in retrieval_report.NAMES)
JOB2_SQL = f"""
{_METRICS.replace("coalesce(quality, 0) * (1 + rank % 2) AS grade", "coalesce(quality, 0) AS grade").replace("min(rank) FILTER (quality = 1 AND rank <= 10)", "min(rank) FILTER (quality = 1)")},
o AS (SELECT CAST(item_id AS VARCHAR) AS case_id, CASE WHEN length(text) < 150 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END AS segment,
  coalesce("precision", 0.0) AS "precision", coalesce(recall, 1.0) AS recall, coalesce(mrr, 0.0) AS mrr, coalesce(ndcg, 0.0) AS ndcg, coalesce(hit_rate, 0.0) AS hit_rate FROM benchmark LEFT JOIN e ON source = item_id WHERE text IS NOT NULL),
u AS (SELECT case_id, segment, {_NAMED} FROM o UNION ALL
  SELECT 'mean of ' || coalesce(segment, 'all'), coalesce(segment, 'all'), {", ".join(f'avg("{m}")' for m in retrieval_report.NAMES)} FROM o GROUP BY GROUPING SETS ((), (segment)))
SELECT case_id, segment, {", ".join(f'round("{m}", 5) AS "{m}"' for m in retrieval_report.NAMES)} FROM u
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_chunk_feed": job1_chunk_feed, "job2_retrieval_report": job2_retrieval_report}
ORACLE_SQL: dict[str, str] = {"job1_chunk_feed": JOB1_SQL, "job2_retrieval_report": JOB2_SQL}
