"""Score scaling, content hashes and capacity arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_scale(results: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Best score of a group 1; groups whose best is not above 0 stay."""
    best = F.max(score).over(Window.partitionBy(by))
    return results.withColumn(score, F.when(best > 0, F.col(score) / best).otherwise(F.col(score)))


def min_max_scale(results: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores of a group to 0..1; all 1 if they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return results.withColumn(score, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def rescore(results: DataFrame, score: Column, retriever: Column | None = None) -> DataFrame:
    out = results.withColumn("score", score)
    return out if retriever is None else out.withColumn("retriever", retriever)


def content_hash(source_uri: Column | str, position: Column | str, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", source_uri, F.col(position).cast("string") if isinstance(position, str) else position.cast("string"), text), 256)


def stable_id(source_uri: Column | str, position: Column | str, text: Column | str) -> Column:
    return F.substring(content_hash(source_uri, position, text), 1, 24)


def estimate_capacity(
    documents: Column, pages_per_doc: int = 15, words_per_page: int = 500, chunk_words: int = 300, overlap: float = 0.12, dimensions: int = 768
) -> dict[str, Column]:
    """Chunks and gigabytes for a number of documents; halves are rounded to even."""
    chunks = documents.cast("double") * (pages_per_doc * words_per_page * (1 + overlap) / chunk_words)
    raw = chunks * dimensions * 4 / 1e9
    text = chunks * 2000 / 1e9
    return {
        "chunks": F.bround(chunks, 0).cast("long"), "raw_vector_gb": F.bround(raw, 1), "with_hnsw_gb": F.bround(raw * 2.6, 1),
        "text_metadata_gb": F.bround(text, 1), "total_gb": F.bround(raw * 2.6 + text, 1),
    }


def estimate_load(users: Column, queries_per_user: int = 8, peak_factor: float = 5.0, working_hours: int = 8) -> dict[str, Column]:
    daily = users.cast("long") * queries_per_user
    average = daily / (working_hours * 3600)
    return {"queries_per_day": daily, "average_qps": F.bround(average, 2), "peak_qps": F.bround(average * peak_factor, 2)}
