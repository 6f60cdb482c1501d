"""Small calls that never raise: a table, an index of texts, a search, counts. For notebooks and smoke checks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, models, retrieval, store

log = logging.getLogger(__name__)


def _safe(f: Callable, otherwise):
    try:
        return f()
    except Exception as e:  # noqa: BLE001
        log.warning("failed: %s", e)
        return otherwise


def table_healthy(spark: SparkSession, path: str) -> bool:
    return _safe(lambda: store.ChunkStore(spark, path).version() >= 0, False)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, read in parallel where options name a partition column and its bounds."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def embed_and_store(target: store.ChunkStore, texts: DataFrame, *, tenant_id: str, chapter: str, embed: Callable[[Column], Column] = models.hashed_embedding, size: int = 500) -> int:
    """texts(source_uri, text) in pieces without overlap; 0 if it fails."""

    def run() -> int:
        chunks = chunking.fixed_size(texts, size, 0, id_col="source_uri").withColumn("embedding", embed(F.col("content")))
        return target.write(store.chunk_rows(chunks, tenant_id=tenant_id, chapter=chapter, embed_model="lab"))

    return _safe(run, 0)


def semantic_search(target: store.ChunkStore, question: str, *, tenant_id: str, k: int = 5, embed: Callable[[Column], Column] = models.hashed_embedding) -> list:
    """Rows best first; an empty list if it fails."""

    def run() -> list:
        rows = target.read(tenant_id).withColumn("chunk_id", F.col("content_hash"))
        asked = target.spark.createDataFrame([(0, question)], "query_id long, question string").withColumn("qvec", embed(F.col("question")))
        return retrieval.dense_search(asked, rows, k).join(rows.select("chunk_id", "content", "source_uri"), "chunk_id").orderBy("rank").collect()  # k rows

    return _safe(run, [])


def keyword_search(target: store.ChunkStore, question: str, *, tenant_id: str, k: int = 5) -> list:
    def run() -> list:
        rows = target.read(tenant_id).withColumn("chunk_id", F.col("content_hash"))
        asked = target.spark.createDataFrame([(0, question)], "query_id long, question string")
        return retrieval.lexical_search(asked, rows, k).join(rows.select("chunk_id", "content", "source_uri"), "chunk_id").orderBy("rank").collect()  # k rows

    return _safe(run, [])


def stored_count(target: store.ChunkStore, *, tenant_id: str, chapter: str | None = None) -> int:
    return _safe(lambda: target.count(tenant_id, chapter), 0)


def clear_index(target: store.ChunkStore, *, tenant_id: str, chapter: str) -> bool:
    return _safe(lambda: target.delete(tenant_id, chapter) >= 0, False)
