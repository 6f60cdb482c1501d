"""The stored vector index: recall and reading against exact search, tenants, odd vectors, reuse."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, retrieval


def vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("tenant_id"))
    return rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"), "tenant_id"), rows


def hits(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ann')}/index"
    queries, rows = vectors(spark, "sf0.1")
    ann.build_index(rows, path)
    return queries, rows, path


def test_recall_and_what_is_read(spark, built):
    queries, rows, path = built
    index = ann.VectorIndex.open(spark, path)  # from the folder alone
    exact = hits(retrieval.dense_search(queries, rows, 5))
    found = index.search(queries, 5)
    assert len(hits(found) & exact) >= 0.9 * len(exact)
    n, asked = rows.count(), queries.count()
    assert len(index.centers) == round(n**0.5)
    candidates = index.candidates(queries, 50).groupBy("query_id").count().collect()
    assert all(r["count"] == 50 for r in candidates) and 50 <= n / 10  # vectors that are compared with a question
    # bytes: a code for the rows of the probed cells, a vector for each candidate, against all vectors
    probed = round(ann.PROBED * len(index.centers)) / len(index.centers)
    assert (probed * n * len(index.books) + 50 * 4 * index.dims) < 0.1 * n * 4 * index.dims
    again = {(r.query_id, r.rank, r.chunk_id, r.score) for r in index.search(queries.where("query_id % 40 = 0"), 5).collect()}
    assert again == {(r.query_id, r.rank, r.chunk_id, r.score) for r in found.where("query_id % 40 = 0").collect()} and len(again) == asked * 5 / 2
    true = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense_search(queries, rows, 100).collect()}
    assert all(true[r.query_id, r.chunk_id] == pytest.approx(r.score, abs=2e-6) for r in found.collect() if (r.query_id, r.chunk_id) in true)


def test_all_cells_and_rows_are_exact(spark, built):
    queries, rows, path = built
    some = queries.where("query_id % 200 = 0")
    assert hits(ann.VectorIndex.open(spark, path).search(some, 5, rerank=2000, probed=1.0)) == hits(retrieval.dense_search(some, rows, 5))


def test_tenants_and_floor(spark, built):
    queries, rows, path = built
    some, index = queries.where("query_id % 100 = 0"), ann.VectorIndex.open(spark, path)
    got = hits(index.search(some, 5, tenant=True, probed=1.0, rerank=400))
    assert got == hits(retrieval.dense_search(some, rows, 5, tenant=True))
    floor = index.search(some, 5, min_score=0.4).collect()
    assert floor and all(r.score >= 0.4 for r in floor)


def test_only_folders_of_probed_cells_are_read(spark, built):
    queries, _, path = built
    index = ann.VectorIndex.open(spark, path)
    found = index.candidates(queries.limit(1), 10, probed=0.05)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(grp" in plan or "PartitionFilters: [grp" in plan
    assert found.select("cell").distinct().count() <= round(0.05 * len(index.centers))


def test_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"c{i}", r.normal(size=6).tolist()) for i in range(40)] + [("zero", [0.0] * 6), ("none", None), ("same", [1.0] * 6), ("same", [1.0] * 6)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    index = ann.build_index(corpus, f"file://{tmp_path}/a")
    assert (index.vectors, index.dims, len(index.books)) == (43, 6, 3)
    asked = spark.createDataFrame([(1, [1.0] * 6), (2, [0.0] * 6), (3, None)], "query_id int, qvec array<float>")
    got = index.search(asked, 2, probed=1.0, rerank=43).collect()
    assert [r.chunk_id for r in got if r.query_id == 1] == ["same", "same"] and sum(r.query_id == 2 and r.score == 0 for r in got) == 2 and len(got) == 4
    assert index.search(asked.limit(0), 2).count() == 0
    one = ann.build_index(corpus.limit(1), f"file://{tmp_path}/b")
    assert [r.chunk_id for r in one.search(asked.where("query_id = 1"), 5).collect()] == ["c0"]
    for bad, text in ((corpus.where("chunk_id = 'none'"), "no vectors"), (spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], corpus.schema), "dimensions")):
        with pytest.raises(ValueError, match=text):
            ann.build_index(bad, f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="don't divide"):
        ann.build_index(corpus, f"file://{tmp_path}/d", parts=4)
    with pytest.raises(ValueError, match="no tenants"):
        index.candidates(asked, 5, tenant=True)
