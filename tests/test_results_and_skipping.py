"""Searches that fail, branches at once, row groups that aren't read."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessera.operators import retrieval, store


def test_failed_searches_find_nothing(spark):
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, question string")
    corpus = spark.createDataFrame([("a", "alpha beta", None, None), ("b", None, "u", {"k": "v"})], "chunk_id string, content string, source_uri string, metadata map<string,string>")
    search = lambda: retrieval.as_results(retrieval.lexical_search(queries, corpus, 3), corpus, "lexical")
    found = retrieval.or_empty(search, queries)
    assert {(r.query_id, r.chunk_id, r.source_uri, r.section_path, tuple(r.metadata), r.retriever) for r in found.collect()} == {(1, "a", "", "", (), "lexical"), (2, "a", "", "", (), "lexical")}
    late = retrieval.or_empty(lambda: search().withColumn("content", F.raise_error(F.lit("broken"))), queries)
    early = retrieval.or_empty(lambda: retrieval.lexical_search(queries, corpus.drop("content"), 3), queries)
    for none in (late, early):
        assert none.count() == 0 and none.unionByName(found).count() == 2


def test_branches_run_at_once(spark):
    spans = []

    def branch(n):
        def run():
            began = time.monotonic()
            wait = F.udf(lambda x: time.sleep(1.5) or x, "long")
            rows = spark.range(1).select(wait("id").alias("id")).collect()
            spans.append((began, time.monotonic(), spark.sparkContext.getLocalProperty("of.caller")))
            return spark.createDataFrame([(n, len(rows))], "n int, rows int")

        return run

    spark.sparkContext.setLocalProperty("of.caller", "yes")
    got = retrieval.at_once(spark, branch(1), branch(2), branch(3))
    spark.sparkContext.setLocalProperty("of.caller", None)
    assert [g.first().n for g in got] == [1, 2, 3]
    assert max(a for a, _, _ in spans) < min(b for _, b, _ in spans) and {p for _, _, p in spans} == {"yes"}


def scanned(df) -> int:
    """Rows that the scans of a plan have put out."""
    rows = df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if "Scan" in p.getClass().getSimpleName():
            total += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert rows
    return total


def test_a_source_is_read_without_the_others(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    n = 4000
    rows = spark.range(n).select(F.format_string("doc-%05d.md", F.col("id") % 400).alias("source_uri"), (F.col("id") / 400).cast("int").alias("position"), F.format_string("chunk %d " , "id").alias("content"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows, but a file for each range all the same
    try:
        s.write(store.chunk_rows(rows, tenant_id="t", chapter="c", embed_model="m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = s.read("t", "c", sources=["doc-00123.md"])
    assert one.count() == 10 and scanned(one) < n / 2
    assert s.read("t", sources=["doc-00123.md", "doc-00007.md"]).count() == 20 and s.read("t", sources=[]).count() == 0
    none = s.read("t", "c", sources=["doc-00123.mdx"])  # within the range of a file, but not in its filter
    assert none.count() == 0
