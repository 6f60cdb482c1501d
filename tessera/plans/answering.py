"""End-to-end plans: ingestion, gated answering, four retrieval modes, evaluation of a golden set."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, context, graph, metrics, retrieval, routing, store
from tessera.scratch import materialize

Model = Callable[[Column], Column]
ABSTAINED = "INSUFFICIENT"
MODES = ("basic", "advanced", "graphrag", "hybrid")


def ingest(documents: DataFrame, target: store.ChunkStore, embed: Model, *, tenant_id: str, chapter: str, embed_model: str, size: int = 600, overlap: int = 72) -> int:
    """documents(path, text, metadata) through cleaning, splitting, embedding and the store's merge, as one plan."""
    source = F.regexp_extract("path", r"([^/]+)$", 1)
    clean = documents.select(source.alias("source_uri"), F.col("text"))
    chunks = chunking.recursive(clean, size, overlap, id_col="source_uri", text_col="text").withColumn("embedding", embed(F.col("content")))
    chunks = chunks.withColumn("metadata", F.create_map(F.lit("source"), F.col("source_uri"), F.lit("chunk"), F.col("position").cast("string")))
    return target.write(store.chunk_rows(chunks, tenant_id=tenant_id, chapter=chapter, embed_model=embed_model))


def build_graph(documents: DataFrame, model: Model, *, tenant_id: str, chapter: str, size: int = 3000, overlap: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of documents(source_uri, text)."""
    windows = chunking.covering_windows(documents, size, overlap, id_col="source_uri", text_col="text")
    replies = windows.select("source_uri", "position", model(tx.fill_template("extract", text="content")).alias("reply"))
    entities, links, rejects = graph.extract(replies)
    key = [F.lit(tenant_id).alias("tenant_id"), F.lit(chapter).alias("chapter")]
    order = (F.col("position") * 100_000 + F.col("seq")).alias("seq")
    nodes = graph.merge_nodes(entities.select(*key, tx.canonicalize("name").alias("canonical_name"), "name", "entity_type", "confidence", order))
    rows = links.select(*key, tx.canonicalize("source").alias("src"), tx.canonicalize("target").alias("dst"), "rel_type", "source_uri", "confidence", "evidence", F.col("source_uri").alias("chunk_id"), order)
    return nodes, graph.merge_edges(rows, nodes), rejects


def ingest_both(documents: DataFrame, target: store.ChunkStore, embed: Model, model: Model, *, tenant_id: str, chapter: str, embed_model: str) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """documents(path, text) into the store and the graph: (chunks written, nodes, edges, rejects); the documents are read once."""
    held = materialize(documents, "documents")
    written = ingest(held, target, embed, tenant_id=tenant_id, chapter=chapter, embed_model=embed_model)
    named = held.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_uri"), "text")
    return written, *build_graph(named, model, tenant_id=tenant_id, chapter=chapter)


def timed(steps: dict[str, Callable[[DataFrame], DataFrame]], first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, (stage, ms)): each step works on what the one before has written to the shared folder, so its time is its own."""
    took, rows = [], first
    for name, step in steps.items():
        began = time.perf_counter()
        rows = materialize(step(rows), name)
        took.append((name, (time.perf_counter() - began) * 1000))
    return rows, first.sparkSession.createDataFrame(took, "stage string, ms double")


def answer(queries: DataFrame, results: DataFrame, model: Model, *, min_score: float = 0.35, budget: int = 2400, regenerations: int = 1) -> DataFrame:
    """(query_id, answer, abstained, reason, coverage, passed) for each question.

    First gate: rows at min_score, else no model call. Second: the model says that it can't. Third: citations; a failed
    answer is made once more, and only failed ones are. A question whose model call fails is abstained from, for the reason
    "error". Answers are written to the shared folder before they are split, so each call is made once.
    """
    asked = queries.select("query_id", "question")
    good = results.where(F.col("score") >= min_score)
    built = context.build_context(good, budget).select("query_id", "context", F.size("admitted").alias("n_admitted"))
    known = materialize(asked.join(built, "query_id", "left"), "contexts")

    def speak(rows: DataFrame) -> DataFrame:
        said = rows.withColumn("answer", model(tx.fill_template("answer", context="context", question="question")))
        return context.validate_citations(materialize(said, "answers"))

    made = speak(known.where("context IS NOT NULL"))
    for _ in range(regenerations):
        fine = F.coalesce(F.col("passed") | (F.col("answer") == ABSTAINED), F.lit(False))
        made = made.where(fine).unionByName(speak(made.where(~fine).select(*known.columns)))
    failed = F.col("answer").isNull()
    abstained = failed | (F.col("answer") == ABSTAINED)
    spoken = made.select(
        "query_id", F.coalesce("answer", F.lit(ABSTAINED)).alias("answer"), abstained.alias("abstained"), F.when(failed, "error").when(abstained, "model").alias("reason"),
        F.when(failed, 0.0).otherwise(F.col("coverage")).alias("coverage"), F.when(failed, False).otherwise(F.col("passed")).alias("passed"),
    )
    silent = known.where("context IS NULL").select(
        "query_id", F.lit(ABSTAINED).alias("answer"), F.lit(True).alias("abstained"), F.lit("evidence").alias("reason"), F.lit(0.0).alias("coverage"), F.lit(False).alias("passed")
    )
    return spoken.unionByName(silent)


def retrieve(mode: str, queries: DataFrame, corpus: DataFrame, *, graph_results: DataFrame | None = None, judge: Model | None = None, k: int = 5) -> DataFrame:
    """Results with contents by one of MODES; other names raise ValueError."""
    from tessera.operators.rerank import rerank

    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    contents = corpus.select("chunk_id", "content", "source_uri")

    def full(found: DataFrame, name: str) -> DataFrame:
        return found.select("query_id", "chunk_id", "score", "rank").join(contents, "chunk_id").withColumn("retriever", F.lit(name))

    if mode == "basic":
        return full(retrieval.dense_search(queries, corpus, k), "dense")
    if mode == "advanced":
        found = full(retrieval.hybrid_search(queries, corpus, 4 * k), "hybrid")
        return rerank(found, queries, judge, keep=k) if judge else found.where(F.col("rank") <= k)
    triples = graph_results.withColumn("rank", F.col("position").cast("int")) if graph_results is not None else None
    columns = ["query_id", "chunk_id", "content", "score", "source_uri", "retriever", "rank"]
    if mode == "graphrag":
        if triples is None:
            raise ValueError("graphrag needs graph_results")
        return triples.where(F.col("rank") <= k).select(*columns)
    pooled = full(retrieval.hybrid_search(queries, corpus, 4 * k), "hybrid").select(*columns)
    return pooled if triples is None else pooled.unionByName(triples.select(*columns))


def compare(strategies: dict[str, DataFrame], clock: bool = False) -> DataFrame:
    """Rows and best score per strategy and question; with clock each strategy is run by itself and its latency_ms is added."""
    out = None
    for name, found in strategies.items():
        rows, ms = found, None
        if clock:
            rows, times = timed({name: lambda d: d}, found)
            ms = times.first()["ms"]
        rows = rows.select(F.lit(name).alias("strategy"), "query_id", "score", F.lit(ms).cast("double").alias("latency_ms"))
        out = rows if out is None else out.unionByName(rows)
    keys = ["strategy", "query_id", *(["latency_ms"] if clock else [])]
    return out.groupBy(*keys).agg(F.count("*").alias("results"), F.max("score").alias("top_score"))


def evaluate(cases: DataFrame, results: DataFrame, answers: DataFrame, k: int = 5, judge: Model | None = None) -> DataFrame:
    """The metrics of answered cases: results and answers by query_id, which is the case's id here.

    With a judge, answers that weren't abstained from are judged by their claims (against the results' contents) and by
    their relevance to the case's question.
    """
    listed = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    responses = answers.select(F.col("query_id").alias("case_id"), "abstained").join(listed.withColumnRenamed("query_id", "case_id"), "case_id", "left")
    if judge is not None:
        texts = results.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("context"))
        spoken = answers.where(~F.col("abstained")).select(F.col("query_id").alias("case_id"), "answer").join(cases.select("case_id", "question"), "case_id")
        spoken = materialize(spoken.join(texts.withColumnRenamed("query_id", "case_id"), "case_id", "left"), "judged")
        faithful = metrics.judge_faithfulness(spoken, judge).select("case_id", "faithfulness")
        responses = responses.join(faithful, "case_id", "left").join(metrics.judge_answer_relevance(spoken, judge), "case_id", "left")
    return metrics.evaluate(cases, responses, k)


def route(queries: DataFrame) -> DataFrame:
    """Adds kind and route."""
    pairs = F.create_map(*[F.lit(x) for pair in routing.ROUTES.items() for x in pair])
    return queries.withColumn("kind", routing.classify("question")).withColumn("route", pairs[F.col("kind")])
