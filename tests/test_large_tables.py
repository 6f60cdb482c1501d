"""What grows with the tables: pairs that are compared, rows that are held at once, rows that are shuffled; results by brute force."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors
from tessera.operators import chunking, graph, models, retrieval, store, text_index
from tessera.plans import agent


def test_close_names_are_linked_without_comparing_all(spark, monkeypatch):
    names = [f"maker {i:09d}" for i in range(300)] + ["alpha works", "alpha wroks", "ab", "x"]
    said = [f"x{n}" for n in names[:100]] + ["alpha work", "aplha wroks", "maker 00000a00b", "abc", "y", "", "nothing like it"]
    pairs = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(tx, "fuzzy_ratio", counted)
    nodes = spark.createDataFrame([("t", n) for n in names] + [("u", "nothing like it")], "tenant_id string, canonical_name string")
    mentions = spark.createDataFrame([("t", i, m) for i, m in enumerate(said + said)], "tenant_id string, query_id int, mention string")
    found = {r.query_id: (r.canonical_name, r.how) for r in graph.link_mentions(mentions, nodes).collect()}
    for i, m in enumerate(said + said):
        rated = [(-SequenceMatcher(None, m, n).ratio(), n) for n in names]
        best = min([x for x in rated if -x[0] >= 0.86 and m], default=None)
        assert found[i] == ((best[1], "exact" if best[1] == m else "fuzzy") if best else (None, None)), m
    assert len(found) == 2 * len(said) and pairs.value < 10_000  # all makers by all names are 30,000, each rated once or twice


def test_cosine_of_equal_vectors_is_one(spark):
    rows = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], None), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine("a", "b")).collect()] == [1.0, 1.0, None, 0.0]


def test_texts_are_turned_into_objects_in_pieces():
    """Before, a batch of ten thousand texts was held as objects, with all its postings."""
    texts = [f"w{i} " + "a b c " * 20_000 for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(texts)], names=["chunk_id", "said"])
    for run in (retrieval._counted(None), retrieval._counted(None, listed=True), text_index._postings(False)):
        out = list(run(iter([batch])))
        assert len(out) >= 4 and sorted({x for b in out for x in b.column("chunk_id").to_pylist()})[:40] == list(range(40))
    assert sum(p.num_rows for p in retrieval.pieces(batch)) == 42


def test_searches_shuffle_only_the_best(spark):
    """Before, every pair of a question and a text that share a term (or a cell) was a row of a join."""
    corpus = spark.range(400).selectExpr("id AS chunk_id", "concat_ws(' ', 'common', 'w' || id % 7, 'v' || id % 3) AS content", "array(sin(id), cos(id)) AS embedding")
    asked = spark.range(5).selectExpr("id AS query_id", "concat('common w', id) AS question", "array(1.0D, id * 1.0D) AS qvec")
    found = [retrieval.lexical_search(asked, corpus, 4, all_terms=False), retrieval.lexical_search(asked, corpus, 4), retrieval.cover_density(asked, corpus, 4), retrieval.ivf_search(asked, corpus, 4, lists=3, probes=3)]
    for df in found:
        plan = df._jdf.queryExecution().toString()
        assert "Join" not in plan and df.count() == 20
    exact = retrieval.dense_search(asked, corpus, 4)
    assert sorted(found[3].select("query_id", "rank", "score").collect()) == sorted(exact.select("query_id", "rank", "score").collect())


def test_chunks_go_on_in_pieces():
    texts = pd.Series(["x" * 300_000] * 12 + [None, ""])
    out = list(chunking._in_pieces(lambda t: [t[:5], t[5:]])(iter([texts])))
    assert 3 <= len(out) <= 5 and [len(c) for s in out for c in s] == [2] * 12 + [0, 0]


def test_the_agent_judges_each_question_once_and_with_all_cores(spark):
    """Before, a hop was one task if the questions came in one file, built each prompt and asked the model three times, and ran searches that no question took."""
    asked = spark.range(64).coalesce(1).selectExpr("id AS query_id", "concat('explain item ', id) AS question")
    prompts, tasks, ran = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), []

    def client(said):
        prompts.add(len(said))
        return ['{"sufficient": true, "next_query": ""}'] * len(said)

    def factory():
        tasks.add(1)
        return client

    def search(name):
        def run(q, k):
            ran.append(name)
            return q.selectExpr("query_id", "'c' AS chunk_id", "'said' AS content", "1.0D AS score", "'s' AS source_uri", "1 AS rank")

        return run

    found = agent.run_agent(asked, {n: search(n) for n in ("vector", "graph", "hybrid")}, evaluator=models.generate(factory), deadline_seconds=600).collect()
    assert len(found) == 64 and {(r.iteration, r.terminated_by) for r in found} == {(0, "no_llm")}
    assert prompts.value == 64 and 2 <= tasks.value <= 16 and ran == ["vector"]


def test_a_vector_takes_its_norm_once(spark):
    """Before, each element took the norm of the whole vector anew."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)], "v array<float>")
    made = rows.select(vectors.l2_normalize("v").alias("u"))
    assert made._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r.u for r in made.collect()] == [[pd.Series([0.6], dtype="float32")[0], pd.Series([0.8], dtype="float32")[0]], [0.0, 0.0], [], None, [None, None]]
    assert made.schema["u"].dataType.simpleString() == "array<float>"


def test_an_empty_store_is_known_to_be_empty(spark, tmp_path):
    """Before, a first write shuffled all rows once more to join them with an empty table of Python's."""
    held = store.ChunkStore(spark, f"file://{tmp_path}/s")
    cut = spark.range(3).selectExpr("concat(id, '.txt') AS source_uri", "0 AS position", "'c' AS content", "array(1.0D) AS embedding")
    rows = store.chunk_rows(cut, tenant_id="t", chapter="c", embed_model="m")
    plan = store.upsert(held._rows(["t"]), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and held.read("t").count() == 0 and held.read("t").columns == held._rows().columns
    assert held.write(rows) == 3 and held.write(rows) == 3 and held.count("t") == 3
    plan = held.read("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "LogicalRDD" not in plan
