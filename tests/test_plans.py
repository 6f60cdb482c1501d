"""Plans around models and stores: nothing is lost when a call fails, and what is written is seen as a whole."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import context, graph, metrics, models, retrieval, routing, store
from tessera.plans import answering
from tessera.sources import loaders
from tessera.streaming import reliability

QUESTIONS = "query_id long, question string"


def results(spark, rows):
    return spark.createDataFrame([(q, f"c{q}", t, 0.9, "u", "dense", 1) for q, t in rows], "query_id long, chunk_id string, content string, score double, source_uri string, retriever string, rank int")


def test_a_failed_model_call_keeps_its_question(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "nothing found")], QUESTIONS)

    def client(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("down")
        return ["Fine [1]."] * len(prompts)

    out = {r.query_id: r for r in answering.answer(asked, results(spark, [(1, "x"), (2, "y")]), models.generate(lambda: client)).collect()}
    assert {k: (r.abstained, r.reason, r.passed) for k, r in out.items()} == {1: (False, None, True), 2: (True, "error", False), 3: (True, "evidence", False)}
    assert out[2].answer == answering.ABSTAINED


def test_store_switches_as_a_whole(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    rows = lambda *texts: spark.createDataFrame([("u", i, t, [1.0, 0.0]) for i, t in enumerate(texts)], "source_uri string, position int, content string, embedding array<float>")
    for tenant in ("a", "b", "c"):
        s.write(store.chunk_rows(rows("x", "y"), tenant_id=tenant, chapter="1", embed_model="m"))
    pointer = json.loads((tmp_path / "s/CURRENT").read_text())
    assert pointer == {"version": 3, "tenants": [["a", 1], ["b", 2], ["c", 3]]} and not list((tmp_path / "s").glob("CURRENT-*"))
    held = s.read("a")  # a reader of the old snapshot isn't disturbed by a write
    assert s.write(store.chunk_rows(rows("z"), tenant_id="a", chapter="2", embed_model="m")) == 1
    assert held.count() == 2 and s.count("a") == 3 and s.count("b") == 2
    # a version is one writer's: the later of two at once fails and nothing changes
    (tmp_path / "s/claims/v5").write_text("")
    with pytest.raises(Exception, match="exists"):
        s.write(store.chunk_rows(rows("w"), tenant_id="b", chapter="1", embed_model="m"))
    assert s.version() == 4 and s.count("b") == 2
    (tmp_path / "s/claims/v5").unlink()
    assert s.write(store.chunk_rows(rows("w"), tenant_id="b", chapter="1", embed_model="m").limit(0)) == 0 and s.version() == 4


def test_store_puts_folders_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDERS", 2)
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    chunks = spark.createDataFrame([("u", 0, "x", [1.0])], "source_uri string, position int, content string, embedding array<float>")
    for tenant in ("a", "b", "c"):
        s.write(store.chunk_rows(chunks, tenant_id=tenant, chapter="1", embed_model="m"))
    assert set(s._current()[1].values()) == {3} and [s.count(t) for t in "abc"] == [1, 1, 1]


def test_json_keys_with_dots_and_quotes(spark):
    doc = spark.createDataFrame([(json.dumps({"a.b": {"c d": 1}, "l": ["x"]}),)], "j string").select(F.parse_json("j").alias("j"))
    assert list(doc.select(store.json_contains("j", {"a.b": {"c d": 1}}), store.json_contains("j", {"a": {"b": 1}}), store.json_contains("j", {"l": ["x"]})).first()) == [True, False, True]


def test_shared_postings_give_the_same_rankings(spark):
    corpus = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "alpha alpha delta"), ("c", "gamma x beta alpha"), ("d", None), ("e", "")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "the alpha gamma"), (2, "delta")], QUESTIONS)
    every = retrieval.postings(corpus)
    assert every.where(F.col("term") == retrieval.TEXT).count() == 5 and every.where("term = 'alpha' AND chunk_id = 'b'").first().tf == 2
    for all_terms in (True, False):
        want = retrieval.lexical_search(asked, corpus, all_terms=all_terms).collect()
        assert want and sorted(retrieval.lexical_search(asked, None, all_terms=all_terms, index=every).collect()) == sorted(want)
        assert sorted(retrieval.lexical_search(asked, None, all_terms=all_terms, index=retrieval.question_postings(asked, corpus)).collect()) == sorted(want)


def test_hypothetical_answers(spark):
    asked = spark.createDataFrame([(1, "abc"), (2, "def")], QUESTIONS)
    reply = lambda p: F.when(p.endswith("abc"), "made up").otherwise(F.lit(None).cast("string"))
    assert {r.query_id: r.question for r in routing.hyde(asked, reply).collect()} == {1: "abc\n\nmade up", 2: "def"}


def test_adaptive_policy(spark):
    asked = spark.createDataFrame([(1, "what is the name"), (2, "how many are there"), (3, "tell me of it")], QUESTIONS)
    seen = []

    def search(q, k):
        seen.append(k)
        first = q.select("query_id", "question", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
        score = F.when(F.col("query_id") == 1, 0.9).when((F.col("query_id") == 2) & (F.col("rank") == 35), 0.7).otherwise(0.1)
        return first.select("query_id", F.concat_ws("-", "query_id", "rank").alias("chunk_id"), F.col("question").alias("content"), score.alias("score"), "rank", F.lit("r").alias("retriever"))

    rows = routing.adaptive_search(asked, search, model=lambda p: F.lit("hypothesis")).collect()
    assert seen == [30, 60]  # an aggregate question gets twice its thirty rows
    by = {q: [r for r in rows if r.query_id == q] for q in (1, 2, 3)}
    assert len(by[1]) == 5 and {r.attempt for r in by[1]} == {1} and by[1][0].corrections == []
    assert [(r.rank, r.attempt) for r in by[2]] == [(35, 2)] and by[2][0].corrections == [f"attempt 1: {routing.WIDENED}"]
    assert len(by[3]) == 24 and by[3][0].kind == "conceptual" and by[3][0].content == "tell me of it\n\nhypothesis"


def test_judged_answers(spark):
    rows = spark.createDataFrame([(1, "the cat", "The cat sat. The dog ran. It flew.", "A word. The cat sat. It flew."), (2, "x", "", "c")], "case_id long, question string, answer string, context string")
    got = {r.case_id: r for r in metrics.judge_faithfulness(rows, models.literal_judge).collect()}
    assert got[1].faithfulness == pytest.approx(2 / 3) and (got[1].claims, got[1].unsupported, got[1].reason) == (3, 1, None)
    assert got[2].faithfulness is None and got[2].reason in ("claim_extraction_failed", "no_usable_claims")
    mute = metrics.judge_faithfulness(rows.limit(1), lambda p: F.when(p.startswith("List"), '["a"]').otherwise("who knows")).first()
    assert (mute.faithfulness, mute.reason) == (None, "all_verdicts_unparseable")
    assert [r.answer_relevance for r in metrics.judge_answer_relevance(rows, models.literal_judge).orderBy("case_id").collect()] == [1.0, 0.0]


def test_judged_run_of_a_golden_set(spark):
    cases = spark.createDataFrame([("1", "s", "the cat", True, ["c1"], {"c1": 1}), ("2", "s", "nothing", False, [], {})], "case_id string, segment string, question string, is_answerable boolean, relevant_chunk_ids array<string>, relevance_grades map<string,int>")
    found = spark.createDataFrame([("1", "c1", "The cat sat.", 1)], "query_id string, chunk_id string, content string, rank int")
    answers = spark.createDataFrame([("1", "The cat sat.", False), ("2", "INSUFFICIENT", True)], "query_id string, answer string, abstained boolean")
    got = {r.case_id: r for r in answering.evaluate(cases, found, answers, judge=models.literal_judge).collect()}
    assert (got["1"].faithfulness, got["1"].answer_relevance, got["1"].hit_rate) == (1.0, 1.0, 1.0)
    assert (got["2"].faithfulness, got["2"].correct_abstention) == (None, 1.0)


def test_graph_guided_expansion(spark):
    asked = spark.createDataFrame([(1, "who owns Acme"), (2, "plain")], QUESTIONS)
    seeds = spark.createDataFrame([(1, 1, "acme"), (1, 2, "Bolt Ltd"), (1, 3, "")], "query_id long, position int, name string")
    assert [(r.query_id, r.question) for r in graph.expanded_questions(asked, seeds).collect()] == [(1, "who owns Acme Bolt Ltd")]
    search = lambda q, k: q.select("query_id", F.lit(k).alias("rank"), F.col("question").alias("content"))
    rows = graph.guided_search(asked, seeds, search, 2).collect()
    assert sorted((r.query_id, r.rank) for r in rows) == [(1, 8), (1, 12), (2, 8)]
    model = lambda p: F.when(p.contains("plain"), "none").otherwise('x ["Acme ", ""] y')
    assert [(r.query_id, r.mention) for r in graph.question_mentions(asked, model).collect()] == [(1, "Acme")]
    assert [(r.query_id, r.mention) for r in graph.question_mentions(asked).collect()] == [(1, "Acme")]


def test_times_of_creation_stay(spark):
    node = "tenant_id string, canonical_name string, name string, entity_type string, confidence double, chapter string, seq int"
    first = graph.merge_nodes(spark.createDataFrame([("t", "a", "A", "Person", 0.5, "1", 1)], node)).withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    again = graph.merge_nodes(spark.createDataFrame([("t", "a", "AA", "Person", 0.7, "1", 2), ("t", "b", "B", "Person", 0.7, "1", 3)], node), first)
    got = {r.canonical_name: r for r in again.collect()}
    assert got["a"].created_at.year == 2020 and got["b"].created_at.year > 2020 and got["a"].surface_forms == ["A", "AA"]
    edge = "tenant_id string, src string, dst string, rel_type string, source_uri string, confidence double, evidence string, chunk_id string, chapter string, seq int"
    edges = graph.merge_edges(spark.createDataFrame([("t", "a", "b", "USES", "u", 0.5, "e", "c", "1", 1)], edge), again)
    assert edges.first().created_at is not None
    shown, ends = loaders.graph_view(again, edges, limit=1)
    assert shown.count() == 1 and ends.first().source == "A"


def test_dual_ingest_and_stage_times(spark, tmp_path):
    docs = spark.createDataFrame([("d/x.txt", "Ann works at Acme. " * 30)], "path string, text string")
    reply = json.dumps({"entities": [{"name": "Ann", "type": "Person", "confidence": 0.9}, {"name": "Acme", "type": "Organization", "confidence": 0.9}], "relationships": [{"source": "Ann", "target": "Acme", "type": "WORKS_AT", "confidence": 0.9, "evidence": "works"}]})
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    n, nodes, edges, rejects = answering.ingest_both(docs, s, models.hashed_embedding, lambda p: F.lit(reply), tenant_id="t", chapter="1", embed_model="hash")
    assert n == s.count("t") > 0 and nodes.count() == 2 and edges.count() == 1 and rejects.count() == 0
    out, times = answering.timed({"one": lambda d: d.where("path <> ''"), "two": lambda d: d.select("path")}, docs)
    assert out.columns == ["path"] and [(r.stage, r.ms > 0) for r in times.collect()] == [("one", True), ("two", True)]
    compared = answering.compare({"x": results(spark, [(1, "a")])}, clock=True).first()
    assert compared.latency_ms > 0 and compared.top_score == 0.9


def test_budget_without_headers_and_cache_without_oneself(spark):
    rows = results(spark, [(1, "x" * 40)]).unionByName(results(spark, [(1, "y" * 400)]).withColumn("rank", F.lit(2)).withColumn("chunk_id", F.lit("z")))
    assert [(r.chunk_id, r.spent) for r in context.plain_budget(rows, 5000, 50).collect()] == [("c1", 10)]
    entries = spark.createDataFrame([("t", "v", 1, [1.0, 0.0]), ("t", "v", 2, [1.0, 0.1])], "tenant_id string, corpus_version string, seq long, vector array<float>")
    asked = entries.select("tenant_id", "corpus_version", F.col("seq").alias("query_id"), F.col("vector").alias("qvec"))
    assert sorted(reliability.cached_answers(asked, entries, own="query_id").collect()) == [(1, 2), (2, 1)]
