from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import context, graph, metrics, models, rerank, retrieval, routing, store
from tessera.plans import agent, answering
from tessera.streaming import reliability

RESULT = "query_id long, chunk_id string, content string, score double, source_uri string, retriever string, rank int"


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [(1, "x", 1), (1, "y", 2)]), ranked(spark, [(1, "y", 1), (1, "z", 2)])
    rows = {r.chunk_id: r for r in retrieval.fuse([a, b], [0.5, 0.5]).collect()}
    assert rows["y"].rank == 1 and rows["y"].score == 1.0 and rows["y"].branches == [0, 1]
    assert rows["x"].score == pytest.approx((0.5 / 61) / (0.5 / 61 + 0.5 / 62), abs=1e-6) and rows["x"].rank == 2
    with pytest.raises(ValueError):
        retrieval.fuse([a, b], [1.0])
    assert [r.chunk_id for r in retrieval.fuse([ranked(spark, [(1, "q", 1)]), ranked(spark, [(1, "p", 1)])], top=2).orderBy("rank").collect()] == ["q", "p"]


def test_dense_and_approximate_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("tenant_id"))
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"), "tenant_id")
    exact = retrieval.dense_search(asked, rows, 5)
    found = {(r.query_id, r.chunk_id) for r in exact.collect()}
    assert all((q, q) in found for q, _ in found)
    near = {(r.query_id, r.chunk_id) for r in retrieval.ivf_search(asked, rows, 5).collect()}
    assert len(found & near) >= 0.9 * len(found)
    own = retrieval.dense_search(asked, rows, 5, tenant=True).join(rows.select("chunk_id", F.col("tenant_id").alias("t")), "chunk_id").join(asked.select("query_id", "tenant_id"), "query_id")
    assert own.where("t <> tenant_id").count() == 0
    assert retrieval.dense_search(asked.limit(0), rows).count() == 0
    many = retrieval.QUERY_BLOCK
    try:
        retrieval.QUERY_BLOCK = 2
        assert {(r.query_id, r.chunk_id) for r in retrieval.dense_search(asked, rows, 5).collect()} == found
    finally:
        retrieval.QUERY_BLOCK = many


def test_lexical_search(spark):
    corpus = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "alpha alpha delta"), ("c", "gamma x x x x beta alpha"), ("d", None)], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "the alpha gamma"), (2, "of the and")], "query_id long, question string")
    assert {(r.query_id, r.chunk_id) for r in retrieval.lexical_search(asked, corpus).collect()} == {(1, "a"), (1, "c")}
    assert [r.chunk_id for r in retrieval.cover_density(asked, corpus).orderBy("rank").collect()] == ["a", "c"]
    assert retrieval._density([[0, 9], [2]]) == pytest.approx(1 / 3 + 1 / 8)


def test_fallback(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    s = "query_id long, chunk_id string, score double"
    first, second = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.1)], s), spark.createDataFrame([(1, "c", 0.9), (2, "d", 0.5)], s)
    assert {(r.query_id, r.chunk_id, r.stage) for r in retrieval.fallback([first, second], asked).collect()} == {(1, "a", 0), (2, "d", 1)}


def results(spark):
    rows = [(1, "a", "the cat sat on the mat today", 0.91), (1, "b", "the cat sat on the mat now", 0.8), (1, "c", "dogs run far", 0.71), (1, "d", "birds fly", 0.62)]
    return spark.createDataFrame([(*r, f"doc-{r[1]}.md", "x", i + 1) for i, r in enumerate(rows)], RESULT)


def test_rerank_diversify_dedupe(spark):
    assert [r.chunk_id for r in rerank.diversify(results(spark), keep=2, diversity=0.5).orderBy("pick").collect()] == ["a", "c"]
    assert [r.chunk_id for r in rerank.deduplicate(results(spark), 0.7).orderBy("rank").collect()] == ["a", "c", "d"]
    asked = spark.createDataFrame([(1, "dogs run")], "query_id long, question string")
    top = rerank.rerank(results(spark), asked, models.generate(lambda: models.overlap_judge)).collect()
    assert [r.chunk_id for r in top] == ["c"] and top[0].retriever == "x+rerank" and top[0].first_stage_score == 0.71
    left = spark.createDataFrame([(1, "a")], "query_id long, chunk_id string")
    assert rerank.merge_unique(left, spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], left.schema)).count() == 3


def test_chain_of_near_copies_keeps_the_third(spark):
    rows = [(1, "a", "a b c d"), (1, "b", "b c d e"), (1, "c", "c d e f")]
    df = spark.createDataFrame([(*r, 1.0, "", "", i + 1) for i, r in enumerate(rows)], "query_id long, chunk_id string, content string, score double, source_uri string, retriever string, rank int")
    assert [r.chunk_id for r in rerank.deduplicate(df, 0.6).orderBy("rank").collect()] == ["a", "c"]


def test_context(spark):
    packed = context.pack_budget(spark.createDataFrame([(1, "a", 1, "x" * 400), (1, "b", 2, "x" * 4000), (1, "c", 3, "x" * 40)], "query_id long, chunk_id string, rank int, content string"), 160)
    assert {r.chunk_id: r.spent for r in packed.collect()} == {"a": 120, "c": 150}
    places = spark.createDataFrame([(i, 4) for i in range(1, 5)], "r int, n int").select(context.edge_position("r", "n").alias("p")).collect()
    assert [r.p for r in places] == [1, 4, 2, 3]
    built = context.build_context(results(spark), threshold=0.7).first()
    assert [x.chunk_id for x in built.admitted] == ["a", "d", "c"] and built.context.startswith("[1]")
    said = spark.createDataFrame([("One [1]. Two [2].", 2), ("One [1]. Two.", 2), ("One [7].", 2), ("", 2)], "answer string, n_admitted int")
    rows = context.validate_citations(said).collect()
    assert [(r.passed, r.coverage, r.invalid) for r in rows] == [(True, 1.0, []), (False, 0.5, []), (False, 1.0, [7]), (True, 0.0, [])]


def test_routing(spark):
    asked = ["who is the owner", "compare a and b", "how many are there", "explain gravity", "what is related to x"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r.k for r in df.select(routing.classify("q").alias("k")).collect()] == ["factual", "comparative", "aggregate", "conceptual", "relational"]
    dependent = spark.createDataFrame([("does it work with the newest model of the series today",), ("please describe how photosynthesis works inside of green plants",), ("and then?",)], "q string")
    assert [r.d for r in dependent.select(routing.is_dependent("q").alias("d")).collect()] == [True, False, True]
    h = [("user", "u1"), ("assistant", "a1"), ("user", "u2")]
    rows = spark.createDataFrame([("and it?", h), ("and it?", []), ("please describe how photosynthesis works inside of green plants", h)], "question string, history array<struct<role:string,content:string>>")
    out = routing.condense(rows, models.generate(lambda: lambda ps: ["u2 " + p[-7:] for p in ps]))
    assert sorted(r.condensed for r in out.collect())[-1] == "u2 and it?" and out.where("condensed = question").count() == 2
    long = spark.createDataFrame([("q", "x" * 200), ("q", " ")], "q string, r string").select(routing.guarded_rewrite("q", "r").alias("x"))
    assert [r.x for r in long.collect()] == ["q", "q"]


def test_adaptive_search_widens(spark):
    asked = spark.createDataFrame([(1, "explain a"), (2, "explain b")], "query_id long, question string")
    calls = []

    def search(q, k):
        calls.append(k)
        return q.select("query_id", F.lit("c").alias("chunk_id"), F.when(F.col("query_id") == 1, 0.9).otherwise(0.2).alias("score"), F.lit(1).alias("rank"))

    got = {r.query_id: r.attempt for r in routing.adaptive_search(asked, search).collect()}
    assert got == {1: 1, 2: 2} and len(calls) == 2


def test_metrics(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "z"], {"b": 2, "z": 1}, [], [])], "r array<string>, rel array<string>, g map<string,int>, e array<string>, none array<string>")
    m = row.select(
        metrics.precision_at_k("r", "rel", 5).alias("p"), metrics.recall_at_k("r", "rel", 2).alias("rc"), metrics.reciprocal_rank("r", "rel").alias("rr"), metrics.hit_rate_at_k("r", "rel", 1).alias("h"),
        metrics.ndcg_at_k("r", "g", 3).alias("n"), metrics.recall_at_k("r", "none", 3).alias("none"), metrics.precision_at_k("e", "rel", 3).alias("empty"), metrics.precision_at_k("r", "rel", 0).alias("zero"),
    ).first()
    assert (m.p, m.rc, m.rr, m.h, m.none, m.empty, m.zero) == (pytest.approx(1 / 3), 0.5, 0.5, 0.0, 1.0, 0.0, 0.0)
    assert m.n == pytest.approx((3 / 1.5849625) / (3 + 1 / 1.5849625))
    votes = spark.createDataFrame([([1.0, 0.0, None],), ([None],), ([],)], "v array<double>").select(metrics.context_relevance("v").alias("x")).collect()
    assert [r.x for r in votes] == [0.5, None, 0.0]
    verdicts = spark.createDataFrame([("a", "SUPPORTED"), ("a", "UNSUPPORTED"), ("a", None), ("b", None)], "case_id string, verdict string")
    assert {r.case_id: r.faithfulness for r in metrics.faithfulness(verdicts).collect()} == {"a": 0.5, "b": None}
    rows = spark.createDataFrame([("s", 1.0), ("s", None), ("t", 0.0)], "segment string, m double")
    got = {r.segment: (r.m, r.n_m, r.n) for r in metrics.summarize(rows, ["m"]).collect()}
    assert got == {None: (0.5, 2, 3), "s": (1.0, 1, 2), "t": (0.0, 1, 1)}


def test_abstention_is_split(spark):
    cases = spark.createDataFrame([("a", "s", True, ["x"], {"x": 1}), ("b", "s", True, ["x"], {"x": 1}), ("c", "s", False, [], {})], "case_id string, segment string, is_answerable boolean, relevant_chunk_ids array<string>, relevance_grades map<string,int>")
    said = spark.createDataFrame([("a", ["x"], False, 1.0), ("b", [], True, 1.0), ("c", [], True, None)], "case_id string, retrieved array<string>, abstained boolean, faithfulness double")
    got = {r.case_id: (r.correct_abstention, r.faithfulness) for r in metrics.evaluate(cases, said).collect()}
    assert got == {"a": (None, 1.0), "b": (0.0, None), "c": (1.0, None)}


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    chunks = spark.createDataFrame([("u", 0, "text a", [3.0, 4.0]), ("u", 1, "text b", [1.0, 0.0])], "source_uri string, position int, content string, embedding array<float>")
    assert s.count("t1") == 0
    for _ in range(2):
        assert s.write(store.chunk_rows(chunks, tenant_id="t1", chapter="c1", embed_model="m1")) == 2
    assert s.count("t1") == 2 and s.count("t2") == 0 and s.version() == 2
    s.write(store.chunk_rows(chunks.limit(1), tenant_id="t1", chapter="other", embed_model="m2"))
    rows = {r.content: r for r in s.read("t1").collect()}
    assert {r.chapter for r in rows.values()} == {"c1"} and sorted(r.embed_model for r in rows.values()) == ["m1", "m2"]
    assert rows["text a"].embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        store.assert_embedding_model(s.read("t1"), "m1")
    s.write(store.chunk_rows(chunks, tenant_id="t2", chapter="c1", embed_model="m1"))
    assert s.delete("t1", "c1", soft=True) == 2 and s.count("t1") == 0 and s.count("t2") == 2
    assert s.delete("t1", "c1") == 2
    doc = spark.createDataFrame([('{"a": {"b": 1}, "l": ["x", "y"]}',)], "j string").select(F.parse_json("j").alias("j"))
    hits = doc.select(*[store.json_contains("j", w).alias(f"h{i}") for i, w in enumerate([{"a": {"b": 1}}, {"l": ["y"]}, {"a": {"b": 2}}, {"z": 1}])]).first()
    assert list(hits) == [True, True, False, False]


def test_extraction_and_merges(spark):
    reply = '{"entities": [{"name": "Ada", "type": "Person", "confidence": 0.9}, {"name": "Acme Inc", "type": "Organization"}, {"name": "data", "type": "Concept"}, {"name": "Bob", "type": "Alien"}, {"name": "Low", "type": "Person", "confidence": 0.1}, {"name": " ", "type": "Person"}], "relationships": [{"source": "Ada", "target": "Acme Inc", "type": "works at", "evidence": "e"}, {"source": "Ada", "target": "Ghost", "type": "USES"}, {"source": "Ada", "target": "Acme Inc", "type": "LIKES"}]}'
    df = spark.createDataFrame([("u", reply), ("v", "nothing")], "source_uri string, reply string")
    entities, links, rejects = graph.extract(df)
    assert {r.name for r in entities.collect()} == {"Ada", "Acme Inc"} and [r.rel_type for r in links.collect()] == ["WORKS_AT"]
    assert sorted(r.reason.split(":")[0] for r in rejects.collect()) == ["blank", "confidence", "dangling", "label", "relationship", "stop", "unreadable"]
    rows = spark.createDataFrame([("t", "acme", "Acme", "Concept", 0.6, "c1", 0), ("t", "acme", "ACME Inc", "Organization", 0.5, "c2", 1), ("t", "ada", "Ada", "Person", 1.0, "c1", 2)], "tenant_id string, canonical_name string, name string, entity_type string, confidence double, chapter string, seq int")
    nodes = graph.merge_nodes(rows)
    acme = nodes.where("canonical_name = 'acme'").first()
    assert (acme.name, acme.entity_type, acme.confidence, acme.surface_forms, acme.chapter) == ("Acme", "Organization", 0.6, ["Acme", "ACME Inc"], "c2")
    again = graph.merge_nodes(rows.where("seq = 0").withColumn("name", F.lit("Acme Ltd")), nodes).where("canonical_name = 'acme'").first()
    assert (again.name, again.surface_forms) == ("Acme", ["Acme", "ACME Inc", "Acme Ltd"])
    e = "tenant_id string, src string, dst string, rel_type string, source_uri string, confidence double, evidence string, chunk_id string, chapter string, seq int"
    edges = graph.merge_edges(spark.createDataFrame([("t", "ada", "acme", "USES", "u", 0.5, "", "", "c1", 0), ("t", "ada", "acme", "USES", "u", 0.7, "new", "", "c1", 1), ("t", "ada", "ghost", "USES", "u", 1.0, "", "", "c1", 2)], e), nodes)
    assert [(r.dst, r.confidence, r.evidence) for r in edges.collect()] == [("acme", 0.7, "new")]
    left, cut = graph.delete_chapter(nodes, edges, "t", "c2")
    assert [r.canonical_name for r in left.collect()] == ["ada"] and cut.count() == 0


def test_linking_and_traversal(spark):
    nodes = spark.createDataFrame([("t", "meridian acquisition project", "M"), ("t", "acme", "A"), ("u", "acne", "A")], "tenant_id string, canonical_name string, name string")
    asked = spark.createDataFrame([("t", 1, "Acme Corp"), ("t", 1, "Meridian Aquisition Project"), ("t", 1, "zzz")], "tenant_id string, query_id long, mention string")
    got = {r.mention: (r.canonical_name, r.how) for r in graph.link_mentions(asked, nodes).collect()}
    assert got == {"Acme Corp": ("acme", "exact"), "Meridian Aquisition Project": ("meridian acquisition project", "fuzzy"), "zzz": (None, None)}
    e = "tenant_id string, src string, dst string, rel_type string, source_uri string, confidence double, evidence string"
    edges = spark.createDataFrame([("t", "a", "b", "USES", "s", 0.9, "q"), ("t", "c", "b", "USES", "s", 0.8, ""), ("t", "c", "d", "USES", "s", 0.4, ""), ("t", "a", "a", "USES", "s", 0.6, "")], e)
    seeds = spark.createDataFrame([("t", "a")], "tenant_id string, seed string")
    paths = graph.traverse(seeds, edges)
    assert sorted(("".join(r.nodes), r.hops) for r in paths.collect()) == [("aa", 1), ("aab", 2), ("ab", 1), ("abc", 2)]
    triples = graph.path_triples(paths).orderBy("position").collect()
    assert [(t.src, t.dst) for t in triples] == [("a", "b"), ("c", "b"), ("a", "a")]
    assert graph.traverse(seeds, edges, hub_degree=2).where("array_contains(nodes, 'b')").count() == 0
    sentence = graph.triples_as_results(graph.path_triples(paths)).orderBy("position").first()
    assert sentence.content == 'a uses b. Supporting text: "q"' and sentence.score == 0.0
    assert graph.graph_stats(spark.createDataFrame([("t", "a", "Person"), ("t", "b", None)], "tenant_id string, canonical_name string, entity_type string"), edges).first().by_type == {"Person": 1}


def test_three_gates(spark):
    asked = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, question string")
    seen = []

    def client(prompts):
        return ["Fine [1]." if "cat" in p else "uncited" for p in prompts]

    out = {r.query_id: r for r in answering.answer(asked, results(spark), models.generate(lambda: client)).collect()}
    assert out[1].passed and not out[1].abstained and out[2].abstained and out[2].reason == "evidence" and not seen
    bad = answering.answer(asked.limit(1), results(spark), models.generate(lambda: lambda ps: ["uncited"] * len(ps))).first()
    assert not bad.passed and not bad.abstained
    none = answering.answer(asked.limit(1), results(spark), models.generate(lambda: lambda ps: [answering.ABSTAINED] * len(ps))).first()
    assert none.abstained and none.reason == "model"
    with pytest.raises(ValueError):
        answering.retrieve("magic", asked, results(spark))


def test_model_calls_fall_back():
    def picky(prompts):
        if len(prompts) > 1 or prompts == ["bad"]:
            raise RuntimeError
        return [p.upper() for p in prompts]

    assert models.call_batch(picky, ["a", "bad", "c"]) == ["A", None, "C"] and models.healthy(lambda: picky)
    assert models.extractive_answer(["x [1] y\nA fact. More."])[0] == "A fact [1]."


def test_agent(spark):
    asked = spark.createDataFrame([(1, "explain cats please"), (2, "explain nothing at all")], "query_id long, question string")
    found = results(spark).select("query_id", "chunk_id", "content", "score", "source_uri", "rank")
    search = lambda q, k: found.join(q.select("query_id").where("query_id = 1"), "query_id", "left_semi")
    speak = models.generate(lambda: models.extractive_answer)
    out = {r.query_id: r for r in agent.run_agent(asked, {"vector": search}, generator=speak, deadline_seconds=600).collect()}
    assert out[1].terminated_by == "sufficient_evidence" and not out[1].needs_human and out[2].terminated_by == "no_evidence"
    unsure = models.generate(lambda: lambda ps: ['{"sufficient": false, "next_query": "more cats"}'] * len(ps))
    once = agent.run_agent(asked.limit(1), {"vector": search}, evaluator=unsure, generator=speak, deadline_seconds=600).first()
    assert once.iteration == 1 and once.terminated_by == "sufficient_evidence"
    def other(ps):
        return [f'{{"sufficient": false, "next_query": "q{hash(p) % 7919}"}}' for p in ps]
    capped = agent.run_agent(asked.limit(1), {"vector": lambda q, k: search(q, k).where("false")}, evaluator=unsure, max_iterations=1, deadline_seconds=600).first()
    assert capped.terminated_by == "no_evidence" and other(["x"])


def test_breaker(spark):
    b = reliability.Breaker()
    assert [b.offer(t, False, 1) for t in range(5)][-1] == "open" and b.offer(10, True, 1) == "rejected"
    assert [b.offer(40 + t, True, 1) for t in range(3)] == ["half_open", "half_open", "closed"]
    b = reliability.Breaker()
    assert b.offer(0, True, 9000) == "closed" and [b.offer(t, True, 9000) for t in range(1, 5)][-1] == "open"
    assert b.offer(40, False, 1) == "open" and b.offer(50, True, 1) == "rejected"
    rows = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}", i >= 5, 1.0) for i in range(8)], "k long, i int, ts string, ok boolean, latency_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.state for r in reliability.breaker_states(rows, key="k").orderBy("i").collect()] == ["closed"] * 4 + ["open"] + ["rejected"] * 3


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", "ts", (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency_ms"), F.lit(1).alias("k")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = reliability.stream_signals(stream, key="k", slide="30 seconds").writeStream.format("memory").queryName("signals").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("signals").count() > 100


def test_retries_ladder_and_cache(spark):
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError
        return "ok"

    assert reliability.with_retries(call, sleep=lambda s: None) == "ok"
    with pytest.raises(ZeroDivisionError):
        reliability.with_retries(lambda: 1 / 0, sleep=lambda s: None)
    row = spark.createDataFrame([({"top_k": "5", "rerank": "true"}, 2), ({"top_k": "5"}, 0)], "c map<string,string>, p int").select(reliability.degrade("c", "p").alias("c")).collect()
    assert row[0].c == {"top_k": "5", "rerank": "false", "ef_search": "40"} and row[1].c == {"top_k": "5"}
    c = reliability.SemanticCache(max_entries=2)
    c.put([1, 0], "a", "t", "v1")
    assert c.get([1, 0.01], "t", "v1") == "a" and c.get([1, 0], "u", "v1") is None and c.get([1, 0], "t", "v2") is None and c.hit_rate == pytest.approx(1 / 3)
    c.put([0, 1], "b", "t", "v1")
    c.put([1, 1], "c", "t", "v1")
    assert c.get([1, 0], "t", "v1") is None
    assert reliability.fit_context(["x" * 40, "x" * 400, "x" * 4], 20) == ["x" * 40, "x" * 4]
    cached = reliability.cached_answers(
        spark.createDataFrame([(1, "t", "v", [1.0, 0.0]), (2, "u", "v", [1.0, 0.0])], "query_id long, tenant_id string, corpus_version string, qvec array<float>"),
        spark.createDataFrame([("t", "v", 3, [1.0, 0.0]), ("t", "v", 2, [1.0, 0.1])], "tenant_id string, corpus_version string, seq int, vector array<float>"),
    )
    assert [(r.query_id, r.seq) for r in cached.collect()] == [(1, 2)]


def test_ingest_and_graph(spark, tmp_path):
    docs = spark.createDataFrame([("/x/a.md", "Ada works at Acme. " * 60)], "path string, text string")
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    n = answering.ingest(docs, s, models.hashed_embedding, tenant_id="t", chapter="c", embed_model="hash")
    assert n == s.count("t") > 1 and s.read("t").first().metadata["source"] == "a.md"
    answering.ingest(docs, s, models.hashed_embedding, tenant_id="t", chapter="c", embed_model="hash")
    assert s.count("t") == n
    reply = '{"entities": [{"name": "Ada", "type": "Person"}, {"name": "Acme", "type": "Organization"}], "relationships": [{"source": "Ada", "target": "Acme", "type": "WORKS_AT"}]}'
    nodes, edges, rejects = answering.build_graph(docs.select(F.col("path").alias("source_uri"), "text"), models.generate(lambda: lambda ps: [reply] * len(ps)), tenant_id="t", chapter="c")
    assert nodes.count() == 2 and edges.count() == 1 and rejects.count() == 0
    passages = results(spark).select("query_id", "chunk_id", "content", "score", "source_uri", "retriever", "rank")
    facts = graph.triples_as_results(graph.path_triples(graph.traverse(spark.createDataFrame([("t", "ada")], "tenant_id string, seed string"), edges))).withColumn("query_id", F.lit(1).cast("long"))
    fused = graph.fuse_with_graph(passages, facts, spark.createDataFrame([(1, "Ada")], "query_id long, question string"), top=6).first()
    assert "ada works at acme" in fused.context and fused.graph_share == pytest.approx(1 / len(fused.admitted))


def test_generic_merges(spark):
    rows = spark.createDataFrame([("A", "x", "c1", {"k": "1", "l": "1"}, 0), ("A", "x", "c2", {"k": "2"}, 1), ("B", "x", "c1", {}, 2)], "label string, name string, chapter string, properties map<string,string>, seq int")
    nodes = graph.merge_entities(rows)
    assert {(r.label, r.chapter, tuple(sorted(r.properties.items()))) for r in nodes.collect()} == {("A", "c2", (("k", "2"), ("l", "1"))), ("B", "c1", ())}
    links = spark.createDataFrame([("x", "USES", "x", {"p": "1"}, 0), ("x", "USES", "gone", {}, 1)], "source string, rel_type string, target string, properties map<string,string>, seq int")
    assert graph.merge_relationships(links, nodes).count() == 4


def test_lab(spark, tmp_path):
    from tessera.plans import lab

    s = store.ChunkStore(spark, f"file://{tmp_path}/lab")
    texts = spark.createDataFrame([("u", "alpha beta gamma"), ("v", "delta")], "source_uri string, text string")
    assert lab.table_healthy(spark, s.path) and lab.embed_and_store(s, texts, tenant_id="t", chapter="c") == 2
    assert lab.semantic_search(s, "alpha beta", tenant_id="t", k=1)[0].source_uri == lab.keyword_search(s, "alpha", tenant_id="t")[0].source_uri == "u"
    assert lab.stored_count(s, tenant_id="t") == 2 and lab.clear_index(s, tenant_id="t", chapter="c") and lab.stored_count(s, tenant_id="t") == 0
    assert lab.embed_and_store(s, texts.drop("text"), tenant_id="t", chapter="c") == 0
