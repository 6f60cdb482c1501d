"""More queries with their SQL: parsers of replies, prompts, filters, merges of graphs and pools, the store's life."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores, text as tx
from tessera.operators import chunking, graph, metrics, models, rerank, retrieval, routing, store
from tessera.plans.registry import _BM25, _EDGES, _WALK, ORACLE_SQL, _edges, _lexical, _nodes, _regions, _results, _split_sql, _t, query
from tessera.scratch import materialize, scratch_path
from tessera.sources import loaders
from tessera.streaming import reliability


# Replies of models, made of the tables' own texts.
@query(r"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS h FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)")
def chunk_sentences(spark, sf_dir):
    s = tx.split_sentences("text", before_capital=True)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("h"))


@query(r"SELECT doc_id, CASE WHEN x = '' THEN 0.25 ELSE least(10.0, CAST(x AS DOUBLE)) / 10 END AS score FROM (SELECT doc_id, regexp_extract(text, '(\d+(?:\.\d+)?)', 1) AS x FROM documents)")
def parsed_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").withColumn("first", F.lit(0.25))
    return scores.rescore(rows, tx.parse_score("text", "first")).select("doc_id", "score")


_SAID = "CASE turn % 5 WHEN 0 THEN 'It is supported. ' WHEN 1 THEN 'Unsupported, even contradicted. ' WHEN 2 THEN 'unsupportedly ' WHEN 3 THEN 'UNSUPPORTED ' ELSE '' END || text"


@query(
    rf"SELECT conv_id, turn, CASE WHEN regexp_matches(s, '\bCONTRADICTED\b') THEN 'CONTRADICTED' WHEN regexp_matches(s, '\bUNSUPPORTED\b') THEN 'UNSUPPORTED' WHEN regexp_matches(s, '\bSUPPORTED\b') THEN 'SUPPORTED' END AS verdict"
    rf" FROM (SELECT conv_id, turn, upper({_SAID}) AS s FROM conversations)"
)
def verdicts(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.match_verdict(F.expr(_SAID)).alias("verdict"))


_ARRAY = """CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Sure: ["' || lang || '", "' || source || '"' WHEN 2 THEN 'Sure: ["' || lang || '", "' || source || '"] as asked' ELSE '[]' END"""


@query(f"SELECT doc_id, CASE WHEN json_valid(x) THEN array_to_string(from_json(x, '[\"VARCHAR\"]'), '|') END AS items FROM (SELECT doc_id, regexp_extract({_ARRAY}, '(\\[.*\\])', 1, 's') AS x FROM documents)")
def json_arrays(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.json_array(F.expr(_ARRAY)), "|").alias("items"))


_OBJECT = """CASE doc_id % 3 WHEN 0 THEN 'no object' WHEN 1 THEN 'So: {"sufficient": true, "next_query": "' || lang || '"} done' ELSE '{"sufficient": false, "next_query": ' END"""


@query(
    "SELECT doc_id, CASE WHEN x <> '' AND json_valid(x) THEN CAST(json_extract(x, '$.sufficient') AS BOOLEAN) END AS sufficient, CASE WHEN x <> '' AND json_valid(x) THEN json_extract_string(x, '$.next_query') END AS next_query"
    f" FROM (SELECT doc_id, regexp_extract({_OBJECT}, '(\\{{.*\\}})', 1, 's') AS x FROM documents)"
)
def json_objects(spark, sf_dir):
    found = tx.json_object(F.expr(_OBJECT), "sufficient boolean, next_query string")
    return _t(spark, sf_dir, "documents").select("doc_id", found["sufficient"].alias("sufficient"), found["next_query"].alias("next_query"))


_VOTE = "CASE (conv_id + turn) % 3 WHEN 0 THEN ' yes, ' || text WHEN 1 THEN 'No. ' || text ELSE 'Well, ' || text END"


@query(f"SELECT conv_id, avg(CASE WHEN starts_with(s, 'YES') THEN 1.0 WHEN starts_with(s, 'NO') THEN 0.0 END) AS relevance FROM (SELECT conv_id, upper(trim({_VOTE})) AS s FROM conversations) GROUP BY conv_id")
def context_votes(spark, sf_dir):
    votes = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", tx.yes_no(F.expr(_VOTE)).alias("v")).alias("x"))
    return votes.groupBy("conv_id").agg(F.collect_list("x").alias("x")).select("conv_id", metrics.context_relevance(F.transform("x", lambda x: x["v"])).alias("relevance"))


@query("SELECT c_custkey, replace(upper(trim(' ' || c_mktsegment || ' of part ')), ' ', '_') AS rel_type FROM customer")
def relation_types(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.relation_type(F.concat(F.lit(" "), "c_mktsegment", F.lit(" of part "))).alias("rel_type"))


# Prompts.
@query(
    "SELECT n_regionkey, string_agg(printf('[%d] (relevance %.3f)', CAST(i AS INT), CAST(n_nationkey / 32.0 AS DOUBLE)) || chr(10) || n_name, chr(10) || chr(10) ORDER BY i) AS blocks"
    " FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey"
)
def numbered_evidence(spark, sf_dir):
    each = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") / 32.0).alias("score"), F.col("n_name").alias("content")))).alias("r"))
    return each.select("n_regionkey", tx.numbered_blocks("r").alias("blocks"))


@query(
    "SELECT n_regionkey, 'Graph facts:' || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) FILTER (i <= 3) || chr(10) || 'Quotes:' || chr(10) || string_agg('\"' || n_nationkey || '\"', chr(10) ORDER BY n_nationkey) FILTER (i <= 2) AS said"
    " FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey"
)
def rendered_graph(spark, sf_dir):
    each = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return each.select("n_regionkey", tx.render_graph(F.transform("r", lambda x: x["n_name"]), F.transform("r", lambda x: x["n_nationkey"].cast("string")), 3, 2).alias("said"))


@query("SELECT doc_id, sha256('List the claims of this answer as a JSON array of strings.' || chr(10) || chr(10) || left(text, 400)) AS claims, sha256('Is the evidence enough? Answer as JSON: {\"sufficient\": bool, \"next_query\": string}' || chr(10) || chr(10) || left(text, 400) || chr(10) || chr(10) || 'Question: ' || source) AS evaluate FROM documents")
def filled_templates(spark, sf_dir):
    cut = tx.truncate("text", 400)
    filled = tx.fill_template("claims", answer=cut), tx.fill_template("evaluate", context=cut, question="source")
    return _t(spark, sf_dir, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for c, n in zip(filled, ("claims", "evaluate"), strict=True)])


_WORD = r"[A-Z][\p{L}\p{M}\p{Nd}\p{Pc}.\-]*"


@query(rf"SELECT item_id, len(m) AS n, array_to_string(m, '|') AS mentions FROM (SELECT item_id, regexp_extract_all(text, '\b({_WORD}(?:\s+{_WORD})*)', 1) AS m FROM benchmark)")
def capitalized_mentions(spark, sf_dir):
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    listed = asked.select("query_id", tx.capitalized_mentions("question").alias("m"))
    return listed.select(F.col("query_id").alias("item_id"), F.size("m").cast("long").alias("n"), F.array_join("m", "|").alias("mentions"))


@query("SELECT doc_id, CAST(s / 500 AS BIGINT) AS position, sha256(substring(text, s + 1, 500)) AS h FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 500)) AS s FROM documents WHERE length(text) > 0)")
def naive_slices(spark, sf_dir):
    return chunking.fixed_size(_t(spark, sf_dir, "documents"), 500, 0).select("doc_id", F.col("position").cast("long").alias("position"), F.sha2("content", 256).alias("h"))


# Filters.
@query("SELECT doc_id, lang = 'en' AND source = (SELECT min(source) FROM documents) AS equal, lang = 'de' AND doc_id % 2 = 0 AS contained FROM documents")
def metadata_filters(spark, sf_dir):
    """Equality of a map's keys; containment in JSON with a nested object, a list and a key with a dot and a quote."""
    docs = _t(spark, sf_dir, "documents")
    first = docs.agg(F.min("source")).first()[0]
    held = docs.select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("m"), F.to_json(F.struct(F.struct(F.col("lang").alias("a.b'c")).alias("x"), F.array((F.col("doc_id") % 2).cast("string"), F.lit("z")).alias("tags"))).alias("j"))
    wanted = {"x": {"a.b'c": "de"}, "tags": ["0"]}
    return held.select("doc_id", store.metadata_matches("m", {"lang": "en", "source": first}).alias("equal"), store.json_contains(F.parse_json("j"), wanted).alias("contained"))


_REWRITE = "CASE item_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat(text, 6) WHEN 2 THEN ' ' || text || ' ' ELSE NULL END"


@query(f"SELECT item_id, sha256(CASE WHEN r = '' OR length(r) > 4 * length(q) + 80 THEN q ELSE r END) AS h FROM (SELECT item_id, text AS q, trim(coalesce({_REWRITE}, '')) AS r FROM benchmark)")
def guarded_rewrites(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.sha2(routing.guarded_rewrite(F.col("text"), F.expr(_REWRITE)), 256).alias("h"))


@query("SELECT doc_id % 10 AS query_id, doc_id AS chunk_id, CASE WHEN n_chars > 1000 THEN 'a' ELSE 'b' END AS pool FROM documents")
def merged_pools(spark, sf_dir):
    """The long documents, then all of them: those that are new."""
    rows = _t(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("chunk_id"), "n_chars")
    long, every = rows.where("n_chars > 1000").drop("n_chars"), rows.drop("n_chars")
    return rerank.merge_unique(long.withColumn("pool", F.lit("a")), every.withColumn("pool", F.lit("b")))


_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '([a-z]{{4,}})', 1)), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_TERMS) + "], x))"


@query(f"""
WITH a AS (SELECT item_id AS case_id, unnest({_TERMS.format("text || ' ' || left(text, 10)")}) AS term FROM benchmark), c AS (SELECT doc_id AS chunk_id, unnest({_TERMS.format('text')}) AS term FROM documents),
o AS (SELECT case_id, chunk_id, count(*) AS overlap FROM a JOIN c USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, chunk_id DESC) AS rank FROM o)
SELECT case_id, chunk_id, overlap, CASE WHEN rank = 1 THEN 2 ELSE 1 END AS grade FROM r WHERE rank <= 3
""")
def golden_rebuild(spark, sf_dir):
    cases = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.expr("left(text, 10)").alias("expected_answer"))
    return store.golden_labels(cases, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))).select("case_id", "chunk_id", "overlap", "grade")


@query(f"""
WITH {_BM25}, pairs AS (SELECT r.query_id, r.chunk_id, r.rank, split_part(b.text, chr(10), 1) AS line, b.text AS question, left(d.text, 1200) AS passage FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10),
worded AS (SELECT *, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) AS asked, regexp_extract_all('rate from 0 to 10 how well the passage answers ' || lower(substr(question, length(line) + 1)) || ' ' || lower(passage), '[a-z0-9]+') AS rest FROM pairs),
judged AS (SELECT query_id, chunk_id, rank, least(10.0, CAST(printf('%.2f', CAST(10.0 * len(list_intersect(asked, rest)) / greatest(1, len(asked)) AS DOUBLE)) AS DOUBLE)) / 10 AS score FROM worded),
best AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM judged WHERE score >= 0.3)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank, 'lexical+rerank' AS retriever FROM best WHERE rank <= 5
""")
def reranked(spark, sf_dir):
    questions, _ = _lexical(spark, sf_dir)
    judge = models.generate(lambda: models.overlap_judge)
    return rerank.rerank(_results(spark, sf_dir), questions, judge).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "retriever")


@query("""
WITH q AS (SELECT n_nationkey AS query_id, string_split(lower(n_name || ' in ' || r_name), ' ') AS w FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT query_id, CAST(r_regionkey AS VARCHAR) AS chunk_id, round(len(list_intersect(list_distinct(w), string_split(lower(r_name), ' '))) / CAST(len(list_distinct(w)) AS DOUBLE), 4) AS score FROM q, region)
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 2
""")
def static_hits(spark, sf_dir):
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    rows = region.select(F.col("r_regionkey").cast("string").alias("chunk_id"), F.col("r_name").alias("content"))
    asked = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" in "), "r_name").alias("question"))
    return loaders.static_results(rows, asked, 2).select("query_id", "chunk_id", "score")


# Graphs.
_REPLY = """CASE WHEN s_suppkey % 11 = 0 THEN 'Here: {"entities": [' ELSE
 'Here: {"entities": [{"name": "' || s_name || '", "type": "' || CASE s_suppkey % 4 WHEN 1 THEN 'Vendor' ELSE 'Organization' END || '"' || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', "confidence": 0.4' ELSE ', "confidence": "0.9"' END
 || '}, {"name": "' || CASE s_suppkey % 7 WHEN 0 THEN 'Company' WHEN 1 THEN ' ' ELSE 'Nation ' || s_nationkey END || '", "type": "Location"}], "relationships": [{"source": "' || s_name || '", "target": "'
 || CASE s_suppkey % 7 WHEN 0 THEN 'Company' WHEN 1 THEN ' ' ELSE 'Nation ' || s_nationkey END || '", "type": "' || CASE s_suppkey % 3 WHEN 0 THEN 'owns' ELSE 'located in' END || '", "confidence": 0.8}]} end' END"""


@query("""
WITH x AS (SELECT s_suppkey, s_name AS a, CASE s_suppkey % 7 WHEN 0 THEN 'Company' WHEN 1 THEN '' ELSE 'Nation ' || s_nationkey END AS b,
  CASE WHEN s_suppkey % 4 = 1 THEN 'label:Vendor' WHEN s_suppkey % 5 = 1 THEN 'confidence:' || s_name END AS bad_a, CASE s_suppkey % 7 WHEN 0 THEN 'stop:Company' WHEN 1 THEN 'blank' END AS bad_b,
  CASE WHEN s_suppkey % 5 = 0 THEN 1.0 ELSE 0.9 END AS conf FROM supplier WHERE s_suppkey % 11 <> 0),
r AS (SELECT s_suppkey, CASE WHEN bad_a IS NOT NULL OR bad_b IS NOT NULL THEN 'dangling:' || a || '->' || b WHEN s_suppkey % 3 = 0 THEN 'relationship:OWNS' END AS bad FROM x)
SELECT s_suppkey, 'entity' AS kind, a AS said, CAST(conf AS DOUBLE) AS confidence FROM x WHERE bad_a IS NULL UNION ALL SELECT s_suppkey, 'entity', b, 1.0 FROM x WHERE bad_b IS NULL
UNION ALL SELECT s_suppkey, 'relationship', 'LOCATED_IN', 0.8 FROM r WHERE bad IS NULL UNION ALL SELECT s_suppkey, 'reject', bad_a, NULL FROM x WHERE bad_a IS NOT NULL
UNION ALL SELECT s_suppkey, 'reject', bad_b, NULL FROM x WHERE bad_b IS NOT NULL UNION ALL SELECT s_suppkey, 'reject', bad, NULL FROM r WHERE bad IS NOT NULL
UNION ALL SELECT s_suppkey, 'reject', 'unreadable', NULL FROM supplier WHERE s_suppkey % 11 = 0
""")
def extraction(spark, sf_dir):
    """Replies with unknown labels, stop names, blanks, low and missing confidences, unknown relations and cut JSON."""
    entities, links, rejects = graph.extract(_t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_REPLY).alias("reply")))
    row = lambda df, kind, said, c: df.select("s_suppkey", F.lit(kind).alias("kind"), F.col(said).alias("said"), c.cast("double").alias("confidence"))
    return row(entities, "entity", "name", F.col("confidence")).unionByName(row(links, "relationship", "rel_type", F.col("confidence"))).unionByName(row(rejects, "reject", "reason", F.lit(None)))


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(hops=3, hub=10**9)} SELECT seed, CAST(rank AS INT) AS rank, hops, round(pc, 6) AS path_confidence FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pc DESC, hops) AS rank FROM walk WHERE hops > 0) WHERE rank <= 120")
def best_paths(spark, sf_dir):
    """Without the paths themselves: which of equally good ones comes first is an order of edge hashes."""
    paths = graph.traverse(_regions(spark, sf_dir), _edges(spark, sf_dir), max_hops=3, hub_degree=10**9, told=False)
    return paths.select("seed", F.col("rank").cast("int").alias("rank"), "hops", F.round("path_confidence", 6).alias("path_confidence"))


@query(f"""
WITH RECURSIVE {_EDGES}, {_WALK.format(hops=2, hub=10**9)}, t AS (SELECT DISTINCT seed, eid FROM (SELECT seed, unnest(eids) AS eid FROM walk))
SELECT seed, src || ' ' || lower(replace(rel_type, '_', ' ')) || ' ' || dst || '.' AS content, sha256(src || '|' || rel_type || '|' || dst) AS chunk_id, source_uri FROM t JOIN e ON e.eid = t.eid
""")
def path_triples(spark, sf_dir):
    paths = graph.traverse(_regions(spark, sf_dir), _edges(spark, sf_dir), max_hops=2, hub_degree=10**9, limit=10**9)
    return graph.triples_as_results(graph.path_triples(paths)).select("seed", "content", "chunk_id", "source_uri")


@query(f"WITH {_EDGES} SELECT rel_type, src AS source, dst AS target FROM edges WHERE source_uri = 'supplier' ORDER BY src, rel_type, dst LIMIT 50")
def graph_listing(spark, sf_dir):
    """The bounded listing of a chapter's relationships."""
    nodes = graph.merge_nodes(_nodes(spark, sf_dir)).withColumn("name", F.col("canonical_name"))
    edges = _edges(spark, sf_dir).where("chapter = 'supplier'").withColumn("chapter", F.lit("one"))
    return loaders.graph_view(nodes, edges, limit=50)[1].select("rel_type", "source", "target")


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS edges")
def graph_delete(spark, sf_dir):
    nodes, edges = graph.delete_chapter(graph.merge_nodes(_nodes(spark, sf_dir)), _edges(spark, sf_dir), "t", "supplier")
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


_GENERIC = "SELECT c_mktsegment AS label, CAST(c_nationkey AS VARCHAR) AS name, CAST(c_custkey % 5 AS VARCHAR) AS chapter, 'k' || (c_custkey % 3) AS p, c_custkey AS o FROM customer"


def _generic(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("string").alias("name"), (F.col("c_custkey") % 5).cast("string").alias("chapter"),
        F.create_map(F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string")), F.col("c_custkey").cast("string")).alias("properties"), F.col("c_custkey").alias("seq"),
    )
    return graph.merge_entities(rows)


@query(f"WITH g AS ({_GENERIC}), l AS (SELECT label, name, arg_max(chapter, o) AS chapter FROM g GROUP BY ALL), v AS (SELECT label, name, p, CAST(max(o) AS VARCHAR) AS v FROM g GROUP BY ALL) SELECT label, name, chapter, p, v FROM l JOIN v USING (label, name)")
def generic_nodes(spark, sf_dir):
    return _generic(spark, sf_dir).select("label", "name", "chapter", F.explode("properties").alias("p", "v"))


@query(f"""
WITH g AS (SELECT DISTINCT label, name FROM ({_GENERIC})), i AS (SELECT CAST(s_nationkey AS VARCHAR) AS source, 'SUPPLIES' AS rel_type, CAST(s_nationkey // 2 AS VARCHAR) AS target, CAST(max(s_suppkey) AS VARCHAR) AS properties FROM supplier GROUP BY ALL)
SELECT a.label AS source_label, source, rel_type, b.label AS target_label, target, properties FROM i JOIN g a ON a.name = source JOIN g b ON b.name = target
""")
def generic_relationships(spark, sf_dir):
    nation = F.col("s_nationkey")
    rows = _t(spark, sf_dir, "supplier").select(nation.cast("string").alias("source"), F.lit("SUPPLIES").alias("rel_type"), F.floor(nation / 2).cast("long").cast("string").alias("target"), F.col("s_suppkey").cast("string").alias("properties"), F.col("s_suppkey").alias("seq"))
    return graph.merge_relationships(rows, _generic(spark, sf_dir))


@query("""
WITH d AS (SELECT source AS tenant_id, lang AS chapter, sha256(CAST(doc_id AS VARCHAR) || '|0|' || coalesce(text, '')) AS h FROM documents),
f AS (SELECT min(tenant_id) AS t, (SELECT min(tenant_id) FROM d WHERE tenant_id > (SELECT min(tenant_id) FROM d)) AS u FROM d)
SELECT tenant_id, chapter, count(DISTINCT h) AS rows, CASE WHEN tenant_id = t AND chapter = 'de' THEN 0 ELSE count(DISTINCT h) END AS active, 'm' AS model FROM d, f WHERE NOT (tenant_id = u AND chapter = 'de') GROUP BY tenant_id, chapter, t
""")
def store_life(spark, sf_dir):
    """All sources are written as tenants; of the first one's chapters one is deleted softly, of the second one's for good."""
    docs = _t(spark, sf_dir, "documents")
    tenants = [r[0] for r in docs.select("source").distinct().orderBy("source").limit(2).collect()]
    held = store.ChunkStore(spark, scratch_path(spark, "store"))
    for chapter in [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]:  # a handful of languages
        rows = docs.where(F.col("lang") == chapter)
        rows = rows.select("source", F.col("doc_id").cast("string").alias("source_uri"), F.lit(0).alias("position"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
        held.write(store.chunk_rows(rows, tenant_id=F.col("source"), chapter=chapter, embed_model="m"))
    for tenant, soft in zip(tenants, (True, False), strict=False):
        held.delete(tenant, "de", soft=soft)
    every = docs.select("source").distinct().collect()  # a store's tenants
    out = None
    for r in every:
        rows = held.read(r[0], active=False)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("tenant_id", "chapter").agg(F.count("*").alias("rows"), F.count_if("is_active").alias("active"), F.min("embed_model").alias("model"))


# The agent over facts about customers: a fact names where a customer lives, and one more where that nation lies; every fifth customer's
# fact says both, every third one's (of the rest) leads to another customer without end, every seventh customer and fifth nation has none.
_FACTS = """
f AS (SELECT c_name AS subject, CASE WHEN c_custkey % 5 = 0 THEN 'lies' WHEN c_custkey % 3 = 0 THEN 'branch' ELSE 'lives' END AS kind,
    CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + 3 AS VARCHAR), 9, '0') ELSE n_name END END AS next
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0
  UNION ALL SELECT n_name, 'lies', NULL FROM nation WHERE n_nationkey % 5 <> 0)
"""


def _facts(spark, sf_dir):
    nation, region, customer = (_t(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    k = F.col("c_custkey")
    other = F.concat(F.lit("Customer#"), F.lpad((k + 3).cast("string"), 9, "0"))
    lives = F.when(k % 5 == 0, F.format_string("%s lives where %s lies in %s.", "c_name", "n_name", "r_name")).when(k % 3 == 0, F.format_string("%s is a branch of %s.", "c_name", other))
    told = customer.where(k % 7 != 0).join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    told = told.select(F.concat(F.lit("C"), k).alias("chunk_id"), F.col("c_name").alias("subject"), F.coalesce(lives, F.format_string("%s lives in %s.", "c_name", "n_name")).alias("content"))
    return told.unionByName(named.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("chunk_id"), F.col("n_name").alias("subject"), F.format_string("%s lies in %s.", "n_name", "r_name").alias("content")))


def _next_fact(prompt):
    """A judge by rules: the last fact told ends the search, or names what to look for next."""
    # cut at fixed strings: a pattern for the line would try each of the prompt's letters as its beginning
    line = F.substring_index(F.substring_index(prompt, "\n\nQuestion:", 1), "\n", -1)
    last = F.regexp_extract(line, r"^(.+)\.$", 1)
    following = F.regexp_extract(last, r"(?:lives in|is a branch of) (.+)$", 1)
    return F.when(last.contains(" lies in "), F.lit('{"sufficient": true, "next_query": ""}')).otherwise(
        F.concat(F.lit('{"sufficient": false, "next_query": "'), F.when(following != "", F.concat(F.lit("Where is "), following, F.lit("?"))).otherwise(""), F.lit('"}'))
    )


@query(f"""
WITH RECURSIVE {_FACTS},
m AS (SELECT * FROM (VALUES ('answered', 3), ('silent', 1)) t(mode, cap)),
s AS (
  SELECT c_custkey AS query_id, mode, cap, 0 AS iteration, c_name AS first, kind, kind AS first_kind, next, kind IS NULL OR kind = 'lies' AS ended FROM customer CROSS JOIN m LEFT JOIN f ON subject = c_name
  UNION ALL
  SELECT query_id, mode, cap, iteration + 1, first, coalesce(f.kind, s.kind), first_kind, coalesce(f.next, CASE WHEN f.subject IS NULL THEN s.next END), f.subject IS NULL OR f.kind = 'lies' OR iteration + 1 >= cap
  FROM s LEFT JOIN f ON f.subject = s.next WHERE NOT ended),
e AS (SELECT s.*, s.kind = 'lies' OR (s.kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.subject = b.next)) AS enough
  FROM s LEFT JOIN s b ON b.query_id = s.query_id AND b.mode = s.mode AND b.iteration = s.iteration - 1 WHERE s.ended)
SELECT query_id, mode, CAST(iteration AS INT) AS iteration,
  CASE WHEN kind IS NULL THEN 'no_evidence' WHEN mode = 'silent' THEN 'no_llm' WHEN enough THEN 'sufficient_evidence' ELSE 'iteration_cap' END AS terminated_by,
  CASE WHEN kind IS NULL OR mode = 'silent' THEN 0.0 ELSE 1.0 END AS coverage, kind IS NULL OR mode = 'silent' OR first_kind = 'branch' AS needs_human FROM e
""")
def agent_hops(spark, sf_dir):
    """Every customer's region by hops: questions end by an answer, at once or later, by a query that was tried, by the cap, without
    evidence, and (silent) without a generator."""
    from tessera.plans import agent

    facts = materialize(_facts(spark, sf_dir), "facts")
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.format_string("Which region is %s in?", "c_name").alias("question"))

    def search(state, k):
        q = F.col("question")
        subject = F.when(q.startswith("Where is "), F.regexp_extract(q, r"^Where is (.+)\?$", 1)).otherwise(F.regexp_extract(q, r"(Customer#\d+)", 1))
        return state.select("query_id", subject.alias("subject")).join(facts, "subject").select("query_id", "chunk_id", "content", F.lit(1.0).alias("score"), F.lit("facts").alias("source_uri"), F.lit(1).alias("rank"))

    def broken(state, k):
        return search(state, k).withColumn("content", F.raise_error(F.lit("this search always fails")))

    doubt = lambda prompt: F.when(prompt.contains("branch"), "2").otherwise("9")
    searches = {"vector": search, "hybrid": search, "graph": search, "broken": broken}
    done = None
    for mode, cap, generator in (("answered", 3, models.generate(lambda: models.extractive_answer)), ("silent", 1, None)):
        rows = agent.run_agent(asked, searches, evaluator=_next_fact, generator=generator, verifier=doubt, max_iterations=cap, deadline_seconds=1e9)
        rows = rows.select("query_id", F.lit(mode).alias("mode"), "iteration", "terminated_by", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "needs_human")
        done = rows if done is None else done.unionByName(rows)
    return done


@query("""
WITH d AS (SELECT source, CAST(count(*) * 1000 AS DOUBLE) AS n FROM documents GROUP BY source), c AS (SELECT source, n * (15 * 500 * (1 + 0.12) / 300) AS chunks FROM d),
g AS (SELECT *, chunks * 768 * 4 / 1e9 AS raw, chunks * 2000 / 1e9 AS said FROM c)
SELECT source, CAST(round_even(chunks, 0) AS BIGINT) AS chunks, round_even(raw, 1) AS raw_vector_gb, round_even(raw * 2.6, 1) AS with_hnsw_gb, round_even(said, 1) AS text_metadata_gb, round_even(raw * 2.6 + said, 1) AS total_gb FROM g
""")
def capacity_estimates(spark, sf_dir):
    sized = _t(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") * 1000).alias("n"))
    return sized.select("source", *[c.alias(k) for k, c in scores.estimate_capacity(F.col("n")).items()])


@query(f"""
WITH k AS ({ORACLE_SQL["classify_rules"]}),
p(kind, transform, k, "rerank") AS (VALUES ('factual', NULL, 5, FALSE), ('conceptual', 'hyde', 12, TRUE), ('comparative', 'multi_query', 20, TRUE), ('relational', 'entities', 15, TRUE), ('aggregate', 'multi_query', 30, TRUE))
SELECT conv_id, turn, kind, transform, p.k, "rerank" FROM k JOIN p USING (kind)
""")
def question_policies(spark, sf_dir):
    """The users' questions with the policy of their kind."""
    kinds = _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", routing.classify("text").alias("kind"))
    return kinds.join(F.broadcast(routing.policies(spark)), "kind").select("conv_id", "turn", "kind", "transform", "k", "rerank")


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, CAST(least(4, count(*) FILTER (event_type = 'error') // 2) AS INTEGER) AS pressure FROM events GROUP BY 1)
SELECT hour, pressure, CASE WHEN pressure > 0 THEN '40' ELSE '100' END AS ef_search, CASE WHEN pressure > 1 THEN 'false' ELSE 'true' END AS "rerank", CASE WHEN pressure > 2 THEN '3' ELSE '5' END AS top_k,
  CASE WHEN pressure > 2 THEN '1200' ELSE '2400' END AS token_budget, CASE WHEN pressure > 3 THEN 'false' ELSE 'true' END AS "condense" FROM h
""")
def pressure_settings(spark, sf_dir):
    """The settings of each hour, whose pressure is half its errors."""
    hours = _t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.least(F.lit(4), F.floor(F.count_if(F.col("event_type") == "error") / 2)).cast("int").alias("pressure"))
    settings = F.create_map(*[F.lit(x) for x in ("ef_search", "100", "rerank", "true", "top_k", "5", "token_budget", "2400", "condense", "true")])
    rungs = hours.withColumn("c", reliability.degrade(settings, "pressure"))
    return rungs.select("hour", "pressure", *[F.col("c")[k].alias(k) for k in ("ef_search", "rerank", "top_k", "token_budget", "condense")])


_PATHS = "SELECT doc_id || '.txt' AS key, text FROM documents WHERE length(text) > 0"


@query(f"""
WITH RECURSIVE {_split_sql("k", _PATHS, 600, 72, chunking.SEPARATORS)}
SELECT key AS source_uri, CAST(position AS VARCHAR) AS position, 'four' AS chapter, 'hash' AS embed_model, sha256(key || '|' || position || '|' || content) AS content_hash, TRUE AS embedded FROM k
""")
def ingested_chunks(spark, sf_dir):
    """Documents through the ingestion plan into a store, twice: the second run refreshes what the first has written."""
    from tessera.plans import answering

    docs = _t(spark, sf_dir, "documents").select(F.format_string("in/%d.txt", "doc_id").alias("path"), "text")
    held = store.ChunkStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        answering.ingest(docs, held, models.hashed_embedding, tenant_id="t", chapter="four", embed_model="hash")
    held.drop_superseded()  # nothing reads the first run's snapshot any more
    store.assert_embedding_model(held.read("t"), "hash")
    return held.read("t", "four").select("source_uri", F.col("metadata")["chunk"].alias("position"), "chapter", "embed_model", "content_hash", (F.size("embedding") > 0).alias("embedded"))


@query(f"""
WITH {_BM25}, x AS (SELECT 'any term' AS strategy, query_id, score FROM r WHERE rank <= 8 UNION ALL SELECT 'all terms', query_id, score FROM a WHERE rank <= 8)
SELECT strategy, query_id, count(*) AS results, max(score) AS top_score FROM x GROUP BY strategy, query_id
""")
def strategies_compared(spark, sf_dir):
    from tessera.plans import answering

    questions, corpus = _lexical(spark, sf_dir)
    index = retrieval.question_postings(questions, corpus)
    found = {name: retrieval.lexical_search(questions, None, 8, all_terms=every, index=index) for name, every in (("any term", False), ("all terms", True))}
    return answering.compare(found)


_STATES = ORACLE_SQL["breaker_states"].strip()
_PASSED = "SELECT event_id, k, said AS state FROM s WHERE n > 0"
assert _STATES.endswith(_PASSED)


@query(_STATES.removesuffix(_PASSED) + "SELECT s.event_id, k, said AS state FROM s JOIN events USING (event_id) WHERE n > 0 AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 120000 FROM events)")
def breaker_stream(spark, sf_dir):
    """The events as a stream: the states of the calls that the watermark has passed, two minutes before the last one."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    folder = scratch_path(spark, "breaker-stream")
    schema = _t(spark, sf_dir, "events").schema
    try:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
        calls = events.select("event_id", (F.col("user_id") % 20).alias("k"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency_ms"))
        states = reliability.stream_states(calls, key="k", order="event_id")
        states.select("event_id", "k", "ts", "state").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    out = spark.read.parquet(f"{folder}/out")
    passed = _t(spark, sf_dir, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last"))
    return out.join(F.broadcast(passed)).where(F.unix_millis("ts") < F.col("last") - 120000).select("event_id", "k", "state")


@query(f"SELECT round(count(h.query_id) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN ({ORACLE_SQL['semantic_cache_hits']}) h ON h.query_id = q.vec_id")
def cache_hit_rate(spark, sf_dir):
    from tessera.plans.registry import _vectors

    asked, rows = _vectors(spark, sf_dir)
    version = F.lit("v1").alias("corpus_version")
    entries = rows.select("tenant_id", version, F.col("chunk_id").alias("seq"), F.col("embedding").alias("vector"))
    hits = reliability.cached_answers(asked.select("query_id", "qvec", "tenant_id", version), entries, 0.3, own="query_id")
    return reliability.hit_rate(asked.select("query_id").join(hits, "query_id", "left")).select(F.round("hit_rate", 6).alias("hit_rate"))


# Entities by the length of what a model is asked; so a window's reply follows from its length.
_ASKED = len(tx.TEMPLATES["extract"].replace("{{", "{").replace("}}", "}").replace("{text}", ""))


def _lengths_reply(prompt):
    n = F.length(prompt)
    node, hub = F.concat(F.lit("Node "), n % 97), F.concat(F.lit("Hub "), n % 11)
    return F.format_string(
        '{"entities": [{"name": "%s", "type": "Concept", "confidence": 0.9}, {"name": "%s", "type": "Project"}], "relationships": [{"source": "%s", "target": "%s", "type": "part of", "confidence": 0.8, "evidence": "e"}]}',
        node, hub, node, hub,
    )


@query(f"""
WITH k AS (SELECT source AS source_uri, {_ASKED} + length(substring(text, s + 1, 2700)) AS n FROM (SELECT source, text, unnest(range(0, greatest(length(text), 1), 2400)) AS s FROM documents WHERE text IS NOT NULL)
  WHERE trim(substring(text, s + 1, 2700), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
SELECT DISTINCT 'node ' || n % 97 AS src, 'hub ' || n % 11 AS dst, 'PART_OF' AS rel_type, source_uri FROM k
""")
def built_graph(spark, sf_dir):
    """Documents through the graph plan: windows, replies, extraction, merges."""
    from tessera.plans import answering

    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("source_uri"), "text")
    _, edges, _ = answering.build_graph(docs, _lengths_reply, tenant_id="t", chapter="eight", size=2700, overlap=300)
    return edges.select("src", "dst", "rel_type", "source_uri")


_VARIANTS = "(SELECT item_id * 4 + v AS item_id, CASE v WHEN 0 THEN text WHEN 1 THEN substring(text, length(text) // 2 + 1) WHEN 2 THEN left(text, length(text) // 2) ELSE reverse(text) END AS text FROM benchmark, range(4) t(v))"


@query(f"""
WITH {_BM25.replace("FROM benchmark", f"FROM {_VARIANTS}")},
v AS (SELECT query_id // 4 AS query_id, query_id % 4 AS branch, chunk_id, rank FROM r WHERE rank <= 10),
g AS (SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS raw, min({{'branch': branch, 'rank': rank}}) AS seen FROM v GROUP BY ALL),
h AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM h)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 5
""")
def multi_query(spark, sf_dir):
    """Each question, its halves and its letters in reverse, searched side by side and fused."""
    questions, corpus = _lexical(spark, sf_dir)
    said = [F.col("question"), F.expr("substring(question, length(question) div 2 + 1)"), F.expr("left(question, length(question) div 2)"), F.reverse("question")]
    variants = questions.select("query_id", F.posexplode(F.array(*said)).alias("variant", "question"))
    numbered = variants.select((F.col("query_id") * 4 + F.col("variant")).alias("query_id"), "question")
    index = retrieval.question_postings(numbered, corpus)
    found = retrieval.multi_query_search(variants, lambda q, k: retrieval.lexical_search(q, None, k, all_terms=False, index=index), 5)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))
