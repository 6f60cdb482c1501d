"""Every query of the engine over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scores, text as tx, vectors
from tessera.operators import ann, chunking, context, graph, metrics, rerank, retrieval, routing, store, text_index
from tessera.scratch import scratch_path
from tessera.sources import loaders
from tessera.streaming import reliability

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors. Questions are the vectors whose id is divisible by 100; labels are tenants.
def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("tenant_id"))
    return rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"), "tenant_id"), rows


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
_DENSE = """
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({cos}, 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s {where})
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k}
"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


@query(_DENSE.format(cos=_COSINE, on="", where="", k=5))
def dense_topk(spark, sf_dir):
    return _ranked(retrieval.dense_search(*_vectors(spark, sf_dir), 5))


@query(_DENSE.format(cos=_COSINE, on="AND q.label = c.label", where="", k=5))
def dense_topk_filtered(spark, sf_dir):
    return _ranked(retrieval.dense_search(*_vectors(spark, sf_dir), 5, tenant=True))


@query(_DENSE.format(cos=_COSINE, on="", where="WHERE score >= 0.2", k=10))
def dense_floor(spark, sf_dir):
    return _ranked(retrieval.dense_search(*_vectors(spark, sf_dir), 10, min_score=0.2))


@query(_DENSE.format(cos=_COSINE, on="", where="", k=3).replace("WHERE rank", "WHERE score >= 0.3 AND rank"))
def dense_floor_after_topk(spark, sf_dir):
    return _ranked(retrieval.dense_search(*_vectors(spark, sf_dir), 3).where("score >= 0.3"))


@query()
def dense_ivf(spark, sf_dir):
    """Approximate search; tests hold its recall against dense_topk."""
    return _ranked(retrieval.ivf_search(*_vectors(spark, sf_dir), 5))


@query()
def dense_pq(spark, sf_dir):
    """Approximate search over a stored index, written here; tests hold its recall and what it reads against dense_topk."""
    queries, rows = _vectors(spark, sf_dir)
    return _ranked(ann.build_index(rows, scratch_path(spark, "dense-pq")).search(queries, 5))


@query(
    "SELECT vec_id, round(list_sum(list_transform(e, lambda x: CAST(CAST(x / n AS FLOAT) AS DOUBLE))), 4) AS unit_sum FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,"
    " sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)"
)
def l2_normalize(spark, sf_dir):
    unit = _t(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize("embedding").alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("unit_sum"))


@query(
    "WITH c AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM c WHERE vec_id % 100 = 0)"
    " SELECT q.vec_id AS query_id, min(c.vec_id) AS seq FROM q JOIN c ON q.label = c.label AND c.vec_id <> q.vec_id WHERE round(list_cosine_similarity(q.e, c.e), 6) >= 0.3 GROUP BY q.vec_id"
)
def semantic_cache_hits(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    version = F.lit("v1").alias("corpus_version")
    entries = rows.select("tenant_id", version, F.col("chunk_id").alias("seq"), F.col("embedding").alias("vector"))
    return reliability.cached_answers(asked.select("query_id", "qvec", "tenant_id", version), entries, 0.3, own="query_id")


# Hashes and chunks.
@query("SELECT doc_id, sha256(source || '|0|' || text) AS content_hash, substring(sha256(source || '|0|' || text), 1, 24) AS stable_id FROM documents")
def content_hash(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").withColumn("position", F.lit(0))
    return rows.select("doc_id", scores.content_hash("source", "position", "text").alias("content_hash"), scores.stable_id("source", "position", "text").alias("stable_id"))


_FIXED = "SELECT doc_id, CAST(s / 450 AS BIGINT) AS position, substring(text, s + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(length(text) - 51, 0) + 1 AS BIGINT), 450)) AS s FROM documents WHERE length(text) > 0)"


@query(f"SELECT doc_id, position, length(content) AS n_chars, sha256(content) AS h FROM ({_FIXED})")
def fixed_chunks(spark, sf_dir):
    chunks = chunking.fixed_size(_t(spark, sf_dir, "documents"))
    return chunks.select("doc_id", F.col("position").cast("long").alias("position"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("h"))


@query(
    "SELECT doc_id, CAST(s / 2700 AS BIGINT) AS position, sha256(substring(text, s + 1, 3000)) AS h FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(length(text), 1) AS BIGINT), 2700)) AS s FROM documents WHERE text IS NOT NULL)"
    " WHERE trim(substring(text, s + 1, 3000), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"
)
def kg_windows(spark, sf_dir):
    return chunking.covering_windows(_t(spark, sf_dir, "documents")).select("doc_id", F.col("position").cast("long").alias("position"), F.sha2("content", 256).alias("h"))


@query(
    f"SELECT doc_id, count(*) AS chunks, round(avg(n), 4) AS avg_chars, min(n) AS min_chars, max(n) AS max_chars, CAST(sum(n) AS BIGINT) AS total_chars, round(stddev_pop(n), 4) AS std_chars FROM (SELECT doc_id, length(content) AS n FROM ({_FIXED})) GROUP BY doc_id"
)
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.fixed_size(_t(spark, sf_dir, "documents")), "doc_id").withColumns({c: F.round(c, 4) for c in ("avg_chars", "std_chars")})


@query(f"""
WITH c AS (SELECT doc_id, position, list_distinct(list_filter(string_split_regex(lower(content), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS t FROM ({_FIXED})),
p AS (SELECT doc_id, t, lag(t) OVER (PARTITION BY doc_id ORDER BY position) AS b FROM c),
j AS (SELECT doc_id, CASE WHEN len(t) = 0 OR len(b) = 0 THEN 0.0 ELSE CAST(len(list_intersect(t, b)) AS DOUBLE) / len(list_distinct(list_concat(t, b))) END AS j FROM p WHERE b IS NOT NULL)
SELECT d.doc_id, round(coalesce(avg(CASE WHEN j >= 0.4 THEN 1.0 WHEN j IS NOT NULL THEN 0.0 END), 0.0), 6) AS overlap_ratio FROM (SELECT DISTINCT doc_id FROM c) d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
""")
def overlap_ratio(spark, sf_dir):
    return chunking.overlap_ratio(chunking.fixed_size(_t(spark, sf_dir, "documents"))).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


# The stand-in embedder over tw(side, id, term): CRC-32 of a term, byte by byte by the table of its polynomial, then counts per place
# at unit length.
_HASHED = """
ct AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
th AS (SELECT term, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(term, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(ct.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {dim} AS place
  FROM (SELECT DISTINCT term FROM tw), ct),
tc AS (SELECT side, id, place, CAST(count(*) AS DOUBLE) AS c FROM tw JOIN th USING (term) GROUP BY ALL),
tn AS (SELECT side, id, CAST(CAST(sqrt(sum(c * c)) AS FLOAT) AS DOUBLE) AS size FROM tc GROUP BY ALL),
tv AS (SELECT side, id, place, CAST(CAST(c / size AS FLOAT) AS DOUBLE) AS v FROM tc JOIN tn USING (side, id))
"""


def _digest(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.select(*keys, F.col("position").cast("long").alias("position"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("h"))


def _split_sql(name: str, rows: str, size: int, overlap: int, separators: list[str]) -> str:
    """CTEs up to {name}(key, position, content): the recursive splitter over rows(key, text), which are not empty.

    Texts are split level by level, and runs of short pieces merged by a fold over the places where their windows begin.
    """
    listed = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in separators) + "]"
    cut = "list_filter(range(1, len({0}) + 1), lambda i: i >= {1} AND ({0}[i] = '' OR contains({2}, {0}[i])))[1]".format(listed, "{lev}", "{text}")
    split = f"CASE WHEN {listed}[sep] = '' THEN list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1)) ELSE list_filter(list_transform(string_split(text, {listed}[sep]), lambda x, i: CASE WHEN i > 1 THEN {listed}[sep] || x ELSE x END), lambda x: x <> '') END"
    strip = lambda x: f"regexp_replace({x}, '^[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+|[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+$', '', 'g')"
    over = f"cs[y.i + 1] - cs[z.start] > {size} AND y.i > z.start"
    return f"""
{name}_n AS (
  SELECT key, CAST([] AS BIGINT[]) AS path, text, {cut.format(lev=1, text="text")} AS sep, TRUE AS long FROM ({rows})
  UNION ALL
  SELECT key, list_append(path, i), x, CASE WHEN length(x) >= {size} AND sep < {len(separators)} THEN {cut.format(lev="sep + 1", text="x")} END, length(x) >= {size}
  FROM (SELECT key, path, sep, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM (SELECT key, path, sep, {split} AS p FROM {name}_n WHERE sep IS NOT NULL))),
{name}_p AS (SELECT key, path[:-2] AS above, path[-1] AS i, text, long, count(*) FILTER (long) OVER (PARTITION BY key, path[:-2] ORDER BY path[-1]) AS run FROM {name}_n WHERE len(path) > 0),
{name}_r AS (SELECT key, list_append(above, min(i)) AS path, list(text ORDER BY i) AS p FROM {name}_p WHERE NOT long GROUP BY key, above, run),
{name}_c AS (SELECT *, list_transform(range(0, len(p) + 1), lambda j: coalesce(list_sum(list_transform(p[:j], lambda x: length(x))), 0)) AS cs FROM {name}_r),
{name}_w AS (SELECT key, path, p, list_reduce(list_prepend({{'i': CAST(0 AS BIGINT), 'start': CAST(1 AS BIGINT), 'outs': CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}},
  list_transform(range(1, len(p) + 1), lambda i: {{'i': i, 'start': CAST(1 AS BIGINT), 'outs': CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}})), lambda z, y: {{'i': y.i,
  'start': CASE WHEN {over} THEN list_filter(range(z.start, y.i + 1), lambda k: cs[y.i] - cs[k] <= {overlap} AND (cs[y.i + 1] - cs[k] <= {size} OR k = y.i))[1] ELSE z.start END,
  'outs': CASE WHEN {over} THEN list_append(z.outs, {{'s': z.start, 'e': y.i - 1}}) ELSE z.outs END}}) AS f FROM {name}_c),
{name}_o AS (
  SELECT key, path, j, {strip("array_to_string(p[o.s:o.e], '')")} AS content FROM (SELECT key, path, p, unnest(a) AS o, unnest(range(len(a))) AS j FROM (SELECT key, path, p, list_append(f.outs, {{'s': f.start, 'e': len(p)}}) AS a FROM {name}_w))
  UNION ALL SELECT key, path, 0, text FROM {name}_n WHERE long AND sep IS NULL AND len(path) > 0),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY path, j) - 1 AS position, content FROM {name}_o WHERE content <> '' )"""


_TEXTS = "SELECT doc_id AS key, text FROM documents WHERE length(text) > 0"


@query(f"WITH RECURSIVE {_split_sql('k', _TEXTS, 600, 72, chunking.SEPARATORS)} SELECT key AS doc_id, CAST(position AS BIGINT) AS position, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS h FROM k")
def recursive_chunks(spark, sf_dir):
    return _digest(chunking.recursive(_t(spark, sf_dir, "documents"), 600, 72), "doc_id")


@query(f"""
WITH RECURSIVE {_split_sql("a", _TEXTS, 2000, 0, chunking.SEPARATORS)},
b AS (SELECT key AS doc_id, substring(sha256(key || '|' || position || '|' || content), 1, 24) AS parent_id, content FROM a),
{_split_sql("k", "SELECT {'d': doc_id, 'p': parent_id} AS key, content AS text FROM b", 400, 60, chunking.CHILD_SEPARATORS)}
SELECT key.d AS doc_id, key.p AS parent_id, substring(sha256(key.d || '|' || position || '|' || content), 1, 24) AS child_id, CAST(position AS BIGINT) AS position, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS h FROM k
""")
def parent_child(spark, sf_dir):
    _, children = chunking.parent_child(_t(spark, sf_dir, "documents"))
    return _digest(children, "doc_id", "parent_id", "child_id")


_WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"


@query(f"""
WITH RECURSIVE h AS (SELECT doc_id, string_split(regexp_replace('# ' || source || chr(10) || chr(10) || text, '(?m)^(#{{1,6}}){_WS}+(.*)$', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1))[2:] AS a FROM documents),
e AS (SELECT doc_id, list_transform(a, lambda x: {{'lev': CAST(strpos(x, chr(2)) - 1 AS BIGINT), 'title': regexp_replace(string_split(string_split(x, chr(2))[2], chr(3))[1], '^{_WS}+|{_WS}+$', '', 'g'), 'trail': CAST([] AS VARCHAR[])}}) AS t,
  list_transform(a, lambda x: regexp_replace(substr(x, strpos(x, chr(3)) + 1), '^{_WS}+|{_WS}+$', '', 'g')) AS bodies FROM h),
s AS (SELECT doc_id, i, bodies[i] AS body, array_to_string(list_reduce(list_prepend({{'lev': CAST(0 AS BIGINT), 'title': '', 'trail': CAST([] AS VARCHAR[])}}, t[:i]),
  lambda z, y: {{'lev': y.lev, 'title': y.title, 'trail': list_append(z.trail[:y.lev - 1], y.title)}}).trail, ' > ') AS head FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM e)),
{_split_sql("k", "SELECT {'d': doc_id, 'i': i} AS key, body AS text FROM s WHERE body <> ''", 1200, 120, chunking.SEPARATORS)},
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, position) - 1 AS position, head || chr(10) || content AS content FROM k JOIN s ON key.d = doc_id AND key.i = i)
SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS h FROM c
""")
def structure_chunks(spark, sf_dir):
    """Documents as Markdown: each gets a heading of its source."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("text"))
    return _digest(chunking.by_structure(docs), "doc_id")


@query(f"""
WITH x AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])[\\x09-\\x0d\\x{{85}}\\p{{Z}}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda y: trim(y) <> '') AS a FROM documents),
s AS (SELECT doc_id, len(a) AS n, unnest(a) AS s, unnest(range(len(a))) AS i FROM x),
tw AS (SELECT doc_id AS side, i AS id, unnest(regexp_extract_all(lower(s), '([a-z0-9]+)', 1)) AS term FROM s), {_HASHED.format(dim=16)},
v AS (SELECT side, id, map_from_entries(list((place, v))) AS m FROM tv GROUP BY ALL),
e AS (SELECT doc_id, n, s, i, list_transform(range(16), lambda p: coalesce(m[p], CAST(0 AS DOUBLE))) AS v, m IS NULL AS none FROM s LEFT JOIN v ON side = doc_id AND id = i),
g AS (SELECT *, lag(v) OVER o AS b, lag(none) OVER o AS bare FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, n, s, i, CASE WHEN i > 0 THEN 1 - CASE WHEN none OR bare THEN 0 ELSE list_cosine_similarity(v, b) END END AS d FROM g),
l AS (SELECT doc_id, list(d ORDER BY d) AS ds, CAST(0.85 AS DOUBLE) * (count(d) - 1) AS place FROM p WHERE d IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN ds[CAST(floor(place) AS INT) + 1] = ds[CAST(ceil(place) AS INT) + 1] THEN ds[CAST(floor(place) AS INT) + 1]
  ELSE (ceil(place) - place) * ds[CAST(floor(place) AS INT) + 1] + (place - floor(place)) * ds[CAST(ceil(place) AS INT) + 1] END AS t FROM l),
f AS (SELECT doc_id, list({{'cuts': CAST([] AS BIGINT[]), 'size': CAST(-1 AS BIGINT), 'len': length(s), 'far': coalesce(d > t, FALSE), 'n': n, 'i': i}} ORDER BY i) AS a FROM p LEFT JOIN t USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, list_reduce(list_prepend(a[1], a), lambda z, y: {{
  'cuts': CASE WHEN z.size >= 0 AND y.n >= 3 AND ((y.far AND z.size >= 200) OR z.size + y.len > 1500) THEN list_append(z.cuts, y.i) ELSE z.cuts END,
  'size': CASE WHEN z.size < 0 OR (y.n >= 3 AND ((y.far AND z.size >= 200) OR z.size + y.len > 1500)) THEN y.len ELSE z.size + y.len + 1 END,
  'len': y.len, 'far': y.far, 'n': y.n, 'i': y.i}}).cuts AS cuts FROM f),
k AS (SELECT s.doc_id, len(list_filter(cuts, lambda y: y <= i)) AS position, string_agg(s, ' ' ORDER BY i) AS content FROM s JOIN c ON s.doc_id = c.doc_id GROUP BY ALL)
SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS h FROM k
""")
def semantic_chunks(spark, sf_dir):
    from tessera.operators.models import hashed_embedding

    return _digest(chunking.semantic(_t(spark, sf_dir, "documents"), lambda c: hashed_embedding(c, 16)), "doc_id")


# Text.
@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h
FROM documents WHERE lang = 'en'
""")
def clean_text_ascii(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.sha2(tx.clean_text("text", compose=False), 256).alias("h"))


@query()
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.clean_text("text"), 256).alias("h"))


@query("SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.sum(tx.estimate_tokens("text")).alias("tokens"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title FROM pages")
def html_title(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", (loaders.html_text("html")["title"] != "").alias("has_title"))


@query()
def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(loaders.html_text("html")["text"], 256).alias("h"))


@query(
    "SELECT n_regionkey, 'Table with columns: n_nationkey, n_name.' || chr(10) || string_agg('n_nationkey: ' || n_nationkey || '; n_name: ' || trim(n_name), chr(10) ORDER BY n_nationkey) AS text, count(*) AS row_count FROM nation GROUP BY n_regionkey"
)
def csv_serialize(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return loaders.csv_text(rows, F.col("n_nationkey"), ["n_regionkey"]).select("n_regionkey", "text", "row_count")


@query(r"SELECT doc_id, trim(regexp_extract('intro' || chr(10) || '# ' || source || chr(10) || text, '(?m)^# (.*)$', 1)) AS title FROM documents")
def markdown_title(spark, sf_dir):
    said = F.concat(F.lit("intro\n# "), "source", F.lit("\n"), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", loaders.markdown_title(said).alias("title"))


_CANON = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\b(inc|llc|ltd|limited|corp|corporation|gmbh|s\.a\.|plc|co)\b\.?', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT s_suppkey, {_CANON.format('s_name')} AS canonical_name FROM supplier")
def canonicalize(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", tx.canonicalize("s_name").alias("canonical_name"))


@query(f"WITH n AS (SELECT n_nationkey, {_CANON.format('n_name')} AS k FROM nation), a AS (SELECT {_CANON.format('r_name')} AS t, r_regionkey FROM region) SELECT n.n_nationkey, coalesce(a.t, n.k) AS resolved FROM n LEFT JOIN a ON n.n_nationkey = a.r_regionkey")
def alias_resolve(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    aliases = nation.join(_t(spark, sf_dir, "region"), F.col("n_nationkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("target"))
    return tx.resolve_aliases(nation.select("n_nationkey", F.col("n_name").alias("name")), aliases).select("n_nationkey", "resolved")


# Lexical search and fusion. The benchmark items are the questions, documents the corpus.
def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    questions = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    corpus = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("source_uri"))
    return questions, corpus


_STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "]"
_BM25 = f"""
q AS (SELECT item_id AS query_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)), lambda x: NOT list_contains({_STOP}, x))) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents),
s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
p AS (SELECT doc_id, term, size, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term, len(t) AS size FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.doc_id, p.term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS w FROM p JOIN f USING (term), s),
b AS (SELECT q.query_id, w.doc_id AS chunk_id, round(sum(CAST(w AS DOUBLE)), 6) AS score, count(*) AS hits FROM q JOIN w USING (term) GROUP BY q.query_id, w.doc_id),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b),
a AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b JOIN n USING (query_id) WHERE hits = n_terms)
"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _hits(retrieval.lexical_search(*_lexical(spark, sf_dir), 10, all_terms=False))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score FROM a WHERE rank <= 5")
def lexical_and_match(spark, sf_dir):
    return _hits(retrieval.lexical_search(*_lexical(spark, sf_dir), 5))


@query(f"""
WITH {_BM25},
o AS (SELECT x.query_id, x.chunk_id, x.p, q.term FROM (SELECT a.query_id, a.chunk_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS p FROM a JOIN d ON d.doc_id = a.chunk_id) x JOIN q ON q.query_id = x.query_id AND q.term = x.term),
l AS (SELECT x.query_id, x.chunk_id, x.p, y.term, max(y.p) AS last FROM o x JOIN o y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id AND y.p <= x.p GROUP BY ALL),
c AS (SELECT query_id, chunk_id, p, min(last) AS first FROM l JOIN n USING (query_id) GROUP BY query_id, chunk_id, p, n_terms HAVING count(*) = n_terms),
e AS (SELECT query_id, chunk_id, first, min(p) AS p FROM c GROUP BY ALL),
z AS (SELECT query_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (p - first + 1)), 6) AS score FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM z)
SELECT query_id, chunk_id, score FROM k WHERE place <= 5
""")
def lexical_cover_density(spark, sf_dir):
    return _hits(retrieval.cover_density(*_lexical(spark, sf_dir), 5))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, text_index.TextIndex]:
    """The questions, and an index of the whole corpus in a new folder."""
    questions, corpus = _lexical(spark, sf_dir)
    return questions, text_index.build_index(corpus, scratch_path(spark, "text-index"))


@query(ORACLE_SQL["bm25_topk"])
def stored_bm25(spark, sf_dir):
    questions, index = _stored(spark, sf_dir)
    return _hits(index.search(questions, 10, all_terms=False))


@query(ORACLE_SQL["lexical_and_match"])
def stored_and_match(spark, sf_dir):
    questions, index = _stored(spark, sf_dir)
    return _hits(index.search(questions, 5))


@query(ORACLE_SQL["lexical_cover_density"])
def stored_cover_density(spark, sf_dir):
    questions, index = _stored(spark, sf_dir)
    return _hits(index.cover_density(questions, 5))


@query(f"WITH {_BM25}, top AS (SELECT * FROM r WHERE rank <= 10) SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS max_scaled, round(CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1.0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END, 4) AS min_max_scaled FROM top")
def score_normalize(spark, sf_dir):
    found = retrieval.lexical_search(*_lexical(spark, sf_dir), 10, all_terms=False)
    both = scores.min_max_scale(found.withColumn("m", F.col("score")), score="m")
    return scores.max_scale(both).select("query_id", "chunk_id", F.round("score", 4).alias("max_scaled"), F.round("m", 4).alias("min_max_scaled"))


_RRF = """
, u AS (SELECT query_id, chunk_id, rank, 0 AS branch, CAST({a} AS DOUBLE) AS wt FROM r WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1, CAST({b} AS DOUBLE) FROM a WHERE rank <= 20),
x AS (SELECT query_id, chunk_id, sum(wt / (60 + rank)) AS raw, min(branch * 1000 + rank) AS seen FROM u GROUP BY query_id, chunk_id),
y AS (SELECT query_id, chunk_id, seen, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM x),
z AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM y)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM z WHERE rank <= 5
"""


def _two_rankings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    questions, corpus = _lexical(spark, sf_dir)
    index = retrieval.question_postings(questions, corpus)
    return [retrieval.lexical_search(questions, None, 20, all_terms=a, index=index) for a in (False, True)]


@query(f"WITH {_BM25} {_RRF.format(a=1, b=1)}")
def rrf_equal(spark, sf_dir):
    return _ranked(retrieval.fuse(_two_rankings(spark, sf_dir), None, 60, 5))


@query(f"WITH {_BM25} {_RRF.format(a=0.6, b=0.4)}")
def rrf_weighted(spark, sf_dir):
    return _ranked(retrieval.fuse(_two_rankings(spark, sf_dir), [0.6, 0.4], 60, 5))


_DENSE_RANKS = f"""
tw AS (SELECT 0 AS side, item_id AS id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM benchmark UNION ALL SELECT 1, doc_id, unnest(t) FROM d), {_HASHED.format(dim=64)},
tl AS (SELECT side, id, sqrt(sum(v * v)) AS size FROM tv GROUP BY ALL),
dv AS (SELECT x.id AS query_id, y.id AS chunk_id, sum(x.v * y.v) AS dot FROM tv x JOIN tv y ON x.side = 0 AND y.side = 1 AND x.place = y.place GROUP BY ALL),
ds AS (SELECT b.item_id AS query_id, doc_id AS chunk_id, round(coalesce(dot / (x.size * y.size), 0), 6) AS score FROM benchmark b CROSS JOIN documents
  LEFT JOIN dv ON dv.query_id = b.item_id AND dv.chunk_id = doc_id LEFT JOIN tl x ON x.side = 0 AND x.id = b.item_id LEFT JOIN tl y ON y.side = 1 AND y.id = doc_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)
"""



@query(f"WITH {_BM25}, {_DENSE_RANKS} {_RRF.format(a=0.6, b=0.4).replace('FROM r WHERE', 'FROM dr WHERE')}")
def hybrid_search(spark, sf_dir):
    from tessera.operators.models import hashed_embedding

    questions, corpus = _lexical(spark, sf_dir)
    embedded = corpus.withColumn("embedding", hashed_embedding("content"))
    return _ranked(retrieval.hybrid_search(questions.withColumn("qvec", hashed_embedding("question")), embedded, 5))


@query(f"WITH {_BM25}, s1 AS (SELECT * FROM a WHERE rank <= 5), ok AS (SELECT DISTINCT query_id FROM s1 WHERE score >= 5) SELECT query_id, chunk_id, score, 0 AS stage FROM s1 WHERE score >= 5 UNION ALL SELECT query_id, chunk_id, score, 1 FROM r WHERE rank <= 3 AND score >= 5 AND query_id NOT IN (SELECT query_id FROM ok)")
def fallback_chain(spark, sf_dir):
    questions, corpus = _lexical(spark, sf_dir)
    index = retrieval.question_postings(questions, corpus)
    stages = [retrieval.lexical_search(questions, None, 5, index=index), retrieval.lexical_search(questions, None, 3, all_terms=False, index=index)]
    return retrieval.fallback(stages, questions, min_score=5).select("query_id", "chunk_id", "score", "stage")


# Reranking, context and citations over the ten best rows of each question.
def _results(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    questions, corpus = _lexical(spark, sf_dir)
    found = retrieval.lexical_search(questions, corpus, k, all_terms=False)
    return found.join(corpus, "chunk_id").withColumn("retriever", F.lit("lexical"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower(d.text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(f"""
WITH RECURSIVE {_BM25},
i AS (SELECT r.query_id, r.rank, r.chunk_id, r.score / max(r.score) OVER (PARTITION BY r.query_id) AS score, {_WORDS} AS t FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10),
e AS (SELECT x.query_id, x.rank, x.score, list(CASE WHEN len(x.t) > 0 AND len(y.t) > 0 THEN CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / len(list_distinct(list_concat(x.t, y.t))) ELSE 0 END ORDER BY y.rank) AS sims
  FROM i x JOIN i y ON x.query_id = y.query_id GROUP BY x.query_id, x.rank, x.score),
g AS (SELECT query_id, list({{'rank': rank, 'score': score, 'sims': sims}} ORDER BY rank) AS c FROM e GROUP BY query_id),
picks AS (
  SELECT query_id, c, 1 AS step, [CAST(1 AS BIGINT)] AS chosen FROM g
  UNION ALL
  SELECT query_id, c, step + 1, list_append(chosen, rem[list_position(vals, list_max(vals))].rank) FROM (
    SELECT *, list_transform(rem, lambda x: CAST(0.7 AS DOUBLE) * x.score - CAST(0.3 AS DOUBLE) * list_max(list_transform(chosen, lambda k: x.sims[k]))) AS vals FROM (
      SELECT *, list_filter(c, lambda x: NOT list_contains(chosen, x.rank)) AS rem FROM picks WHERE step < least(5, len(c))))),
z AS (SELECT query_id, arg_max(chosen, step) AS chosen FROM picks GROUP BY query_id),
u AS (SELECT query_id, unnest(chosen) AS rank, unnest(range(1, len(chosen) + 1)) AS pick FROM z)
SELECT u.query_id, i.chunk_id, CAST(u.pick AS INT) AS pick FROM u JOIN i ON i.query_id = u.query_id AND i.rank = u.rank
""")
def mmr(spark, sf_dir):
    return rerank.diversify(scores.max_scale(_results(spark, sf_dir)))


_TOKENS = _WORDS


@query(f"""
WITH RECURSIVE {_BM25},
i AS (SELECT r.query_id, r.rank, r.chunk_id, {_TOKENS} AS t FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10),
pr AS (SELECT x.query_id, x.rank AS hi, y.rank AS lo FROM i x JOIN i y ON x.query_id = y.query_id AND y.rank < x.rank WHERE len(x.t) > 0 AND len(y.t) > 0 AND CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / len(list_distinct(list_concat(x.t, y.t))) >= 0.75),
near AS (SELECT query_id, hi, list(lo) AS los FROM pr GROUP BY query_id, hi),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM i)
  UNION ALL
  SELECT f.query_id, i.rank, CASE WHEN n.los IS NOT NULL AND len(list_intersect(n.los, f.kept)) > 0 THEN f.kept ELSE list_append(f.kept, i.rank) END
  FROM fold f JOIN i ON i.query_id = f.query_id AND i.rank = f.pos + 1 LEFT JOIN near n ON n.query_id = i.query_id AND n.hi = i.rank),
fin AS (SELECT query_id, arg_max(kept, pos) AS kept FROM fold GROUP BY query_id)
SELECT i.query_id, i.chunk_id, CAST(i.rank AS INT) AS rank FROM i JOIN fin USING (query_id) WHERE list_contains(fin.kept, i.rank)
""")
def greedy_dedupe(spark, sf_dir):
    return rerank.deduplicate(_results(spark, sf_dir)).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


@query(f"""
WITH RECURSIVE {_BM25},
i AS (SELECT r.query_id, r.rank, r.chunk_id, CAST(greatest(1, length(d.text) // 4) + 20 AS BIGINT) AS cost FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS chunk_id, FALSE AS taken FROM (SELECT DISTINCT query_id FROM i)
  UNION ALL
  SELECT f.query_id, i.rank, CASE WHEN f.spent + i.cost <= 1200 THEN f.spent + i.cost ELSE f.spent END, i.chunk_id, f.spent + i.cost <= 1200 FROM fold f JOIN i ON i.query_id = f.query_id AND i.rank = f.pos + 1)
SELECT query_id, chunk_id, spent FROM fold WHERE taken
""")
def token_budget(spark, sf_dir):
    return context.pack_budget(_results(spark, sf_dir), 1200)


@query(f"WITH {_BM25}, t AS (SELECT query_id, chunk_id, rank, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 7) SELECT query_id, chunk_id, CAST(CASE WHEN n > 2 AND rank = 2 THEN n WHEN n > 2 AND rank > 2 THEN rank - 1 ELSE rank END AS BIGINT) AS place FROM t")
def edge_placement(spark, sf_dir):
    found = retrieval.lexical_search(*_lexical(spark, sf_dir), 7, all_terms=False).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return found.select("query_id", "chunk_id", context.edge_position("rank", "n").cast("long").alias("place"))


@query(f"""
WITH RECURSIVE {_BM25},
i AS (SELECT r.query_id, r.rank, r.chunk_id, d.text, d.source, CAST(greatest(1, length(d.text) // 4) + 20 AS BIGINT) AS cost, {_TOKENS} AS t FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10),
pr AS (SELECT x.query_id, x.rank AS hi, y.rank AS lo FROM i x JOIN i y ON x.query_id = y.query_id AND y.rank < x.rank WHERE len(x.t) > 0 AND len(y.t) > 0 AND CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / len(list_distinct(list_concat(x.t, y.t))) >= 0.75),
near AS (SELECT query_id, hi, list(lo) AS los FROM pr GROUP BY query_id, hi),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT query_id FROM i)
  UNION ALL
  SELECT f.query_id, i.rank, CASE WHEN n.los IS NOT NULL AND len(list_intersect(n.los, f.held)) > 0 THEN f.held ELSE list_append(f.held, i.rank) END
  FROM fold f JOIN i ON i.query_id = f.query_id AND i.rank = f.pos + 1 LEFT JOIN near n ON n.query_id = i.query_id AND n.hi = i.rank),
fin AS (SELECT query_id, arg_max(held, pos) AS held FROM fold GROUP BY query_id),
k AS (SELECT i.*, row_number() OVER (PARTITION BY i.query_id ORDER BY i.rank) AS pos FROM i JOIN fin USING (query_id) WHERE list_contains(fin.held, i.rank)),
pack AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS spent, CAST([] AS BIGINT[]) AS got FROM (SELECT DISTINCT query_id FROM k)
  UNION ALL
  SELECT p.query_id, k.pos, CASE WHEN p.spent + k.cost <= 2400 THEN p.spent + k.cost ELSE p.spent END, CASE WHEN p.spent + k.cost <= 2400 THEN list_append(p.got, k.pos) ELSE p.got END
  FROM pack p JOIN k ON k.query_id = p.query_id AND k.pos = p.pos + 1),
adm AS (SELECT query_id, arg_max(got, pos) AS got FROM pack GROUP BY query_id),
num AS (SELECT k.*, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS o, count(*) OVER (PARTITION BY k.query_id) AS n FROM k JOIN adm USING (query_id) WHERE list_contains(adm.got, k.pos)),
pl AS (SELECT *, CASE WHEN n > 2 AND o = 2 THEN n WHEN n > 2 AND o > 2 THEN o - 1 ELSE o END AS place FROM num)
SELECT query_id, sha256(string_agg('[' || place || '] (source: ' || coalesce(source, '') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY place)) AS h, CAST(count(*) AS INT) AS n_admitted FROM pl GROUP BY query_id
""")
def context_build(spark, sf_dir):
    return context.build_context(_results(spark, sf_dir)).select("query_id", F.sha2("context", 256).alias("h"), F.size("admitted").alias("n_admitted"))


@query(r"""
WITH a AS (SELECT conv_id, turn, regexp_replace(text, '\.( |\n|$)', ' [' || (turn % 4) || '].\1', 'g') AS t FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0 UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND turn % 3 = 0),
s AS (SELECT conv_id, turn, t, list_filter(string_split(regexp_replace(trim(t), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM a)
SELECT conv_id, turn, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(list_filter(s, lambda x: NOT regexp_matches(x, '\[\d+\]'))) AS BIGINT) AS n_uncited,
 CAST(len(list_filter(list_distinct(regexp_extract_all(t, '\[(\d+)\]', 1)), lambda x: CAST(x AS INT) NOT BETWEEN 1 AND 2)) AS BIGINT) AS n_invalid FROM s
""")
def citation_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    cited = F.regexp_replace("text", F.lit(r"\.( |\n|$)"), F.concat(F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("].$1")))
    said = rows.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, cited).otherwise(F.col("text")).alias("answer"), F.lit(2).alias("n_admitted"))
    checked = context.validate_citations(said)
    return checked.select("conv_id", "turn", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("n_uncited").cast("long").alias("n_uncited"), F.size("invalid").cast("long").alias("n_invalid"))


# Routing over the users' turns.
def _contains(markers: list[str], said: str) -> str:
    return " OR ".join(f"contains({said}, '{m}')" for m in markers)


_PADDED = "' ' || lower(text) || ' '"


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_contains(m, _PADDED)} THEN '{k}'" for k, m in routing.RULES) + " ELSE 'conceptual' END AS kind FROM conversations WHERE role = 'user'")
def classify_rules(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", routing.classify("text").alias("kind"))


@query(
    "WITH u AS (SELECT conv_id, turn, ' ' || regexp_replace(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g')), '\\s+', ' ', 'g') || ' ' AS p FROM conversations WHERE role = 'user')"
    " SELECT conv_id, turn, len(list_filter(string_split(p, ' '), lambda x: x <> '')) <= 6 OR " + _contains([f" {m} " for m in routing.DEPENDENT_MARKERS], "p") + " AS dependent FROM u"
)
def dependent_question(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", routing.is_dependent("text").alias("dependent"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS window FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id")
def condense_window(spark, sf_dir):
    listed = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    return listed.select("conv_id", routing.last_turns(F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("window"))


@query("SELECT * FROM (VALUES ('factual', NULL, 5, FALSE), ('conceptual', 'hyde', 12, TRUE), ('comparative', 'multi_query', 20, TRUE), ('relational', 'entities', 15, TRUE), ('aggregate', 'multi_query', 30, TRUE)) t(kind, transform, k, rerank)")
def routing_policy(spark, sf_dir):
    return routing.policies(spark)


# Metrics: a case is a question, its list the 20 best documents; those of good quality are relevant, ten are retrieved.
def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.lexical_search(*_lexical(spark, sf_dir), 20, all_terms=False)
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    ranked = found.join(labels, "chunk_id", "left").select("query_id", F.col("chunk_id").cast("string").alias("d"), F.coalesce("quality", F.lit(0)).alias("quality"), "rank")
    listed = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "d", "quality"))).alias("l"))  # 20 rows
    ids = lambda a: F.transform(a, lambda x: x["d"])
    return listed.select(
        F.col("query_id").cast("string").alias("case_id"), (F.col("query_id") % 4).cast("string").alias("segment"), (F.col("query_id") % 5 != 0).alias("is_answerable"), ids(F.slice("l", 1, 10)).alias("retrieved"),
        ids(F.filter("l", lambda x: x["quality"] == 1)).alias("relevant_chunk_ids"), F.map_from_entries(F.transform("l", lambda x: F.struct(x["d"], (x["quality"] * (1 + x["rank"] % 2)).cast("int")))).alias("relevance_grades"),
    )


_METRICS = f"""
WITH {_BM25},
g AS (SELECT query_id AS source, rank, coalesce(quality, 0) AS quality, coalesce(quality, 0) * (1 + rank % 2) AS grade FROM r LEFT JOIN labels ON doc_id = chunk_id WHERE rank <= 20),
ideal AS (SELECT source, sum((pow(2, grade) - 1) / log2(i + 1)) AS best FROM (SELECT source, grade, row_number() OVER (PARTITION BY source ORDER BY grade DESC) AS i FROM g) WHERE i <= 5 GROUP BY source),
m AS (SELECT CAST(source AS VARCHAR) AS case_id, source, CAST(source % 4 AS VARCHAR) AS segment,
  CAST(count(*) FILTER (quality = 1 AND rank <= 5) AS DOUBLE) / least(5, count(*)) AS "precision",
  CASE WHEN count(*) FILTER (quality = 1) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (quality = 1 AND rank <= 5) AS DOUBLE) / count(*) FILTER (quality = 1) END AS recall,
  coalesce(1.0 / min(rank) FILTER (quality = 1 AND rank <= 10), 0.0) AS mrr,
  coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 5), 0.0) AS dcg,
  CASE WHEN count(*) FILTER (quality = 1 AND rank <= 5) > 0 THEN 1.0 ELSE 0.0 END AS hit_rate,
  CASE WHEN source % 5 = 0 THEN CASE WHEN count(*) FILTER (quality = 1) % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN count(*) FILTER (quality = 1) % 2 = 0 THEN 0.0 END AS correct_abstention
  FROM g GROUP BY source),
e AS (SELECT m.*, CASE WHEN best = 0 THEN 0.0 ELSE dcg / best END AS ndcg FROM m JOIN ideal USING (source))
"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    responses = cases.select("case_id", "retrieved", (F.size("relevant_chunk_ids") % 2 == 0).alias("abstained"))
    return metrics.evaluate(cases.drop("retrieved"), responses, 5)


_SIX = ["precision", "recall", "mrr", "ndcg", "hit_rate", "correct_abstention"]


@query(_METRICS + "SELECT case_id, " + ", ".join(f'round("{m}", 5) AS "{m}"' for m in _SIX) + " FROM e")
def retrieval_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("case_id", *[F.round(m, 5).alias(m) for m in _SIX])


@query(_METRICS + "SELECT segment, " + ", ".join(f'round(avg("{m}"), 5) AS "{m}", count("{m}") AS n_{m}' for m in _SIX) + ", count(*) AS n FROM e GROUP BY GROUPING SETS ((), (segment))")
def metrics_by_segment(spark, sf_dir):
    return metrics.summarize(_evaluated(spark, sf_dir), _SIX).select("segment", *[F.round(m, 5).alias(m) for m in _SIX], *[f"n_{m}" for m in _SIX], "n")


# The graph: region <- nation <- supplier and customer; confidence is a function of the keys.
_EDGES = """
edges AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'PART_OF' AS rel_type, 'nation' AS source_uri, 0.9 AS confidence FROM nation
 UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN', 'supplier', CAST(0.4 + (s_suppkey % 6) / 10.0 AS DOUBLE) FROM supplier
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN', 'customer', CAST(0.3 + (c_custkey % 7) / 10.0 AS DOUBLE) FROM customer)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, src: Column, dst: Column, rel: str, confidence: Column) -> DataFrame:
        return _t(spark, sf_dir, table).select(
            F.lit("t").alias("tenant_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), F.lit(table).alias("source_uri"), confidence.cast("double").alias("confidence"),
            F.lit("").alias("evidence"), F.lit("").alias("chunk_id"), F.lit(table).alias("chapter"), F.lit(0).alias("seq"),
        )

    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (
        part("nation", key("N", "n_nationkey"), key("R", "n_regionkey"), "PART_OF", F.lit(0.9))
        .unionByName(part("supplier", key("S", "s_suppkey"), key("N", "s_nationkey"), "LOCATED_IN", 0.4 + F.col("s_suppkey") % 6 / 10.0))
        .unionByName(part("customer", key("C", "c_custkey"), key("N", "c_nationkey"), "LOCATED_IN", 0.3 + F.col("c_custkey") % 7 / 10.0))
    )


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, letter: str, key: str, name: str, kind: str) -> DataFrame:
        canonical = F.concat(F.lit(letter), F.col(key).cast("string"))
        return _t(spark, sf_dir, table).select(
            F.lit("t").alias("tenant_id"), canonical.alias("canonical_name"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), (0.5 + F.col(key) % 5 / 10.0).cast("double").alias("confidence"), F.lit(table).alias("chapter"), F.lit(0).alias("seq")
        )

    rows = part("region", "R", "r_regionkey", "r_name", "Location").unionByName(part("nation", "N", "n_nationkey", "n_name", "Location"))
    rows = rows.unionByName(part("supplier", "S", "s_suppkey", "s_name", "Organization")).unionByName(part("customer", "C", "c_custkey", "c_name", "Person"))
    again = rows.where("entity_type = 'Location'").select("tenant_id", "canonical_name", F.lower("name").alias("name"), F.lit("Concept").alias("entity_type"), F.lit(0.95).alias("confidence"), "chapter", F.lit(1).alias("seq"))
    return rows.unionByName(again)


_NODES = """
nodes AS (SELECT 'R' || r_regionkey AS k, r_name AS name, 'Location' AS entity_type, 0.5 + (r_regionkey % 5) / 10.0 AS confidence FROM region
 UNION ALL SELECT 'N' || n_nationkey, n_name, 'Location', 0.5 + (n_nationkey % 5) / 10.0 FROM nation
 UNION ALL SELECT 'S' || s_suppkey, s_name, 'Organization', 0.5 + (s_suppkey % 5) / 10.0 FROM supplier
 UNION ALL SELECT 'C' || c_custkey, c_name, 'Person', 0.5 + (c_custkey % 5) / 10.0 FROM customer),
merged AS (SELECT k AS canonical_name, name, CASE WHEN entity_type = 'Location' THEN 'Concept' ELSE entity_type END AS entity_type,
 round(CAST(CASE WHEN entity_type = 'Location' THEN greatest(confidence, 0.95) ELSE confidence END AS DOUBLE), 6) AS confidence, CASE WHEN entity_type = 'Location' THEN name || '|' || lower(name) ELSE name END AS surface_forms FROM nodes)
"""


@query(f"WITH {_NODES} SELECT * FROM merged")
def kg_nodes(spark, sf_dir):
    merged = graph.merge_nodes(_nodes(spark, sf_dir))
    return merged.select("canonical_name", "name", "entity_type", F.round("confidence", 6).alias("confidence"), F.array_join("surface_forms", "|").alias("surface_forms"))


@query(f"WITH {_EDGES} SELECT src, dst, rel_type, source_uri, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM edges")
def kg_edges(spark, sf_dir):
    merged = graph.merge_edges(_edges(spark, sf_dir), graph.merge_nodes(_nodes(spark, sf_dir)))
    return merged.select("src", "dst", "rel_type", "source_uri", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_EDGES}, {_NODES} SELECT canonical_name AS node, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM merged LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) ON node = canonical_name ORDER BY degree DESC, canonical_name LIMIT 20".replace("ORDER BY degree", "ORDER BY coalesce(degree, 0)"))
def degree_topk(spark, sf_dir):
    return graph.top_degrees(graph.merge_nodes(_nodes(spark, sf_dir)), _edges(spark, sf_dir)).select("node", "degree")


@query(f"WITH {_EDGES}, {_NODES} SELECT (SELECT count(*) FROM merged) AS nodes, (SELECT count(*) FROM edges) AS relationships, round((SELECT count(*) FROM edges) / CAST((SELECT count(*) FROM merged) AS DOUBLE), 6) AS ratio")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(graph.merge_nodes(_nodes(spark, sf_dir)), _edges(spark, sf_dir)).select("nodes", "relationships", F.round("ratio", 6).alias("ratio"))


_WALK = """
e AS (SELECT *, src || '>' || dst AS eid FROM edges),
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
st AS (SELECT src AS a, dst AS b, eid, confidence FROM e WHERE confidence >= 0.5 UNION ALL SELECT dst, src, eid, confidence FROM e WHERE confidence >= 0.5 AND src <> dst),
walk AS (
  SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS node, CAST([] AS VARCHAR[]) AS eids, CAST(1.0 AS DOUBLE) AS pc, 0 AS hops FROM region
  UNION ALL
  SELECT w.seed, st.b, list_append(w.eids, st.eid), w.pc * CAST(st.confidence AS DOUBLE), w.hops + 1 FROM walk w JOIN st ON st.a = w.node JOIN deg ON deg.node = st.b
  WHERE w.hops < {hops} AND NOT list_contains(w.eids, st.eid) AND (st.b = w.seed OR deg.degree < {hub}))
"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "region").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("seed"))


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(hops=3, hub=10**9)} SELECT seed, node AS reached, hops, round(pc, 6) AS path_confidence FROM walk WHERE hops > 0")
def bounded_traversal(spark, sf_dir):
    paths = graph.traverse(_regions(spark, sf_dir), _edges(spark, sf_dir), max_hops=3, hub_degree=10**9, limit=None, told=False)
    return paths.select("seed", F.col("a").alias("reached"), "hops", F.round("path_confidence", 6).alias("path_confidence"))


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(hops=3, hub=70)} SELECT seed, hops, count(*) AS paths, round(sum(pc), 4) AS total FROM walk WHERE hops > 0 GROUP BY seed, hops")
def hub_prune(spark, sf_dir):
    paths = graph.traverse(_regions(spark, sf_dir), _edges(spark, sf_dir), max_hops=3, hub_degree=70, limit=None, told=False)
    return paths.groupBy("seed", "hops").agg(F.count("*").alias("paths"), F.round(F.sum("path_confidence"), 4).alias("total"))


@query(f"WITH {_EDGES} SELECT src || ' ' || lower(replace(rel_type, '_', ' ')) || ' ' || dst || '.' AS sentence, src || ' -[' || rel_type || ']-> ' || dst AS triple FROM edges")
def triples_to_sentences(spark, sf_dir):
    rows = _edges(spark, sf_dir)
    return rows.select(tx.triple_sentence("src", "rel_type", "dst", "evidence").alias("sentence"), tx.triple("src", "rel_type", "dst").alias("triple"))


_MENTION = _CANON.format("CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END || s_name")


@query(f"""
WITH m AS (SELECT s_suppkey AS query_id, {_MENTION} AS k FROM supplier), n AS (SELECT DISTINCT {_CANON.format('s_name')} AS c FROM supplier),
e AS (SELECT query_id, c AS canonical_name FROM m JOIN n ON k = c),
f AS (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY levenshtein(k, c), c) AS place FROM m, n WHERE query_id NOT IN (SELECT query_id FROM e) AND levenshtein(k, c) <= 0.14 * (length(k) + length(c)))
SELECT query_id, canonical_name, 'exact' AS how FROM e UNION ALL SELECT query_id, c, 'fuzzy' FROM f WHERE place = 1
""")
def fuzzy_link(spark, sf_dir):
    """Mentions are the names of all suppliers, every other one with a letter too many."""
    suppliers = _t(spark, sf_dir, "supplier")
    nodes = suppliers.select(F.lit("t").alias("tenant_id"), tx.canonicalize("s_name").alias("canonical_name"))
    mentions = suppliers.select(F.lit("t").alias("tenant_id"), F.col("s_suppkey").alias("query_id"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("x")).otherwise(""), "s_name").alias("mention"))
    return graph.link_mentions(mentions, nodes).select("query_id", "canonical_name", "how")


# Reliability: events are calls, errors failures, values latencies.
_CALLS = "SELECT event_id, user_id, ts, event_type <> 'error' AS ok, value * 100 AS latency_ms FROM events"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("k"), "ts", (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency_ms"))


_OVER = "OVER (PARTITION BY user_id % 20 ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)"


@query(f"WITH c AS ({_CALLS}), w AS (SELECT event_id, count(*) {_OVER} AS events, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) {_OVER} AS BIGINT) AS failures, CAST(sum(CASE WHEN latency_ms >= 8000 THEN 1 ELSE 0 END) {_OVER} AS BIGINT) AS slow FROM c) SELECT *, failures >= 5 OR (events >= 5 AND CAST(slow AS DOUBLE) / events >= 0.5) AS trips FROM w")
def breaker_trips(spark, sf_dir):
    return reliability.trip_signals(_calls(spark, sf_dir), key="k").select("event_id", "events", "failures", "slow", "trips")


@query(f"""
WITH RECURSIVE c AS (SELECT event_id, user_id % 20 AS k, epoch_us(ts) / 1e6 AS secs, ok, latency_ms >= 8000 AS slow, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM ({_CALLS})),
s AS (
  SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS said, 'closed' AS state, CAST(0 AS DOUBLE) AS opened, 0 AS probes, CAST([] AS STRUCT(secs DOUBLE, ok BOOLEAN, slow BOOLEAN)[]) AS calls FROM (SELECT DISTINCT k FROM c)
  UNION ALL
  SELECT k, n, event_id, CASE WHEN now = 'rejected' THEN now ELSE after END, CASE WHEN now = 'rejected' THEN 'open' ELSE after END,
    CASE WHEN now <> 'rejected' AND after = 'open' THEN secs ELSE opened END, CASE WHEN now = 'half_open' AND ok THEN probes - 1 ELSE probes END,
    CASE WHEN now = 'half_open' AND after = 'closed' THEN CAST([] AS STRUCT(secs DOUBLE, ok BOOLEAN, slow BOOLEAN)[]) ELSE calls END
  FROM (
    SELECT *, CASE WHEN now = 'rejected' THEN 'open'
      WHEN now = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN probes = 1 THEN 'closed' ELSE 'half_open' END
      WHEN len(list_filter(calls, lambda x: NOT x.ok)) >= 5 OR (len(calls) >= 5 AND CAST(len(list_filter(calls, lambda x: x.slow)) AS DOUBLE) / len(calls) >= 0.5) THEN 'open' ELSE 'closed' END AS after
    FROM (
      SELECT k, n, event_id, secs, ok, opened, now, CASE WHEN was = 'open' THEN 3 ELSE probes END AS probes,
        CASE WHEN now = 'rejected' THEN held WHEN now = 'half_open' THEN list_append(held, mine) ELSE list_filter(list_append(held, mine), lambda x: secs - x.secs <= 60) END AS calls
      FROM (
        SELECT s.k, c.n, c.event_id, c.secs, c.ok, s.state AS was, s.opened, s.probes, s.calls AS held, {{'secs': c.secs, 'ok': c.ok, 'slow': c.slow}} AS mine,
          CASE WHEN s.state = 'open' AND c.secs - s.opened < 30 THEN 'rejected' WHEN s.state = 'open' THEN 'half_open' ELSE s.state END AS now
        FROM s JOIN c ON c.k = s.k AND c.n = s.n + 1))))
SELECT event_id, k, said AS state FROM s WHERE n > 0
""")
def breaker_states(spark, sf_dir):
    return reliability.breaker_states(_calls(spark, sf_dir), key="k", order="event_id").select("event_id", "k", "state")


@query("SELECT CAST(p AS INT) AS pressure, CASE WHEN p > 0 THEN '40' ELSE '100' END AS ef_search, CASE WHEN p > 1 THEN 'false' ELSE 'true' END AS \"rerank\", CASE WHEN p > 2 THEN '3' ELSE '5' END AS top_k, CASE WHEN p > 3 THEN 'false' ELSE 'true' END AS \"condense\" FROM range(0, 5) t(p)")
def degrade_ladder(spark, sf_dir):
    settings = F.create_map(*[F.lit(x) for x in ("ef_search", "100", "rerank", "true", "top_k", "5", "condense", "true")])
    rungs = spark.range(5).select(F.col("id").cast("int").alias("pressure")).withColumn("c", reliability.degrade(settings, "pressure"))
    return rungs.select("pressure", *[F.col("c")[k].alias(k) for k in ("ef_search", "rerank", "top_k", "condense")])


@query("WITH d AS (SELECT source, count(*) * 1000 AS n FROM documents GROUP BY source), c AS (SELECT source, CAST(n AS DOUBLE) * (15 * 500 * 1.12 / 300) AS chunks FROM d) SELECT source, CAST(round_even(chunks, 0) AS BIGINT) AS chunks, round_even(chunks * 768 * 4 / 1e9, 1) AS raw_vector_gb FROM c")
def capacity(spark, sf_dir):
    sized = _t(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") * 1000).alias("n"))
    found = scores.estimate_capacity(F.col("n"))
    return sized.select("source", found["chunks"].alias("chunks"), found["raw_vector_gb"].alias("raw_vector_gb"))


@query("SELECT event_type, count(*) * 8 AS queries_per_day, round_even(count(*) * 8 / 28800.0, 2) AS average_qps, round_even(count(*) * 8 / 28800.0 * 5, 2) AS peak_qps FROM events GROUP BY event_type")
def load(spark, sf_dir):
    users = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return users.select("event_type", *[c.alias(name) for name, c in scores.estimate_load(F.col("n")).items()])


# The store's merge, on literal halves of the documents: the second half of the writes repeats the first.
@query("SELECT tenant_id, count(*) AS chunks, count(*) FILTER (version = 2) AS refreshed FROM (SELECT source AS tenant_id, sha256(source || '|0|' || text) AS h, max(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) AS version FROM documents GROUP BY 1, 2) GROUP BY tenant_id")
def store_upsert(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), scores.content_hash("source", F.lit(0), "text").alias("content_hash"), "doc_id")

    def writes(which: DataFrame, model: str) -> DataFrame:
        empty = F.lit("")
        return which.select(
            "tenant_id", empty.alias("chapter"), empty.alias("source_uri"), empty.alias("section_path"), empty.alias("content"), "content_hash", F.lit(None).cast("map<string,string>").alias("metadata"),
            F.lit(None).cast("array<float>").alias("embedding"), F.lit(model).alias("embed_model"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("created_at"), F.col("doc_id").alias("position"),
        )

    stored = store.upsert(writes(rows, "1").drop("position").limit(0), writes(rows, "1"))
    merged = store.upsert(stored, writes(rows.where("doc_id % 3 = 0"), "2"))
    return merged.groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("embed_model") == "2").alias("refreshed"))


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z]{4,})', 1)), lambda x: NOT list_contains(" + "[" + ", ".join(f"'{w}'" for w in tx.STOP_TERMS) + "], x)).len() AS n_terms FROM conversations")
def distinctive_terms(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.distinctive_terms("text")).cast("long").alias("n_terms"))


_HYPOTHETICAL = "text || chr(10) || chr(10) || trim(reverse(list_last(string_split(text, chr(10) || chr(10)))))"


@query(f"WITH {_BM25.replace('lower(text)', f'lower({_HYPOTHETICAL})', 1)} SELECT query_id, chunk_id, score FROM r WHERE rank <= 5")
def hyde_topk(spark, sf_dir):
    from tessera.operators import models

    questions, corpus = _lexical(spark, sf_dir)
    return _hits(routing.hyde_search(questions, lambda q, k: retrieval.lexical_search(q, corpus, k, all_terms=False), models.reversed_reply))


@query(f"""
WITH {_BM25}, k AS (SELECT item_id AS query_id, CASE {' '.join(f"WHEN {_contains(m, _PADDED)} THEN '{kind}'" for kind, m in routing.RULES)} ELSE 'conceptual' END AS kind FROM benchmark),
y AS (SELECT query_id, kind, CASE kind WHEN 'factual' THEN 5 WHEN 'conceptual' THEN 12 WHEN 'comparative' THEN 20 WHEN 'relational' THEN 15 ELSE 30 END AS most FROM k),
m AS (SELECT r.query_id, kind, most, chunk_id, rank, score >= 30 AS strong FROM r JOIN y USING (query_id)),
one AS (SELECT * FROM m WHERE rank <= most AND strong), two AS (SELECT * FROM m WHERE rank <= 2 * most AND query_id NOT IN (SELECT query_id FROM one)),
ok AS (SELECT DISTINCT query_id FROM two WHERE strong)
SELECT query_id, kind, chunk_id, 1 AS attempt, 0 AS corrections FROM one UNION ALL SELECT query_id, kind, chunk_id, 2, 1 FROM two WHERE strong OR query_id NOT IN (SELECT query_id FROM ok)
""")
def adaptive_policy(spark, sf_dir):
    questions, corpus = _lexical(spark, sf_dir)
    index = retrieval.question_postings(questions, corpus)
    found = routing.adaptive_search(questions, lambda q, k: retrieval.lexical_search(q, None, k, all_terms=False, index=index), floor=30.0)
    return found.select("query_id", "kind", "chunk_id", "attempt", F.size("corrections").alias("corrections"))


@query(r"""
WITH b AS (SELECT item_id AS case_id, text AS question, text AS answer, left(text, length(text) // 2) AS context FROM benchmark),
c AS (SELECT *, list_filter(string_split(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS claims FROM b),
v AS (SELECT *, len(list_filter(claims, lambda x: contains(context, x))) AS ok FROM c)
SELECT case_id, CAST(ok AS DOUBLE) / len(claims) AS faithfulness, CAST(len(claims) AS INT) AS claims, CAST(ok AS BIGINT) AS supported, CAST(len(claims) - ok AS BIGINT) AS unsupported,
  CASE WHEN list_has_any(regexp_extract_all(lower(question), '([a-z0-9]+)', 1), regexp_extract_all(lower(answer), '([a-z0-9]+)', 1)) THEN CAST(1 AS DOUBLE) ELSE 0 END AS answer_relevance
FROM v
""")
def judged_answers(spark, sf_dir):
    from tessera.operators import models

    text = F.col("text")
    rows = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), text.alias("question"), text.alias("answer"), F.substring(text, F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("context"))
    faithful = metrics.judge_faithfulness(rows, models.literal_judge).select("case_id", "faithfulness", "claims", "supported", "unsupported")
    return faithful.join(metrics.judge_answer_relevance(rows, models.literal_judge), "case_id")


@query("""
WITH n AS (SELECT item_id AS query_id, doc_id AS position, source AS name, lower(text) AS q FROM benchmark, (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source)),
f AS (SELECT query_id, position, name, row_number() OVER (PARTITION BY query_id ORDER BY position, name) AS place FROM n WHERE name <> '' AND NOT contains(q, lower(name))),
a AS (SELECT query_id, string_agg(name, ' ' ORDER BY place) AS added FROM f WHERE place <= 5 GROUP BY query_id)
SELECT query_id, sha256(text || ' ' || added) AS h FROM a JOIN benchmark ON item_id = query_id
""")
def graph_expansion(spark, sf_dir):
    """Every question's traversal has discovered the sources, in order of their first document."""
    questions, corpus = _lexical(spark, sf_dir)
    names = corpus.groupBy(F.col("source_uri").alias("name")).agg(F.min("chunk_id").alias("position"))
    seeds = questions.select("query_id").join(F.broadcast(names))
    return graph.expanded_questions(questions, seeds).select("query_id", F.sha2("question", 256).alias("h"))


# Whole plans with the stand-in models: contexts as in context_build, their first block's first sentence with its citation as the answer.
def _answered(rows: str) -> str:
    contexts = ORACLE_SQL["context_build"].rpartition("\nSELECT")[0].replace("WHERE r.rank <= 10)", rows)
    return contexts + r"""
, ev AS (SELECT DISTINCT query_id FROM i), ad AS (SELECT query_id, max(n) AS n_admitted, max(CASE WHEN place = 1 THEN '[1] (source: ' || coalesce(source, '') || ')' || chr(10) || text END) AS block FROM pl GROUP BY query_id),
sp AS (SELECT *, trim(regexp_extract(block, '\[1\][^\n]*\n(.+)', 1)) AS line FROM ad),
sn AS (SELECT *, rtrim(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1], '.!?') AS said FROM sp),
an AS (SELECT query_id, n_admitted, CASE WHEN said <> '' THEN said || ' [1].' ELSE 'INSUFFICIENT' END AS answer FROM sn),
ct AS (SELECT *, list_filter(string_split(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s,
  list_filter(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INT) NOT BETWEEN 1 AND n_admitted) AS bad FROM an),
cv AS (SELECT query_id, answer, round(CASE WHEN len(s) = 0 THEN 0 ELSE CAST(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) AS DOUBLE) / len(s) END, 6) AS coverage,
  len(bad) = 0 AND len(list_filter(s, lambda x: NOT regexp_matches(x, '\[\d+\]'))) = 0 AS passed FROM ct)
"""


_SCALED = "JOIN (SELECT query_id, max(score) AS best FROM r GROUP BY query_id) m ON m.query_id = r.query_id WHERE r.rank <= 5 AND CASE WHEN best > 0 THEN r.score / best ELSE r.score END >= 0.35)"


@query(_answered(_SCALED) + """SELECT item_id AS query_id, coalesce(answer = 'INSUFFICIENT', TRUE) AS abstained, CASE WHEN answer IS NULL THEN 'evidence' WHEN answer = 'INSUFFICIENT' THEN 'model' END AS reason,
 coalesce(passed, FALSE) AS passed, coalesce(coverage, CAST(0 AS DOUBLE)) AS coverage FROM benchmark LEFT JOIN cv ON cv.query_id = item_id""")
def gated_answers(spark, sf_dir):
    from tessera.operators import models
    from tessera.plans import answering

    questions, _ = _lexical(spark, sf_dir)
    results = scores.max_scale(_results(spark, sf_dir, 5))
    return answering.answer(questions, results, models.generate(lambda: models.extractive_answer)).select("query_id", "abstained", "reason", "passed", F.round("coverage", 6).alias("coverage"))


@query(_answered("WHERE r.rank <= 8)") + """SELECT item_id AS query_id, CASE WHEN ev.query_id IS NULL THEN 'no_evidence' ELSE 'sufficient_evidence' END AS terminated_by, 0 AS iteration,
 coalesce(coverage, CAST(0 AS DOUBLE)) AS coverage, NOT coalesce(passed AND coverage >= 0.6, FALSE) AS needs_human FROM benchmark LEFT JOIN ev ON ev.query_id = item_id LEFT JOIN cv ON cv.query_id = item_id""")
def agent_answers(spark, sf_dir):
    from tessera.operators import models
    from tessera.plans import agent

    questions, corpus = _lexical(spark, sf_dir)

    def search(asked: DataFrame, k: int) -> DataFrame:
        found = retrieval.lexical_search(asked.select("query_id", "question"), corpus, k, all_terms=False)
        rows = scores.max_scale(found).join(corpus, "chunk_id")
        return rows.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "content", "score", "source_uri", "rank")

    done = agent.run_agent(questions, {"vector": search, "hybrid": search, "graph": search}, generator=models.generate(lambda: models.extractive_answer), deadline_seconds=1e9)
    return done.select("query_id", "terminated_by", "iteration", F.round("coverage", 6).alias("coverage"), "needs_human")


from tessera.plans import registry_more  # noqa: E402, F401  adds its queries to these
