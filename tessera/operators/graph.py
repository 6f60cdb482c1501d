"""The knowledge graph: extraction, merging, linking of mentions, bounded traversal, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as tx
from tessera.operators.retrieval import small
from tessera.scratch import materialize

EXTRACTION = "entities array<struct<name:string,type:string,confidence:string>>, relationships array<struct<source:string,target:string,type:string,confidence:string,evidence:string>>"


def confidence(raw: Column, present: Column) -> Column:
    """A missing key is 1, an empty or unreadable value 0."""
    return F.when(~present, 1.0).otherwise(F.coalesce(raw.try_cast("double"), F.lit(0.0)))


def extract(replies: DataFrame, reply: str = "reply", min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, rejects) from model replies; other columns of replies are carried along.

    The first failing test names the reject. Relationships need both ends among their reply's accepted entities.
    """
    keys = [c for c in replies.columns if c != reply]
    numbered = replies.withColumn("__r", F.monotonically_increasing_id()).withColumn("__x", tx.json_object(reply, EXTRACTION))
    present = F.col("e.confidence").isNotNull()
    each = numbered.select(*keys, "__r", F.posexplode("__x.entities").alias("seq", "e")).select(
        *keys, "__r", "seq", F.trim(F.coalesce("e.name", F.lit(""))).alias("name"), F.col("e.type").alias("entity_type"), confidence(F.col("e.confidence"), present).alias("confidence")
    )
    reason = (
        F.when(F.col("name") == "", "blank").when(~F.coalesce(F.col("entity_type").isin(schemas.NODE_LABELS), F.lit(False)), F.concat(F.lit("label:"), F.coalesce("entity_type", F.lit(""))))
        .when(F.lower("name").isin(schemas.STOP_ENTITIES), F.concat(F.lit("stop:"), "name")).when(F.col("confidence") < min_confidence, F.concat(F.lit("confidence:"), "name"))
    )
    judged = each.withColumn("reason", reason)
    entities = judged.where(F.col("reason").isNull()).drop("reason")
    names = entities.select("__r", "name").distinct()
    has = F.col("r.confidence").isNotNull()
    links = numbered.select(*keys, "__r", F.posexplode("__x.relationships").alias("seq", "r")).select(
        *keys, "__r", "seq", F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), tx.relation_type("r.type").alias("rel_type"),
        confidence(F.col("r.confidence"), has).alias("confidence"), tx.truncate(F.coalesce("r.evidence", F.lit("")), 400).alias("evidence"),
    )
    ends = links.join(names.withColumnsRenamed({"name": "source"}).withColumn("s", F.lit(True)), ["__r", "source"], "left").join(
        names.withColumnsRenamed({"name": "target"}).withColumn("t", F.lit(True)), ["__r", "target"], "left"
    )
    why = (
        F.when(F.col("s").isNull() | F.col("t").isNull(), F.concat(F.lit("dangling:"), F.concat_ws("->", "source", "target")))
        .when(~F.coalesce(F.col("rel_type").isin(schemas.RELATIONSHIP_TYPES), F.lit(False)) | (F.col("confidence") < min_confidence), F.concat(F.lit("relationship:"), F.coalesce("rel_type", F.lit(""))))
    )
    checked = ends.withColumn("reason", why).drop("s", "t")
    rejects = judged.where(F.col("reason").isNotNull()).select(*keys, "reason").unionByName(checked.where(F.col("reason").isNotNull()).select(*keys, "reason"))
    failed = numbered.where(F.col("__x").isNull()).select(*keys, F.lit("unreadable").alias("reason"))
    return entities.drop("__r"), checked.where(F.col("reason").isNull()).drop("reason", "__r"), rejects.unionByName(failed)


def _created(rows: DataFrame) -> Column:
    return (F.col("created_at") if "created_at" in rows.columns else F.lit(None)).cast("timestamp").alias("created_at")


def merge_nodes(incoming: DataFrame, stored: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Nodes by (tenant_id, canonical_name): first name, largest confidence, last type and chapter, all surface forms in order.

    created_at is the earliest that stored or incoming have, and now where none has one. Counted per task before the shuffle; a node's surface forms are distinct names, not rows.
    """
    rows = incoming.select("tenant_id", "canonical_name", "name", "entity_type", "confidence", "chapter", _created(incoming), F.col(order).cast("long").alias("o"))
    if stored is not None:
        old = stored.select("tenant_id", "canonical_name", F.posexplode("surface_forms").alias("p", "form"), "name", "entity_type", "confidence", "chapter", _created(stored))
        rows = rows.unionByName(old.select("tenant_id", "canonical_name", F.when(F.col("p") == 0, F.col("name")).otherwise(F.col("form")).alias("name"), "entity_type", "confidence", "chapter", "created_at", (F.col("p") - (1 << 40)).alias("o")))
    forms = rows.groupBy("tenant_id", "canonical_name", "name").agg(
        F.min("o").alias("o"), F.max("confidence").alias("confidence"), F.max(F.struct("o", "entity_type", "chapter")).alias("last"), F.min("created_at").alias("created_at")
    )
    return forms.groupBy("tenant_id", "canonical_name").agg(
        F.min_by("name", "o").alias("name"), F.max("last")["entity_type"].alias("entity_type"), F.max("confidence").alias("confidence"),
        F.transform(F.sort_array(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("surface_forms"), F.max("last")["chapter"].alias("chapter"),
        F.coalesce(F.min("created_at"), F.current_timestamp()).alias("created_at"),
    )


def merge_edges(incoming: DataFrame, nodes: DataFrame, stored: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Edges by (tenant_id, src, dst, rel_type, source_uri): the last write wins; both ends must be nodes; created_at as of nodes."""
    keys = ["tenant_id", "src", "dst", "rel_type", "source_uri"]
    columns = [*keys, "confidence", "evidence", "chunk_id", "chapter"]
    rows = incoming.where((F.trim("src") != "") & (F.trim("dst") != "")).select(*columns, _created(incoming), F.col(order).cast("long").alias("o"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*columns, _created(stored), F.lit(-1).cast("long").alias("o")))
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct("confidence", "evidence", "chunk_id", "chapter"), "o").alias("v"), F.coalesce(F.min("created_at"), F.current_timestamp()).alias("created_at"))
    last = grouped.select(*keys, "v.*", "created_at")
    known = nodes.select("tenant_id", F.col("canonical_name").alias("src"))
    return last.join(known, ["tenant_id", "src"], "left_semi").join(known.withColumnRenamed("src", "dst"), ["tenant_id", "dst"], "left_semi").select(*columns, "created_at")


def delete_chapter(nodes: DataFrame, edges: DataFrame, tenant_id: str | None, chapter: str) -> tuple[DataFrame, DataFrame]:
    """Without a chapter's nodes, and without edges that lose an end."""
    hit = F.col("chapter") == chapter
    if tenant_id is not None:
        hit = hit & (F.col("tenant_id") == tenant_id)
    gone = nodes.where(hit).select("tenant_id", "canonical_name")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select("tenant_id", F.col("canonical_name").alias(end)), ["tenant_id", end], "left_anti")
    return nodes.where(~F.coalesce(hit, F.lit(False))), left.select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends (a loop once), with an id and whether it is walked as stored."""
    named = edges.withColumn("eid", F.xxhash64("tenant_id", "src", "dst", "rel_type", "source_uri"))
    there = named.select("tenant_id", F.col("src").alias("a"), F.col("dst").alias("b"), "eid", "rel_type", "confidence", "evidence", "source_uri", F.lit(True).alias("forward"))
    back = named.where("src <> dst").select("tenant_id", F.col("dst").alias("a"), F.col("src").alias("b"), "eid", "rel_type", "confidence", "evidence", "source_uri", F.lit(False).alias("forward"))
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(tenant_id, node, degree) over both directions."""
    ends = edges.select("tenant_id", F.col("src").alias("node")).unionByName(edges.select("tenant_id", F.col("dst").alias("node")))
    return ends.groupBy("tenant_id", "node").agg(F.count("*").alias("degree"))


def traverse(seeds: DataFrame, edges: DataFrame, *, max_hops: int = 2, min_confidence: float = 0.5, hub_degree: int = 500, limit: int | None = 120, told: bool = True) -> DataFrame:
    """Trails from seeds(tenant_id, seed): up to max_hops edges of min_confidence, none twice, no hubs but the seed itself.

    Hubs aren't walked to, which is what bounds a hop: a node has under hub_degree edges. Per seed the best limit paths by product of
    confidences, then fewer hops, then edges. Confidences are at most 1, so a path's extensions never come before it or any path that
    does: with a limit a hop goes on from the limit best paths of each seed only, and nothing is lost. Paths carry the ids of their
    edges; what the edges say is joined on at the end, unless told is false. Columns: nodes, eids, path_confidence, hops[, rank][, triples].
    """
    hubs = degrees(edges).where(F.col("degree") >= hub_degree).select("tenant_id", F.col("node").alias("b"), F.lit(True).alias("hub"))
    known = edges.where(F.col("confidence") >= min_confidence)
    steps = undirected(known).select("tenant_id", "a", "b", "eid", "confidence").join(hubs, ["tenant_id", "b"], "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    keys = ["tenant_id", "seed", "a", "nodes", "eids", "path_confidence"]
    at = seeds.select("tenant_id", "seed").distinct().select(
        "tenant_id", "seed", F.col("seed").alias("a"), F.array("seed").alias("nodes"), F.array().cast("array<bigint>").alias("eids"), F.lit(1.0).alias("path_confidence")
    )
    w = Window.partitionBy("tenant_id", "seed").orderBy(F.desc("path_confidence"), "hops", "eids")
    out = None
    for hop in range(1, max_hops + 1):
        # the seed may be a hub, and a path may come back to it
        ways = at.join(steps, ["tenant_id", "a"]).where((~F.col("hub") | (F.col("b") == F.col("seed"))) & ~F.array_contains("eids", F.col("eid")))
        found = ways.select(
            "tenant_id", "seed", F.col("b").alias("a"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("eids", F.array("eid")).alias("eids"),
            (F.col("path_confidence") * F.col("confidence")).alias("path_confidence"), F.lit(hop).alias("hops"),
        )
        out = found if out is None else out.unionByName(found)
        if limit is not None:
            out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")
            if hop < max_hops:
                out = materialize(out, "paths")  # what comes next reads it twice
        at = (found if limit is None else out.where(F.col("hops") == hop)).select(*keys)
    if limit is not None:
        out = out.withColumn("rank", F.row_number().over(w))
    return _with_triples(out, known) if told else out


def _with_triples(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with what their edges say, in order; every path has an edge."""
    told = edges.select(
        "tenant_id", F.xxhash64("tenant_id", "src", "dst", "rel_type", "source_uri").alias("eid"), F.struct("src", "rel_type", "dst", "evidence", "source_uri").alias("t")
    )
    each = paths.select("*", F.posexplode("eids").alias("__i", "eid")).join(told.groupBy("tenant_id", "eid").agg(F.first("t").alias("t")), ["tenant_id", "eid"])
    columns = [c for c in paths.columns if c not in ("tenant_id", "seed", "eids")]
    listed = each.groupBy("tenant_id", "seed", "eids").agg(*[F.first(c).alias(c) for c in columns], F.sort_array(F.collect_list(F.struct("__i", "t"))).alias("l"))  # an edge for each hop
    return listed.withColumn("triples", F.transform("l", lambda x: x["t"])).drop("l")


def path_triples(paths: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct triples of a seed's paths at their first appearance, as (seed, position, triple fields); with nodes, src and dst are display names."""
    each = paths.select("tenant_id", "seed", "rank", F.posexplode("triples").alias("i", "t")).select("tenant_id", "seed", "rank", "i", "t.*")
    first = each.groupBy("tenant_id", "seed", "src", "rel_type", "dst").agg(F.min(F.struct("rank", "i", "evidence", "source_uri")).alias("f"))
    w = Window.partitionBy("tenant_id", "seed").orderBy("f")
    told = first.select("tenant_id", "seed", F.row_number().over(w).alias("position"), "src", "rel_type", "dst", "f.evidence", "f.source_uri")
    for end in ("src", "dst") if nodes is not None else ():
        shown = nodes.select("tenant_id", F.col("canonical_name").alias(end), F.coalesce("name", "canonical_name").alias("shown"))
        told = told.join(shown, ["tenant_id", end], "left").withColumn(end, F.coalesce("shown", end)).drop("shown")
    return told


def triples_as_results(triples: DataFrame) -> DataFrame:
    """Triples as result rows: a sentence each, score 0, id by the triple's hash."""
    return triples.select(
        "seed", F.sha2(F.concat_ws("|", "src", "rel_type", "dst"), 256).alias("chunk_id"), tx.triple_sentence("src", "rel_type", "dst", "evidence").alias("content"),
        F.lit(0.0).alias("score"), "source_uri", F.lit("graph").alias("retriever"), "position",
    )


def question_mentions(queries: DataFrame, model=None) -> DataFrame:
    """(query_id[, tenant_id], mention): those that a model lists, or runs of capitalized words where it lists none."""
    spoken = tx.capitalized_mentions("question")
    if model is not None:
        listed = F.filter(F.transform(tx.json_array(model(tx.fill_template("mentions", question="question"))), lambda m: F.trim(m)), lambda m: m != "")
        spoken = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(spoken)
    return queries.select(*[c for c in ("tenant_id", "query_id") if c in queries.columns], F.explode(spoken).alias("mention"))


def expanded_questions(queries: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """queries that the first limit names of seeds(query_id, position, name) are added to, but for names which the question has;
    questions that no name is new to are left out."""
    new = seeds.join(queries.select("query_id", "question"), "query_id").where((F.col("name") != "") & ~F.contains(F.lower("question"), F.lower("name")))
    names = new.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("position", "name"))).alias("n"))
    added = F.array_join(F.transform(F.slice("n", 1, limit), lambda x: x["name"]), " ")
    return queries.join(names, "query_id").withColumn("question", F.concat_ws(" ", "question", added)).drop("n")


def guided_search(queries: DataFrame, seeds: DataFrame, search, top: int = 6) -> DataFrame:
    """Rows of search for the questions, and behind them those for the questions with the names that a traversal has discovered."""
    first = search(queries, 4 * top)
    more = search(expanded_questions(queries, seeds), 2 * top)
    return first.unionByName(more.withColumn("rank", F.col("rank") + 4 * top))


def link_mentions(mentions: DataFrame, nodes: DataFrame, threshold: float = 0.86, aliases: DataFrame | None = None) -> DataFrame:
    """(tenant_id, query_id, mention, canonical_name, how): by alias or canonical name, else by the best fuzzy ratio; null if unlinked.

    What isn't known is looked up once for each different string. Names with one letter more or less come first, by equal keys:
    as a ratio is at most twice the shorter length over both, no name that two letters separate reaches n / (n + 1) with a mention of n letters,
    so a best one above that is the best of all. Only mentions without one meet all names of their tenant whose length could reach the
    threshold; an edit distance in the JVM, which is at most the letters that a ratio leaves unmatched, keeps most of those from Python.
    """
    rows = mentions.withColumn("k", tx.canonicalize("mention"))
    if aliases is not None:
        rows = tx.resolve_aliases(mentions, aliases, "mention").withColumnRenamed("resolved", "k")
    known = nodes.select("tenant_id", F.col("canonical_name").alias("k")).distinct()
    exact = rows.join(known, ["tenant_id", "k"], "left_semi").withColumn("canonical_name", F.col("k")).withColumn("how", F.when(F.col("k") == tx.canonicalize("mention"), "exact").otherwise("alias"))
    rest = rows.join(known, ["tenant_id", "k"], "left_anti")
    n = F.length("k")
    asked = materialize(rest.where(n > 0).select("tenant_id", "k").distinct(), "mentions")
    names = known.withColumnRenamed("k", "c")
    shorter = asked.select("tenant_id", "k", F.explode(_one_less("k")).alias("c")).join(names, ["tenant_id", "c"])
    longer = names.select("tenant_id", "c", F.explode(_one_less("c")).alias("k")).join(asked, ["tenant_id", "k"])
    close = materialize(_best_ratio(shorter.select("tenant_id", "k", "c").unionByName(longer.select("tenant_id", "k", "c")), threshold).where(F.col("ratio") > n / (n + 1)), "near-names")
    low, high = F.ceil(n * threshold / (2 - threshold)).cast("int"), F.floor(n * (2 - threshold) / threshold).cast("int")
    keyed = asked.join(close, ["tenant_id", "k"], "left_anti").withColumn("len", F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))))
    pairs = small(keyed).join(names.withColumn("len", F.length("c")), ["tenant_id", "len"])
    far = _best_ratio(pairs.where(F.levenshtein("k", "c") <= (1 - threshold) * (F.length("k") + F.length("c")) + 1e-9), threshold)
    best = close.unionByName(far).select("tenant_id", "k", F.col("c").alias("canonical_name"))
    fuzzy = rest.join(best, ["tenant_id", "k"], "left").withColumn("how", F.when(F.col("canonical_name").isNotNull(), "fuzzy"))
    columns = ["tenant_id", "query_id", "mention", "canonical_name", "how"]
    return exact.select(*columns).unionByName(fuzzy.select(*columns))


def _one_less(c: str) -> Column:
    """The different strings that c is without one of its letters; none of an empty one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
    return F.when(F.length(c) > 0, F.array_distinct(cut))


def _best_ratio(pairs: DataFrame, threshold: float) -> DataFrame:
    """(tenant_id, k, c, ratio): for each k the c of the greatest ratio, the first of equal ones."""
    rated = pairs.withColumn("ratio", tx.fuzzy_ratio("k", "c")).where(F.col("ratio") >= threshold)
    least = rated.groupBy("tenant_id", "k").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "c")).alias("b"))
    return least.select("tenant_id", "k", F.col("b.c").alias("c"), (-F.col("b.r")).alias("ratio"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per tenant: node and relationship counts, their ratio, nodes by type."""
    by_type = nodes.where(F.col("entity_type").isNotNull()).groupBy("tenant_id", "entity_type").agg(F.count("*").alias("n")).groupBy("tenant_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))
    n = nodes.groupBy("tenant_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("tenant_id").agg(F.count("*").alias("relationships"))
    joined = n.join(e, "tenant_id", "full_outer").join(by_type, "tenant_id", "left").na.fill(0, ["nodes", "relationships"])
    return joined.withColumn("ratio", F.when(F.col("nodes") == 0, 0.0).otherwise(F.col("relationships") / F.col("nodes")))


def top_degrees(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """A tenant's nodes of largest degree, those without edges included."""
    joined = nodes.select("tenant_id", F.col("canonical_name").alias("node")).join(degrees(edges), ["tenant_id", "node"], "left").na.fill(0, ["degree"])
    w = Window.partitionBy("tenant_id").orderBy(F.desc("degree"), "node")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fuse_with_graph(vector: DataFrame, triples: DataFrame, queries: DataFrame, *, judge=None, top: int = 6, budget: int = 2600) -> DataFrame:
    """(query_id, context, admitted, graph_share): passages and triples of each question, reranked, in one context.

    triples(query_id, chunk_id, content, score, source_uri, retriever, position); vector as from search, with contents.
    """
    from tessera.operators.context import build_context
    from tessera.operators.rerank import rerank

    columns = ["query_id", "chunk_id", "content", "score", "source_uri", "retriever", "rank"]
    pool = vector.select(*columns).unionByName(triples.withColumn("rank", F.col("position").cast("int") + 1_000_000).select(*columns))
    if judge is not None:
        kept = rerank(pool, queries, judge, keep=top, floor=0.0)
    else:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")
        kept = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    context = build_context(kept.select(*columns), budget)
    graph = triples.select("query_id", "chunk_id").withColumn("__g", F.lit(1)).distinct()
    share = context.select("query_id", F.explode("admitted").alias("x")).select("query_id", F.col("x.chunk_id").alias("chunk_id")).join(graph, ["query_id", "chunk_id"], "left")
    share = share.groupBy("query_id").agg((F.count("__g") / F.greatest(F.lit(1), F.count("*"))).alias("graph_share"))
    return context.join(share, "query_id", "left")


def merge_entities(incoming: DataFrame, stored: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Generic nodes by (label, name): properties are a map, set key by key, the last write of each key wins; chapter too."""
    rows = incoming.select("label", "name", "chapter", "properties", F.col(order).cast("long").alias("o"))
    if stored is not None:
        rows = rows.unionByName(stored.select("label", "name", "chapter", "properties", F.lit(-1).cast("long").alias("o")))
    keys = rows.select("label", "name", "o", F.explode("properties").alias("p", "v")).groupBy("label", "name", "p").agg(F.max_by("v", "o").alias("v"))
    maps = keys.groupBy("label", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "v")))).alias("properties"))
    last = rows.groupBy("label", "name").agg(F.max_by("chapter", "o").alias("chapter"))
    empty = F.create_map().cast("map<string,string>")
    return last.join(maps, ["label", "name"], "left").withColumn("properties", F.coalesce("properties", empty))


def merge_relationships(incoming: DataFrame, entities: DataFrame, order: str = "seq") -> DataFrame:
    """Generic edges (source label and name, type, target label and name): both ends are matched by name, so a name that
    stands under several labels gives an edge for each; the last write's properties win."""
    last = incoming.groupBy("source", "rel_type", "target").agg(F.max_by("properties", order).alias("properties"))
    ends = entities.select("label", "name").distinct()
    there = last.join(ends.select(F.col("label").alias("source_label"), F.col("name").alias("source")), "source")
    return there.join(ends.select(F.col("label").alias("target_label"), F.col("name").alias("target")), "target").select("source_label", "source", "rel_type", "target_label", "target", "properties")
