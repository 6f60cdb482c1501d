"""Search: batches of questions against a corpus, best rows per question.

Vectors: questions go through in blocks of bounded size; each block is broadcast, every task keeps the best rows per
question of its own part, and only those are shuffled. Lexical: the corpus is reduced to the questions' terms, text by text,
and ranked in the same way. Rankings break ties by id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.scratch import materialize

#: Question vectors that are broadcast at once (at 1,024 dimensions 16 MB).
QUERY_BLOCK = 4096
#: Rows up to which a side is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 50_000
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()  # fixed value: the usual English list
K1, B = 1.2, 0.75


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_search(
    queries: DataFrame, corpus: DataFrame, k: int = 5, *, min_score: float | None = None, tenant: bool = False, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int = 6
) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine neighbours of queries(query_id, qvec[, tenant_id]).

    With tenant, only rows of a question's own tenant_id are compared. Filters belong on corpus, before this.
    min_score applies before the ranking. Vectors of norm 0 score 0. Null vectors are left out.
    """
    spark = corpus.sparkSession
    asked = queries.where(F.col("qvec").isNotNull()).orderBy("query_id").select("query_id", "qvec", *(["tenant_id"] if tenant else []))
    rows = corpus.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("c"), F.col(vector_col).alias("v"), *([F.col("tenant_id").alias("t")] if tenant else []))
    return _by_blocks(asked, rows, "c", k, lambda block: _nearest(spark.sparkContext.broadcast(block), k, min_score, tenant, digits))


def _by_blocks(asked: DataFrame, rows: DataFrame, id_col: str, k: int, search: Callable) -> DataFrame:
    """(query_id, chunk_id, score, rank): what search(block) finds in rows by mapInArrow, for each block of asked(query_id, ...)."""
    schema, found = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {rows.schema[id_col].dataType.simpleString()}, score double", None
    for block, last in _blocks(asked.toLocalIterator()):
        best = top_k(rows.mapInArrow(search(block), schema), k)
        if not (last and found is None):  # of several blocks each is written, so the driver holds one
            best = materialize(best, "nearest")
        found = best if found is None else found.unionByName(best)
    return rows.sparkSession.createDataFrame([], f"{schema}, rank int") if found is None else found


def _blocks(rows: Iterator) -> Iterator[tuple[list, bool]]:
    """Blocks of at most QUERY_BLOCK rows, and if that is the last one."""
    block: list[tuple] = []
    for row in rows:
        if len(block) == QUERY_BLOCK:
            yield block, False
            block = []
        block.append(tuple(row))
    if block:
        yield block, True


#: Rows whose scores against a block of questions are held at once (at 4,096 questions 8 MB).
TILE = 256


class _Best:
    """The k best rows of each question that a task has seen; what is under a full question's floor needn't be added."""

    def __init__(self, questions: int, k: int, least: float = -np.inf):
        self.k, self.questions, self.floor = k, questions, np.full(questions, least)
        self.of, self.score, self.chunk = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)

    def add(self, of: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        self.of, self.score, self.chunk = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.chunk, chunk])
        if len(self.of) > 4 * self.k * self.questions + (1 << 16):
            self.cut()

    def cut(self) -> None:
        """Only the k best of each question stay, by score and then by id."""
        ids = self.chunk.astype(str) if len(self.chunk) and isinstance(self.chunk[0], str) else self.chunk.astype(np.int64)
        order = np.lexsort((ids, -self.score, self.of))
        starts = np.searchsorted(self.of[order], np.arange(self.questions))
        order = order[np.arange(len(order)) - starts[self.of[order]] < self.k]
        self.of, self.score, self.chunk = self.of[order], self.score[order], self.chunk[order]
        full = np.bincount(self.of, minlength=self.questions) == self.k
        least = np.full(self.questions, np.inf)
        np.minimum.at(least, self.of, self.score)
        self.floor[full] = np.maximum(self.floor[full], least[full])

    def batches(self, ids: list, qkind, kind) -> Iterator:
        import pyarrow as pa

        self.cut()
        for low in range(0, len(self.of), 1 << 16):
            of, chunk, score = (x[low : low + (1 << 16)] for x in (self.of, self.chunk, self.score))
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in of.tolist()], qkind), pa.array(chunk.tolist(), kind), pa.array(score)], names=["query_id", "chunk_id", "score"])


def _objects(column) -> np.ndarray:
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def _nearest(block, k: int, min_score: float | None, tenant: bool, digits: int, goes=None):
    """goes: (centers, question x cell) of an inverted file; rows are then compared with the questions that go to their cell only."""

    def run(batches: Iterator) -> Iterator:
        ids = [r[0] for r in block.value]
        q = np.array([r[1] for r in block.value], dtype=np.float64)
        size = np.linalg.norm(q, axis=1)
        q = (q / np.where(size == 0, 1, size)[:, None]).T
        tenants = np.array([str(r[2]) for r in block.value]) if tenant else None
        best, kind = _Best(len(ids), k, -np.inf if min_score is None else min_score), None

        for b in batches:
            kind = b.schema.field(0).type
            for low in range(0, b.num_rows, TILE):
                part = b.slice(low, TILE)
                v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(part.num_rows, -1)
                n = np.linalg.norm(v, axis=1)
                v = v / np.where(n == 0, 1, n)[:, None]
                s = np.round(v @ q, digits)
                if tenant:
                    s[np.array([str(x) for x in part.column(2).to_pylist()])[:, None] != tenants] = -np.inf
                if goes is not None:
                    s[~goes.value[1][:, (v @ goes.value[0].T).argmax(axis=1)].T] = -np.inf
                i, j = np.nonzero((s >= best.floor) & (s > -np.inf))
                best.add(j, s[i, j], _objects(part.column(0))[i])
        if kind is not None:
            yield from best.batches(ids, None, kind)

    return run


def ivf_search(queries: DataFrame, corpus: DataFrame, k: int = 5, *, lists: int = 16, probes: int = 12, sample: int = 20_000, seed: int = 7, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Approximate neighbours: an inverted file of k-means cells, fitted on a bounded sample; every row is in one cell.

    probes plays the part of ef_search: more cells, more recall. Questions go to their nearest cells only. They go through in blocks that
    are broadcast with their cells; a row's cell is found where it is read, so rows aren't shuffled, only each task's k best are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tessera.functions.vectors import l2_normalize

    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v"))
    unit = rows.select("chunk_id", l2_normalize("v").alias("v"))
    fit_on = unit.orderBy(F.xxhash64("chunk_id")).limit(sample).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    centers = np.array([np.asarray(c) for c in KMeans(k=lists, seed=seed, maxIter=10).fit(fit_on).clusterCenters()])
    size = np.linalg.norm(centers, axis=1)
    centers = centers / np.where(size == 0, 1, size)[:, None]

    def near(block: list):
        q = np.array([r[1] for r in block], dtype=np.float64)
        goes = np.zeros((len(q), len(centers)), dtype=bool)
        np.put_along_axis(goes, np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        return _nearest(spark.sparkContext.broadcast(block), k, None, False, 6, spark.sparkContext.broadcast((centers, goes)))

    asked = queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec").orderBy("query_id")
    return _by_blocks(asked, rows, "chunk_id", k, near)


def query_terms(queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, term, n_terms): distinct terms without stop words; a question of stop words only has none."""
    kept = F.array_except(F.array_distinct(tx.terms(text_col)), F.array(*[F.lit(w) for w in STOP_WORDS]))
    return queries.select("query_id", F.explode(kept).alias("term"), F.size(kept).alias("n_terms"))


#: Bits of a set of terms: its size (128 KB) doesn't depend on the number of terms.
TERM_BITS = 1 << 20
#: The term of the row that each text has in postings.
TEXT = ""


def _term_bits(wanted: DataFrame) -> bytes:
    """The set of wanted(term) as TERM_BITS bits, by the terms' checksums."""
    place = F.crc32(F.col("term").cast("binary")) % TERM_BITS
    words = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))
    out = np.zeros(TERM_BITS // 64, dtype=np.int64)
    for r in words.collect():  # at most TERM_BITS / 64 rows
        out[r["word"]] = r["bits"]
    return out.tobytes()


#: Bytes of text that a task turns into Python's objects at once.
PIECE = 1 << 20


def pieces(batch, column: int = 1) -> Iterator:
    """Slices of an Arrow batch whose texts are PIECE bytes at most; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _counted(bits, listed: bool = False):
    """Counts each text's terms; of a set of bits only the terms in it (and a few more of their checksums) are told. listed: a row for each text."""

    def run(batches: Iterator) -> Iterator:
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        find = re.compile("[a-z0-9]+").findall
        held = None if bits is None else bits.value
        known: dict[str, bool] = {}

        def told(term: str) -> bool:
            if term not in known:
                if len(known) > 300_000:
                    known.clear()
                p = crc32(term.encode()) % TERM_BITS
                known[term] = bool(held[p >> 3] >> (p & 7) & 1)
            return known[term]

        for b in (p for whole in batches for p in pieces(whole)):
            at, terms, tfs, sizes = [0], [], [], []
            for said in b.column(1).to_pylist():
                words = find(said or "")
                counts = [(t, n) for t, n in Counter(words).items() if held is None or told(t)]
                if not listed:
                    counts.insert(0, (TEXT, 1))
                sizes.append(len(words))
                terms += [t for t, _ in counts]
                tfs += [n for _, n in counts]
                at.append(len(terms))
            if listed:
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), *lists], names=["chunk_id", "size", "terms", "tfs"])
            else:
                rows = pa.array(np.repeat(np.arange(b.num_rows, dtype=np.int32), np.diff(at)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int32()).take(rows)], names=["chunk_id", "term", "tf", "size"])

    return run


def postings(corpus: DataFrame, wanted: DataFrame | None = None, *, id_col: str = "chunk_id", text_col: str = "content", listed: bool = False) -> DataFrame:
    """(chunk_id, term, tf, size): a row for each text and term, and one of the term TEXT for each text; listed: (chunk_id, size, terms, tfs), a row for each text.

    With wanted(term) only for those terms (and a few more of their checksums): the set of them is TERM_BITS bits, and no other term
    leaves its task. Counts are made text by text, so the corpus is read once and not shuffled; repeated ids are texts of their own.
    """
    bits = None if wanted is None else corpus.sparkSession.sparkContext.broadcast(_term_bits(wanted))
    kind = corpus.schema[id_col].dataType.simpleString()
    schema = f"chunk_id {kind}, size int, terms array<string>, tfs array<long>" if listed else f"chunk_id {kind}, term string, tf long, size int"
    return corpus.select(F.col(id_col).alias("chunk_id"), F.lower(text_col).alias("said")).mapInArrow(_counted(bits, listed), schema)


def lexical_search(
    queries: DataFrame, corpus: DataFrame | None, k: int = 5, *, all_terms: bool = True, id_col: str = "chunk_id", text_col: str = "content", index: DataFrame | None = None
) -> DataFrame:
    """(query_id, chunk_id, score, rank): rows with all terms of a question (any, if not all_terms), by BM25.

    index: postings of the corpus that several searches share, or that are stored; else those of the questions' terms are made
    and written to the shared folder, as the statistics and the scores both read them. Scores are made text by text where the postings lie.
    """
    asked = query_terms(queries)
    found = question_postings(queries, corpus, id_col=id_col, text_col=text_col) if index is None else index
    if "terms" in found.columns:
        stats, listed = found, found
        each = found.select(F.explode("terms").alias("term"))
    else:
        stats, each, listed = found.where(F.col("term") == TEXT), found.where(F.col("term") != TEXT), by_text(found)
    docs, mean = stats.agg(F.count("*"), F.avg("size")).first()
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rank_texts(asked.join(df, "term").select("query_id", "term", "n_terms", idf.alias("idf")), listed, mean or 1.0, k, all_terms)


#: Texts of a task where postings are shuffled by text.
TEXTS_PER_TASK = 20_000


def by_text(rows: DataFrame, texts: int = 0) -> DataFrame:
    """(chunk_id, size, terms, tfs) of postings(chunk_id, term, tf, size), shuffled; texts: how many there may be, so that no task gets too many."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts // TEXTS_PER_TASK)
    listed = rows.repartition(n, "chunk_id").groupBy("chunk_id", "size").agg(F.collect_list(F.struct("term", "tf")).alias("l"))  # a text's terms
    return listed.select("chunk_id", F.col("size").cast("int").alias("size"), F.col("l.term").alias("terms"), F.col("l.tf").cast("array<long>").alias("tfs"))


def rank_texts(asked: DataFrame, listed: DataFrame, mean: float, k: int, all_terms: bool) -> DataFrame:
    """The k best of listed(chunk_id, size, terms, tfs) by BM25 for each question of asked(query_id, term, n_terms, idf)."""
    spark = listed.sparkSession
    grouped = asked.groupBy("query_id").agg(F.first("n_terms").alias("n_terms"), F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")).orderBy("query_id")
    kind = _arrow(grouped, "query_id")
    return _by_blocks(grouped, listed.select("chunk_id", "size", "terms", "tfs"), "chunk_id", k, lambda block: _bm25(spark.sparkContext.broadcast(block), mean, k, all_terms, kind))


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _by_term(block: list) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Each term's place, and the questions of all terms in a row with where each term's begin."""
    of: dict[str, list[int]] = {}
    for i, r in enumerate(block):
        for t in r[2]:
            of.setdefault(t if isinstance(t, str) else t[0], []).append(i)
    return {t: i for i, t in enumerate(of)}, np.array([q for qs in of.values() for q in qs], dtype=np.int64), np.cumsum([0, *map(len, of.values())])


#: Weights of terms and questions that are added up at once.
WEIGHTS = 1 << 21


def _bm25(block, mean: float, k: int, all_terms: bool, qkind):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        place, questions, starts = _by_term(block.value)
        terms = pa.array(list(place), pa.string())
        idf = np.zeros(len(place))
        for r in block.value:
            for t, x in r[2]:
                idf[place[t]] = x
        ids, need = [r[0] for r in block.value], np.array([r[1] for r in block.value])
        best, kind = _Best(len(ids), k), None

        def score(part) -> None:
            t = pc.fill_null(pc.index_in(part.column(2).flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
            tf, size = part.column(3).flatten().to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            t, doc, tf = t[t >= 0], doc[t >= 0], tf[t >= 0]
            n = starts[t + 1] - starts[t]
            total = int(n.sum())
            if total > WEIGHTS and part.num_rows > 1:
                half = part.num_rows // 2
                score(part.slice(0, half))
                score(part.slice(half))
                return
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
            cell = np.repeat(doc * len(ids), n) + questions[np.repeat(starts[t] - (np.cumsum(n) - n), n) + np.arange(total)]
            cells = part.num_rows * len(ids)
            s, hits = np.round(np.bincount(cell, np.repeat(w, n), cells), 6).reshape(-1, len(ids)), np.bincount(cell, minlength=cells).reshape(-1, len(ids))
            i, j = np.nonzero((hits == need if all_terms else hits > 0) & (s >= best.floor))
            best.add(j, s[i, j], _objects(part.column(0))[i])

        for b in batches:
            kind = b.schema.field(0).type
            for low in range(0, b.num_rows, TILE):
                score(b.slice(low, TILE))
        if kind is not None:
            yield from best.batches(ids, qkind, kind)

    return run


def question_postings(queries: DataFrame, corpus: DataFrame, *, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """postings of the questions' terms, a row for each text, written to the shared folder: an index for searches of these questions."""
    return materialize(postings(corpus, query_terms(queries), id_col=id_col, text_col=text_col, listed=True), "postings")


def cover_density(queries: DataFrame, corpus: DataFrame, k: int = 5, *, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """The same rows ranked by cover density: each shortest span that holds all terms adds 1 over its length. Texts aren't shuffled."""
    spark = corpus.sparkSession
    asked = query_terms(queries).groupBy("query_id").agg(F.first("n_terms").alias("n_terms"), F.sort_array(F.collect_list("term")).alias("t")).orderBy("query_id")
    rows, kind = corpus.select(F.col(id_col).alias("chunk_id"), F.lower(text_col).alias("said")), _arrow(asked, "query_id")
    return _by_blocks(asked, rows, "chunk_id", k, lambda block: _covers(spark.sparkContext.broadcast(block), k, kind))


def _covers(block, k: int, qkind):
    def run(batches: Iterator) -> Iterator:
        import re

        find = re.compile("[a-z0-9]+").findall
        place, questions, starts = _by_term(block.value)
        ids, need = [r[0] for r in block.value], np.array([r[1] for r in block.value])
        best, kind = _Best(len(ids), k), None
        for b in (p for whole in batches for p in pieces(whole)):
            kind = b.schema.field(0).type
            of, score, row = [], [], []
            for i, said in enumerate(b.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                for p, w in enumerate(find(said or "")):
                    if w in place:
                        places.setdefault(w, []).append(p)
                if places:
                    hits = np.bincount(np.concatenate([questions[starts[place[t]] : starts[place[t] + 1]] for t in places]), minlength=len(ids))
                    for j in np.flatnonzero(hits == need).tolist():
                        of.append(j)
                        score.append(_density([places[t] for t in block.value[j][2]]))
                        row.append(i)
            best.add(np.array(of, dtype=np.int64), np.round(np.array(score, dtype=np.float64), 6), _objects(b.column(0))[np.array(row, dtype=np.int64)])
        if kind is not None:
            yield from best.batches(ids, qkind, kind)

    return run


def _density(places: list) -> float:
    marks = sorted((int(p), t) for t, ps in enumerate(places) for p in ps)
    need, total, last = len(places), 0.0, {}
    previous = -1
    for p, t in marks:
        last[t] = p
        if len(last) == need:
            start = min(last.values())
            if start > previous:
                total += 1.0 / (p - start + 1)
                previous = start
    return total


def fuse(ranked: list[DataFrame], weights: list[float] | None = None, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank): sum of weight / (k + rank), best 1; ties keep the first seen."""
    weights = [1.0] * len(ranked) if weights is None else weights
    if len(weights) != len(ranked) or not ranked:
        raise ValueError("one weight for each ranked list")
    tagged = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("branch"), F.lit(float(w)).alias("w")) for i, (r, w) in enumerate(zip(ranked, weights, strict=True))]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    summed = every.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") / (k + F.col("rank"))).alias("raw"), F.min(F.struct("branch", "rank")).alias("seen"), F.sort_array(F.collect_set("branch")).alias("branches")
    )
    best = F.max("raw").over(Window.partitionBy("query_id"))
    scored = summed.withColumn("score", F.round(F.when(best > 0, F.col("raw") / best).otherwise(F.col("raw")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "chunk_id", "score", "rank", "branches")


def hybrid_search(queries: DataFrame, corpus: DataFrame, top: int = 5, *, weights: tuple[float, float] = (0.6, 0.4), k: int = 60, multiplier: int = 4, **columns: str) -> DataFrame:
    """Dense and lexical rankings, each of multiplier times as many rows, fused. The branches run at once."""
    id_col, n = columns.get("id_col", "chunk_id"), top * multiplier
    ranked = at_once(
        queries.sparkSession,
        lambda: materialize(dense_search(queries, corpus, n, id_col=id_col, vector_col=columns.get("vector_col", "embedding")), "dense"),
        lambda: materialize(lexical_search(queries, corpus, n, id_col=id_col, text_col=columns.get("text_col", "content")), "lexical"),
    )
    return fuse(ranked, list(weights), k, top)


def at_once(spark: SparkSession, *calls: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the calls return, in their order; their jobs run side by side, with the local properties of the caller."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def as_results(found: DataFrame, corpus: DataFrame, retriever: str) -> DataFrame:
    """RESULT rows of found(query_id, chunk_id, score, rank): with what corpus(chunk_id, content[, source_uri, section_path, metadata]) says.

    Null source and section are empty, null metadata an empty map.
    """
    held = {"source_uri": F.lit(""), "section_path": F.lit(""), "metadata": F.create_map().cast("map<string,string>")}
    told = corpus.select("chunk_id", "content", *[F.coalesce(F.col(c), empty).alias(c) if c in corpus.columns else empty.alias(c) for c, empty in held.items()])
    rows = found.select("query_id", "chunk_id", "score", "rank").join(told, "chunk_id")
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content"), F.col("score").cast("double").alias("score"), *held, F.lit(retriever).alias("retriever"))


RESULT = "rank int, chunk_id string, content string, score double, source_uri string, section_path string, metadata map<string,string>, retriever string"


def or_empty(search: Callable[[], DataFrame], queries: DataFrame) -> DataFrame:
    """The RESULT rows of a search that is run here, or none and a line in the log if it fails, when it is planned or when it runs."""
    try:
        return materialize(search(), "results")
    except Exception:
        logging.getLogger(__name__).exception("a search failed; it finds nothing")
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {RESULT}")


def multi_query_search(variants: DataFrame, search, top: int = 5, count: int = 3) -> DataFrame:
    """search over each of variants(query_id, variant, question), at twice the rows, fused with equal weights."""
    ranked = [search(variants.where(F.col("variant") == i), 2 * top) for i in range(count + 1)]
    return fuse(ranked, None, 60, top)


def parse_variants(raw: Column | str, n: int = 3) -> Column:
    """The first n lines of a reply, without bullets."""
    lines = F.transform(F.split(F.col(raw) if isinstance(raw, str) else raw, "\n"), lambda x: F.regexp_replace(x, r"^[ \-•\t]+|[ \-•\t]+$", ""))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def fallback(stages: list[DataFrame], queries: DataFrame, min_results: int = 1, min_score: float = 0.35) -> DataFrame:
    """For each question the rows of the first stage with enough rows at min_score; no rows if none has."""
    left, out = queries.select("query_id"), None
    for i, stage in enumerate(stages):
        good = stage.where(F.col("score") >= min_score)
        enough = good.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_results).join(left, "query_id", "left_semi").select("query_id")
        rows = good.join(enough, "query_id", "left_semi").withColumn("stage", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
        left = left.join(enough, "query_id", "left_anti")
    return out


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of common three-letter pieces of two strings, padded as an index on them would be."""
    def grams(c: Column | str) -> Column:
        said = F.concat(F.lit("  "), F.lower(F.col(c) if isinstance(c, str) else c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(said) - 2), lambda i: F.substring(said, i, F.lit(3))))

    return tx.jaccard(grams(a), grams(b))
