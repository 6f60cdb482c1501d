"""A stored positional index for lexical search: written once, searched by any number of question batches without the texts.

Three Parquet tables in one folder:

    postings   partitioned by bucket of the term, sorted by term: (term, chunk_id, tf, size, gaps), gaps being the first place and the
               distances to each next one
    terms      (term, bucket, df)
    about      one row: chunks, mean size, stem

A search reads the buckets of its terms, and in them the row groups that can hold them. Questions whose terms must all match begin with
their rarest term: only its rows are looked up for the other terms, so a frequent term costs what the rarest one beside it has. Scores
and results are those of retrieval.lexical_search and cover_density; with stem=True words are taken by their English stems on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.stem import stem as stem_word
from tessera.operators.retrieval import K1, STOP_WORDS, B, _density, by_text, pieces, rank_texts, small, top_k
from tessera.scratch import materialize

BUCKETS = 64
#: Terms up to which a scan is told them, so that row groups without one aren't read.
TOLD_TERMS = 1000
#: Postings that a task sorts when an index is written.
ROWS_PER_TASK = 2_000_000


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(stem: bool):
    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        find = re.compile("[a-z0-9]+").findall
        for b in (p for whole in batches for p in pieces(whole)):
            rows, terms, tfs, sizes, gaps, at = [], [], [], [], [], [0]
            for i, said in enumerate(b.column(1).to_pylist()):
                words = find(said or "")
                places: dict[str, list[int]] = {}
                for p, w in enumerate(words):
                    places.setdefault(stem_word(w) if stem else w, []).append(p)
                rows += [i] * len(places)
                sizes += [len(words)] * len(places)
                for term, ps in places.items():
                    terms.append(term)
                    tfs.append(len(ps))
                    gaps += [ps[0], *(y - x for x, y in zip(ps, ps[1:], strict=False))]
                    at.append(len(gaps))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gaps, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(0).take(pa.array(rows, pa.int32())), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["term", "chunk_id", "tf", "size", "gaps"])

    return run


def build_index(corpus: DataFrame, path: str, *, stem: bool = False, id_col: str = "chunk_id", text_col: str = "content") -> TextIndex:
    """Writes an index of corpus(id, text) to a new folder; null and empty texts count as chunks of no words."""
    spark = corpus.sparkSession
    kind = corpus.schema[id_col].dataType.simpleString()
    lowered = corpus.select(F.col(id_col).alias("chunk_id"), F.lower(text_col).alias("said"))
    rows = materialize(lowered.mapInArrow(_postings(stem), f"term string, chunk_id {kind}, tf long, size long, gaps array<int>"), "text-postings")
    placed = rows.withColumn("bucket", _bucket("term"))
    # the hash lets a frequent term have several files; a task sorts ROWS_PER_TASK rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_TASK)
    placed.repartitionByRange(tasks, "bucket", "term", F.xxhash64("chunk_id")).sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    terms = placed.groupBy("term", "bucket").agg(F.count("*").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    chunks = corpus.count()
    total = rows.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    spark.createDataFrame([(chunks, total / max(1, chunks), stem, kind)], "chunks long, mean double, stem boolean, kind string").coalesce(1).write.parquet(f"{path}/about")
    return TextIndex.open(spark, path)


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    chunks: int
    mean: float
    stem: bool
    kind: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        a = spark.read.parquet(f"{path}/about").first()
        return cls(spark, path, a["chunks"], a["mean"], a["stem"], a["kind"])

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, n_terms, bucket, df, place): a question's distinct terms, the rarest first; df is null where no chunk has it."""
        words = F.array_except(F.array_distinct(tx.terms("question")), F.array(*[F.lit(w) for w in STOP_WORDS]))
        if self.stem:
            stems = F.pandas_udf(lambda s: s.map(lambda ws: list(dict.fromkeys(map(stem_word, ws))) if ws is not None else []), "array<string>")
            words = stems(words)
        listed = queries.select("query_id", words.alias("t")).select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
        known = self.spark.read.parquet(f"{self.path}/terms")
        found = small(listed).join(known.drop("bucket"), "term", "left").withColumn("bucket", _bucket("term"))
        order = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("df"), "term")
        return materialize(found.withColumn("place", F.row_number().over(order)), "asked-terms")

    def postings(self, asked: DataFrame) -> DataFrame:
        """The postings table, of the buckets and, if they are few, the terms that are asked for."""
        rows = self.spark.read.schema(f"term string, chunk_id {self.kind}, tf long, size long, gaps array<int>, bucket int").parquet(f"{self.path}/postings")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        terms = [r[0] for r in asked.select("term").distinct().limit(TOLD_TERMS + 1).collect()]
        rows = rows.where(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else rows
        return rows.where(F.col("term").isin(terms)) if len(terms) <= TOLD_TERMS else rows

    def _idf(self) -> Column:
        return F.log(1 + (F.lit(self.chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def _weight(self) -> Column:
        return self._idf() * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(self.mean or 1.0)))

    def _all(self, asked: DataFrame, *columns: str) -> DataFrame:
        """(query_id, chunk_id, n_terms, df, columns of the postings): rows of the chunks that may have all of a question's terms."""
        lost = asked.where("df is null").select("query_id").distinct()
        mine = asked.where("df is not null").join(lost, "query_id", "left_anti")
        rarest, rest = mine.where("place = 1"), mine.where("place > 1")
        wanted = ["query_id", "chunk_id", "n_terms", "df", *columns]
        first = materialize(self.postings(rarest).join(small(rarest.select("query_id", "term", "n_terms", "df")), "term").select(*wanted), "rarest")
        looked = first.select("query_id", "chunk_id").join(small(rest.select("query_id", "term", "n_terms", "df")), "query_id")
        other = self.postings(rest).join(looked, ["term", "chunk_id"]).select(*wanted)
        return first.unionByName(other)

    def search(self, queries: DataFrame, k: int = 5, *, all_terms: bool = True) -> DataFrame:
        """(query_id, chunk_id, score, rank) by BM25: chunks with all terms of a question, or any."""
        asked = self.asked(queries)
        if not all_terms:  # a posting is shuffled once, whatever number of questions has its term, and texts are ranked where they meet
            known = asked.where("df is not null")
            rows = self.postings(known).join(small(known.select("term").distinct()), "term", "left_semi")
            return rank_texts(known.select("query_id", "term", "n_terms", self._idf().alias("idf")), by_text(rows, self.chunks), self.mean or 1.0, k, False)
        rows = self._all(asked, "tf", "size")
        scored = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(self._weight()), 6).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
        return top_k(scored.where("hits = n_terms").select("query_id", "chunk_id", "score"), k)

    def cover_density(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The chunks with all terms ranked by cover density: each shortest span that holds all terms adds 1 over its length."""

        @F.pandas_udf("double")
        def density(lists: pd.Series) -> pd.Series:
            return lists.map(lambda gaps: _density([np.cumsum(g).tolist() for g in gaps]))

        rows = self._all(self.asked(queries), "gaps").groupBy("query_id", "chunk_id").agg(F.collect_list("gaps").alias("lists"), F.first("n_terms").alias("n_terms"))  # a list for each term of the question
        scored = rows.where(F.size("lists") == F.col("n_terms")).withColumn("d", density("lists"))
        return top_k(scored.select("query_id", "chunk_id", F.round("d", 6).alias("score")), k)
