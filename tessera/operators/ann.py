"""Approximate vector search over a stored index: an inverted file of cells with product-quantized residuals.

The index is five Parquet tables in one folder, written once and searched by any number of question batches:

    codes      partitioned by group of cells: (cell, chunk_id[, tenant_id], code), a byte for each part of a vector
    vectors    partitioned alike: (cell, chunk_id, vector), the unit vectors that the last step compares exactly
    cells      (cell, center)
    books      (part, code, center): for each part of a residual its codebook
    about      one row: vectors, dimensions, parts, groups

Cells grow with the root of the corpus. Both k-means are fitted on a bounded sample, those rows with the least hash of their id: the
cells by Spark ML, the codebooks in one task for each part. A vector is stored as its cell and the codes of what it differs from the
cell's center. A search compares questions with centers, takes for each the nearest cells, adds up table entries for the codes of
their rows, keeps ``rerank`` candidates a question, and compares only their vectors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.retrieval import _blocks, small, top_k
from tessera.scratch import materialize

#: Rows that both k-means are fitted on; entries of a codebook; cells, and folders that they are spread over, at most.
SAMPLE, CODES, MOST_CELLS, GROUPS = 65_536, 256, 16_384, 256
#: Share of the cells that a question goes to.
PROBED = 0.6
#: Rows of codes that are scored at once in a task.
TILE = 4096


def kmeans(rows: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    """Centers of at most k clusters, by Lloyd's steps from different rows."""
    different = np.unique(rows, axis=0)
    centers = different[np.random.default_rng(seed).choice(len(different), min(k, len(different)), replace=False)].astype(np.float64)
    for _ in range(steps):
        near = nearest(rows, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    out = np.empty(len(rows), dtype=np.int64)
    for a in range(0, len(rows), 8192):
        out[a : a + 8192] = (rows[a : a + 8192] @ centers.T - half).argmax(axis=1)
    return out


def _unit(column) -> np.ndarray:
    """The vectors of an Arrow list column, of norm 1 (or 0)."""
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n == 0, 1, n)[:, None]


def _encode(held, dims: int, tenant: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centers, books, per_group = held.value
        width = dims // len(books)
        for b in batches:
            if not b.num_rows:
                continue
            v = _unit(b.column("v"))
            cell = nearest(v, centers)
            rest = v - centers[cell]
            code = np.stack([nearest(rest[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
            names = ["grp", "cell", "chunk_id", *(["tenant_id"] if tenant else []), "code", "vector"]
            flat = pa.array(v.astype(np.float32).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims), pa.int32()), flat)
            more = [b.column("tenant_id")] if tenant else []
            yield pa.RecordBatch.from_arrays([pa.array(cell // per_group, pa.int32()), pa.array(cell, pa.int32()), b.column("chunk_id"), *more, pa.array([c.tobytes() for c in code], pa.binary()), vectors], names=names)

    return run


def build_index(corpus: DataFrame, path: str, *, parts: int | None = None, cells: int | None = None, sample: int = SAMPLE, seed: int = 7, id_col: str = "chunk_id", vector_col: str = "embedding") -> VectorIndex:
    """Writes an index of corpus(id, vector[, tenant_id]) to a new folder. Rows without a vector are left out; repeated rows stay.

    parts has to divide the dimensions; by default a part is four of them, or what of 2 and 1 divides them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tessera.functions.vectors import l2_normalize

    spark = corpus.sparkSession
    tenant = "tenant_id" in corpus.columns
    rows = corpus.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<float>").alias("v"), *(["tenant_id"] if tenant else []))
    kind = corpus.schema[id_col].dataType.simpleString()
    n, dims, narrowest = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors to index")
    if dims != narrowest:
        raise ValueError(f"vectors of {narrowest} and of {dims} dimensions")
    width = dims // parts if parts else next(w for w in (4, 2, 1) if dims % w == 0)
    if width * (parts or dims // width) != dims:
        raise ValueError(f"{parts} parts don't divide {dims} dimensions")
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, n)

    unit = rows.select("chunk_id", l2_normalize("v").cast("array<double>").alias("v"))
    fit_on = materialize(unit.orderBy(F.xxhash64("chunk_id"), F.xxhash64("v")).limit(sample).select("v"), "ann-sample", rows=min(n, sample))
    if cells > 1:
        features = fit_on.select(array_to_vector("v").alias("features"))
        centers = np.array([np.asarray(c) for c in KMeans(k=cells, seed=seed, maxIter=12).fit(features).clusterCenters()])
    else:
        centers = np.array(fit_on.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dims)])).first()[0])[None]
    held = spark.sparkContext.broadcast(centers)

    def residual_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["v"].tolist())
            rest = v - held.value[nearest(v, held.value)]
            for p in range(dims // width):
                yield pd.DataFrame({"part": p, "v": list(rest[:, p * width : (p + 1) * width])})

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.array(rows["v"].tolist())
        v = v[np.lexsort(v.T)]  # whatever order the rows come in
        found = kmeans(v, CODES, seed)
        return pd.DataFrame({"part": int(rows["part"].iloc[0]), "code": np.arange(len(found)), "center": list(found)})

    # a part's rows are the sample's, so a task holds at most sample rows of width numbers
    residuals = fit_on.mapInPandas(residual_parts, "part int, v array<double>")
    residuals.groupBy("part").applyInPandas(book, "part int, code int, center array<double>").coalesce(1).write.parquet(f"{path}/books")
    groups = min(GROUPS, len(centers))
    per_group = -(-len(centers) // groups)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/cells")
    books = _books(spark, path)
    encoder = _encode(spark.sparkContext.broadcast((centers, books, per_group)), dims, tenant)
    more = "tenant_id string, " if tenant else ""
    coded = materialize(rows.mapInArrow(encoder, f"grp int, cell int, chunk_id {kind}, {more}code binary, vector array<float>"), "ann-codes")
    # rows of a cell lie together, so a search's cells prune folders and row groups; the hash lets a large cell have several files
    placed = coded.repartitionByRange("grp", "cell", F.xxhash64("chunk_id")).sortWithinPartitions("grp", "cell", "chunk_id")
    placed.drop("vector").write.partitionBy("grp").parquet(f"{path}/codes")
    placed.select("grp", "cell", "chunk_id", "vector").write.partitionBy("grp").parquet(f"{path}/vectors")
    spark.createDataFrame([(n, dims, dims // width, per_group, kind, tenant)], "vectors long, dims int, parts int, per_group int, kind string, tenant boolean").coalesce(1).write.parquet(f"{path}/about")
    return VectorIndex.open(spark, path)


def _books(spark: SparkSession, path: str) -> list[np.ndarray]:
    found: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/books").orderBy("part", "code").collect():  # parts x 256 rows
        found.setdefault(r["part"], []).append(r["center"])
    return [np.array(found[p]) for p in sorted(found)]


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    vectors: int
    dims: int
    per_group: int
    kind: str
    tenant: bool
    centers: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        a = spark.read.parquet(f"{path}/about").first()
        centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect()])  # at most MOST_CELLS rows
        return cls(spark, path, a["vectors"], a["dims"], a["per_group"], a["kind"], a["tenant"], centers, _books(spark, path))

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"cell int, chunk_id {self.kind}, {columns}, grp int").parquet(f"{self.path}/{name}")

    def candidates(self, queries: DataFrame, rerank: int, probed: float = PROBED, tenant: bool = False) -> DataFrame:
        """(query_id, qvec, cell, chunk_id): for each question the rows of the best estimates in its nearest cells."""
        if tenant and not self.tenant:
            raise ValueError("the index has no tenants")
        qkind = queries.schema["query_id"].dataType.simpleString()
        wanted = queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec", *(["tenant_id"] if tenant else [])).orderBy("query_id")
        codes = self._table("codes", f"{'tenant_id string, ' if self.tenant else ''}code binary")
        probes, out = max(1, round(probed * len(self.centers))), None
        for block, last in _blocks(wanted.toLocalIterator()):
            q = np.array([r[1] for r in block], dtype=np.float64)
            size = np.linalg.norm(q, axis=1)
            q /= np.where(size == 0, 1, size)[:, None]
            order = np.argsort(-(q @ self.centers.T), axis=1, kind="stable")[:, :probes]
            goes = np.zeros((len(q), len(self.centers)), dtype=bool)
            np.put_along_axis(goes, order, True, axis=1)
            cells = np.flatnonzero(goes.any(axis=0))
            rows = codes
            if len(cells) < len(self.centers) and len(cells) <= 2000:  # folders and row groups without a probed cell aren't read
                rows = codes.where(F.col("grp").isin(np.unique(cells // self.per_group).tolist()) & F.col("cell").isin(cells.tolist()))
            sent = self.spark.sparkContext.broadcast((q.astype(np.float32), goes, self.centers.astype(np.float32), [b.astype(np.float32) for b in self.books], [str(r[2]) for r in block] if tenant else None))
            found = rows.select("cell", "chunk_id", "code", *(["tenant_id"] if tenant else [])).mapInArrow(_estimates(sent, rerank), f"place int, cell int, chunk_id {self.kind}, score float")
            best = top_k(found, rerank, by="place").select("place", "cell", "chunk_id")
            names = self.spark.createDataFrame([(i, r[0], [float(x) for x in r[1]]) for i, r in enumerate(block)], f"place int, query_id {qkind}, qvec array<double>")
            mine = best.join(F.broadcast(names), "place").drop("place")  # a block of questions
            if not (last and out is None):
                mine = materialize(mine, "ann-candidates")
            out = mine if out is None else out.unionByName(mine)
        return self.spark.createDataFrame([], f"cell int, chunk_id {self.kind}, query_id {qkind}, qvec array<double>") if out is None else out

    def search(self, queries: DataFrame, k: int = 5, *, rerank: int | None = None, probed: float = PROBED, tenant: bool = False, min_score: float | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries(query_id, qvec[, tenant_id]); scores are exact cosines. Null vectors have no rows.

        rerank: vectors that are compared exactly for each question, ten times k by default.
        """
        found = materialize(self.candidates(queries, rerank or 10 * k, probed, tenant), "ann-candidates")
        place = (F.col("cell") / self.per_group).cast("int")
        near = small(found.select(place.alias("grp"), "cell", "chunk_id", "query_id", "qvec"))
        pairs = self._table("vectors", "vector array<float>").join(near, ["grp", "cell", "chunk_id"])
        scored = pairs.select("query_id", "chunk_id", F.round(cosine("qvec", "vector"), 6).alias("score"))
        return top_k(scored if min_score is None else scored.where(F.col("score") >= min_score), k)


def _estimates(held, rerank: int):
    """The rerank best rows of a task's codes for each question that goes to their cells, by table look-ups."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        q, goes, centers, books, tenants = held.value
        width = q.shape[1] // len(books)
        tables = [q[:, p * width : (p + 1) * width] @ book.T for p, book in enumerate(books)]  # question x code
        coarse = q @ centers.T
        of, score, row = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        cells, ids, kind = np.zeros(0, np.int64), [], None

        def keep() -> None:
            nonlocal of, score, row, cells, ids
            order = np.lexsort((row, -score, of))
            starts = np.searchsorted(of[order], np.arange(len(q)))
            order = order[np.arange(len(order)) - starts[of[order]] < rerank]
            of, score, row = of[order], score[order], row[order]
            used, row = np.unique(row, return_inverse=True)
            cells, ids = cells[used], [ids[i] for i in used.tolist()]

        for b in batches:
            kind = b.column(1).type
            for low in range(0, b.num_rows, TILE):
                part = b.slice(low, TILE)
                cell = part.column(0).to_numpy().astype(np.int64)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                est = coarse[:, cell]
                for p, table in enumerate(tables):
                    est += table[:, code[:, p]]
                ok = goes[:, cell]
                if tenants is not None:
                    ok &= np.array(tenants)[:, None] == np.array([str(t) for t in part.column(3).to_pylist()])[None]
                est[~ok] = -np.inf
                if est.shape[1] > rerank:  # only what can be among the best of this tile
                    floor = np.partition(est, est.shape[1] - rerank, axis=1)[:, -rerank]
                    ok &= est >= floor[:, None]
                i, j = np.nonzero(ok)
                of, score, row = np.concatenate([of, i]), np.concatenate([score, est[i, j]]), np.concatenate([row, j + len(ids)])
                cells = np.concatenate([cells, cell])
                ids += part.column(1).to_pylist()
                keep()
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(cells[row], pa.int32()), pa.array([ids[i] for i in row.tolist()], kind), pa.array(score)], names=["place", "cell", "chunk_id", "score"])

    return run
