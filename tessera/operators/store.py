"""The chunk store: Parquet partitioned by tenant, in snapshots that readers switch to as a whole.

Rows are identified by (tenant_id, content_hash). Parquet has no MERGE, and a path that is read can't be overwritten,
so a write puts the rows of the tenants that it touches, merged, into folder v{n+1} and then names, in CURRENT, the folder
that holds each tenant. CURRENT is written aside and renamed over the old one, so a reader sees one snapshot or the
other; a writer claims the version after the one that it has read by creating a file first, so of two at once the later one fails and
can be repeated: no write is lost.

A write of a large table goes part by part, by the rows' keys, and a part has a folder of its own, so that a write shuffles only a share of
the rows at a time and reads each stored row once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.scratch import file_count, scratch_path, settings, write_settings

KEYS = ["tenant_id", "content_hash"]
#: Folders that a store's tenants are spread over at most.
FOLDERS = 20
#: A write of more than PART_BYTES on disk is cut into PARTS parts; folders and the scratch table name a row's part by this column.
PARTS, PART_BYTES = 8, 64 << 20
PART = f"part_of_{PARTS}"
#: Rows of a page, the least that a read takes of a part; a source's chunks are in all parts.
PAGE_ROWS = 20_000 // PARTS
#: What a repeated write refreshes; the other columns keep their first value.
REFRESHED = ["content", "metadata", "embedding", "embed_model"]


def upsert(stored: DataFrame, incoming: DataFrame, order: str = "position") -> DataFrame:
    """stored with incoming merged in: of equal keys the last by order wins, new values refresh, first ones of the rest stay."""
    columns = stored.columns
    last = incoming.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in columns if c not in KEYS]), order).alias("n"))
    old = stored.select(*KEYS, F.struct(*[c for c in columns if c not in KEYS]).alias("o"))
    joined = old.join(last, KEYS, "full_outer")

    def value(c: str) -> Column:
        if c == "is_active":
            return F.when(F.col("n").isNotNull(), F.lit(True)).otherwise(F.col("o")[c])
        first, then = ("n", "o") if c in REFRESHED else ("o", "n")
        return F.when(F.col(first).isNotNull(), F.col(first)[c]).otherwise(F.col(then)[c])

    return joined.select(*[F.col(c) if c in KEYS else value(c).alias(c) for c in columns])


def chunk_rows(chunks: DataFrame, *, tenant_id: str | Column, chapter: str, embed_model: str) -> DataFrame:
    """Rows of the store from chunks(source_uri, position, content, embedding[, metadata, section_path])."""
    from tessera.functions.scores import content_hash
    from tessera.functions.vectors import l2_normalize

    optional = lambda c, empty: F.col(c) if c in chunks.columns else empty
    return chunks.select(
        (F.lit(tenant_id) if isinstance(tenant_id, str) else tenant_id).alias("tenant_id"), F.lit(chapter).alias("chapter"), "source_uri",
        optional("section_path", F.lit("")).alias("section_path"), "content", content_hash("source_uri", "position", "content").alias("content_hash"),
        optional("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), l2_normalize("embedding").alias("embedding"),
        F.lit(embed_model).alias("embed_model"), F.lit(True).alias("is_active"), F.current_timestamp().alias("created_at"), "position",
    )


def _part() -> Column:
    """The part of a row, by its key: rows that a merge puts together are in one part."""
    return F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("int")


class ChunkStore:
    """A table of chunks at a path. Every read names its tenant."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("CURRENT").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs().create(self._path(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _current(self) -> tuple[int, dict[str | None, int]]:
        """The version, and that of the folder which holds each tenant."""
        if not self._fs().exists(self._path("CURRENT")):
            return 0, {}
        held = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).collect()))
        return held["version"], dict(held["tenants"])

    def version(self) -> int:
        return self._current()[0]

    def _rows(self, tenants: list | None = None, held: dict | None = None, part: int | None = None) -> DataFrame:
        """The rows of some tenants, or all; each folder is read for the tenants that it is named for (held: by a snapshot that was read).
        part: only those of a part."""
        place: dict[int, list] = {}
        for tenant, v in (self._current()[1] if held is None else held).items():
            if tenants is None or tenant in tenants:
                place.setdefault(v, []).append(tenant)
        # a table that the optimizer knows to be empty: a first write joins with nothing, and a read is its folders' scans alone
        out = self.spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schemas.CHUNKS)])
        for v, mine in sorted(place.items()):
            rows = self.spark.read.schema(schemas.CHUNKS).parquet(f"{self.path}/v{v}")
            named = F.col("tenant_id").isin([t for t in mine if t is not None])
            rows = rows.where(named | F.col("tenant_id").isNull() if None in mine else named)
            rows = rows if part is None else rows.where((F.col(PART) if PART in rows.columns else _part()) == part)
            out = out.unionByName(rows.select(*out.columns))
        return out

    def _drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _bytes(self, tenants: list, held: dict) -> int:
        """What some tenants' rows take on disk."""
        todo, total = [(v, self._path(f"v{v}")) for v in {held[t] for t in tenants if t in held}], 0
        while todo:
            v, at = todo.pop()
            for x in self._fs().listStatus(at):
                kind, _, name = x.getPath().getName().partition("=")
                if kind.startswith("part_of_"):
                    todo.append((v, x.getPath()))
                elif kind == "tenant_id":
                    tenant = None if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)
                    total += self._fs().getContentSummary(x.getPath()).getLength() if tenant in tenants and held.get(tenant) == v else 0
        return total

    def _switch(
        self, read: tuple[int, dict], rows: DataFrame | Callable[[int | None], DataFrame], tenants: list, size: int = 0, done: Callable[[int | None], None] = lambda part: None
    ) -> None:
        """The rows of these tenants, made from the snapshot read, from now on; when FOLDERS folders are in use all tenants' rows are put into
        the new one. rows: of a part, or all if that is None. size: their bytes on disk. done: called when a part is written."""
        version, held = read[0] + 1, dict(read[1])
        self._put(f"claims/v{version}", "", False)  # fails if another writer has claimed it, and so if one has switched since
        try:
            others = [t for t in held if t not in tenants] if len({*held.values()}) >= FOLDERS else []
            size += self._bytes(others, held)
            self._drop(f"v{version}")  # what a write that failed has left
            for part in range(PARTS) if callable(rows) and size > PART_BYTES else [None]:
                table = rows(part) if callable(rows) else rows
                table = table.unionByName(self._rows(others, held, part)) if others else table
                # a file has a narrow range of sources and a filter of them, so that a read of one source skips what can't hold it
                placed = table.repartitionByRange("tenant_id", "chapter", "source_uri").sortWithinPartitions("tenant_id", "chapter", "source_uri")
                out = placed.write.options(**{"compression": "zstd", "parquet.bloom.filter.enabled#source_uri": "true", "parquet.page.row.count.limit": str(PAGE_ROWS)})
                with settings(self.spark, write_settings(self.spark, 1 if part is None else PARTS)):
                    out.partitionBy("tenant_id", "chapter").parquet(f"{self.path}/v{version}" if part is None else f"{self.path}/v{version}/{PART}={part}")
                done(part)
            tenants = [*tenants, *others]
            held |= dict.fromkeys(tenants, version)
            self._put(f"CURRENT-{version}", json.dumps({"version": version, "tenants": list(held.items())}), True)
            fs = self.spark._jvm.org.apache.hadoop.fs
            over = self.spark._sc._gateway.new_array(fs.Options.Rename, 1)
            over[0] = fs.Options.Rename.OVERWRITE
            fs.FileContext.getFileContext(self._path("CURRENT").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(f"CURRENT-{version}"), self._path("CURRENT"), over)
        except BaseException:
            self._fs().delete(self._path(f"claims/v{version}"), False)
            raise

    def write(self, incoming: DataFrame) -> int:
        """Merges rows of chunk_rows; returns how many were processed. The incoming plan runs once."""
        path = scratch_path(self.spark, "incoming")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            cut = incoming.withColumn(PART, _part())
            cut.coalesce(file_count(incoming)).write.option("compression", "zstd").partitionBy(PART).parquet(path)
            rows = self.spark.read.schema(cut.schema).parquet(path)
            counts = rows.groupBy("tenant_id").count().collect()  # a row per tenant written
            if counts:
                tenants, read = [r[0] for r in counts], self._current()
                new = lambda part: rows if part is None else rows.where(F.col(PART) == part)
                merged = lambda part: upsert(self._rows(tenants, read[1], part), new(part))
                size = fs.getContentSummary(at).getLength() + self._bytes(tenants, read[1])
                self._switch(read, merged, tenants, size, lambda part: fs.delete(at if part is None else at.suffix(f"/{PART}={part}"), True))
        finally:
            fs.delete(at, True)
        return sum(r[1] for r in counts)

    def drop_superseded(self) -> int:
        """Deletes the folders that the current snapshot doesn't name, once no reader of an earlier one is left; returns how many. Those of
        writers at work stay."""
        version, held = self._current()
        names = [x.getPath().getName() for x in self._fs().listStatus(self._path(""))] if version else []
        old = [x for x in names if re.fullmatch(r"v\d+", x) and int(x[1:]) <= version and int(x[1:]) not in held.values()]
        for x in old:
            self._drop(x)
        return len(old)

    def read(self, tenant_id: str, chapter: str | None = None, active: bool = True, sources: list[str] | None = None) -> DataFrame:
        """A tenant's chunks: partitions are pruned before anything is ranked, and for some sources the row groups without them."""
        rows = self._rows([tenant_id])
        rows = rows.where("is_active") if active else rows
        rows = rows if sources is None else rows.where(F.col("source_uri").isin(sources))
        return rows if chapter is None else rows.where(F.col("chapter") == chapter)

    def delete(self, tenant_id: str, chapter: str, soft: bool = False) -> int:
        read = self._current()
        hit = F.col("chapter") == chapter

        def left(part: int | None) -> DataFrame:
            every = self._rows([tenant_id], read[1], part)
            return every.withColumn("is_active", F.col("is_active") & ~hit) if soft else every.where(~hit)

        n = self._rows([tenant_id], read[1]).where(hit).count()
        if n:
            self._switch(read, left, [tenant_id], self._bytes([tenant_id], read[1]))
        return n

    def count(self, tenant_id: str, chapter: str | None = None) -> int:
        return self.read(tenant_id, chapter).count()


def metadata_matches(metadata: Column | str, wanted: dict[str, str]) -> Column:
    """Equality on all keys of a filter."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & (F.coalesce(m[key], F.lit("\0")) == value)
    return out


def json_contains(doc: Column | str, wanted: object, at: str = "$") -> Column:
    """Deep containment in a variant: objects by key, arrays by membership, scalars by value."""
    d = F.col(doc) if isinstance(doc, str) else doc
    if isinstance(wanted, dict):
        out = F.lit(True)
        for key, value in wanted.items():
            out = out & json_contains(d, value, f"{at}[{json.dumps(str(key), ensure_ascii=False)}]")
        return out
    if isinstance(wanted, list):
        out = F.lit(True)
        for value in wanted:
            held = F.try_variant_get(d, at, "array<string>")
            out = out & F.coalesce(F.array_contains(held, str(value)), F.lit(False))
        return out
    text = str(wanted).lower() if isinstance(wanted, bool) else str(wanted)
    return F.coalesce(F.try_variant_get(d, at, "string") == text, F.lit(False))


def assert_embedding_model(chunks: DataFrame, expected: str) -> None:
    """Raises if rows were embedded by another model than expected."""
    other = [r[0] for r in chunks.select("embed_model").distinct().where(~F.col("embed_model").eqNullSafe(F.lit(expected))).limit(10).collect()]
    if other:
        raise ValueError(f"embedded by {other}, expected {expected}")


def golden_labels(cases: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """For each case its top chunks by distinctive terms in common; grade 2 for the first, else 1; ties by larger id.

    Terms are joined on, so cases and chunks without one in common never meet.
    """
    from pyspark.sql import Window

    from tessera.functions.text import distinctive_terms

    asked = cases.select("case_id", F.explode(distinctive_terms(F.concat_ws(" ", "question", "expected_answer"))).alias("term"))
    held = chunks.select("chunk_id", F.explode(distinctive_terms("content")).alias("term"))
    overlap = asked.join(held, "term").groupBy("case_id", "chunk_id").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("case_id").orderBy(F.desc("overlap"), F.desc("chunk_id"))
    ranked = overlap.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.withColumn("grade", F.when(F.col("rank") == 1, 2).otherwise(1))
