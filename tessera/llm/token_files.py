"""Token ids in Arrow IPC files: fixed-size-list batches of equal-length sequences with masks.

A shard is ``shard-NNNNN.arrow``, an Arrow IPC file (the stream format with a footer). Its rows are sequences
of ``seq_len`` ids, ``ids: fixed_size_list<uint16 or uint32>[seq_len]`` and ``mask: fixed_size_list<bool>[seq_len]``;
documents follow each other without gaps and only the last sequence of a shard is padded (mask false). All
batches but the last hold ``BATCH_ROWS`` sequences, so sequence r is row r % BATCH_ROWS of batch
r // BATCH_ROWS and a memory map gives it without copying. ``shard-NNNNN.docs.arrow`` lists the shard's
documents with the place of their first id. Shards are in ascending order of the document id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import text_batches
from pyspark.sql import types as T

BATCH_ROWS = 256
#: Shards of a range of ids at most, and documents of a shard.
PARTS, SHARD_DOCS = 10_000, 1 << 20
MANIFEST = "shard int, docs long, tokens long"


def _open(path: str):
    """A pyarrow file system and the path on it; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _name(folder: str, shard: int, kind: str = "") -> str:
    return f"{folder}/shard-{shard:05d}{kind}.arrow"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = 2, seq_len: int = 2048, shards: int | None = None, shard_tokens: int = 1 << 26,
) -> list:
    """Encode every text and write the shards; returns one row per shard (shard, docs, tokens), in order.

    Ids are dealt to ``shards`` ranges (the shuffle partitions by default), and a range is cut into shards, numbered
    PARTS * range + part, behind the document that reaches shard_tokens ids or SHARD_DOCS documents: what a task holds is
    bounded by that and by one document, however long. Null or empty texts are just their end id. A null document id
    comes first; rows with the same id follow each other by text. Other columns are ignored, whatever their names. An empty table gives no shard.
    A shard is written under a name of its own attempt and then renamed, so a repeated task replaces it whole.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm import tokens

        encoder = tokens.encoder(tokenizer_path)
        small = encoder.tokenizer.get_vocab_size() <= 1 << 16
        kind, dtype = (pa.uint16(), "<u2") if small else (pa.uint32(), "<u4")
        end = b"" if end_id is None else np.uint32(end_id).tobytes()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        step = BATCH_ROWS * seq_len

        def lists(ids: np.ndarray, real: int):
            mask = np.arange(len(ids)) < real
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v), seq_len) for v in (ids.astype(dtype), mask)]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        def write(shard: int, documents: Iterator[tuple], id_type) -> tuple[int, int]:
            """Documents up to the end of one shard; (documents, ids)."""
            attempt = f"{root}/.{shard:05d}-{uuid.uuid4().hex}"
            doc_ids, counts, total, held, held_ids = [], [], 0, [], 0
            with fs.open_output_stream(attempt) as sink, pa.ipc.new_file(sink, schema) as writer:
                for doc, ids in documents:
                    doc_ids.append(doc)
                    counts.append(len(ids) // 4)
                    total += counts[-1]
                    held.append(ids)
                    held_ids += counts[-1]
                    full = total >= shard_tokens or len(doc_ids) >= SHARD_DOCS
                    if held_ids >= 4 * step or full:
                        rest = np.frombuffer(b"".join(held), dtype="<u4")
                        while len(rest) >= step:
                            writer.write_batch(lists(rest[:step], step))
                            rest = rest[step:]
                        held, held_ids = [rest.tobytes()], len(rest)
                    if full:
                        break
                rest = np.frombuffer(b"".join(held), dtype="<u4")
                for at in range(0, len(rest), step):
                    part = rest[at : at + step]
                    padded = np.zeros(-(-len(part) // seq_len) * seq_len, dtype="<u4")
                    padded[: len(part)] = part
                    writer.write_batch(lists(padded, len(part)))
            starts = np.cumsum([0, *counts])[:-1]
            index = pa.table({"doc_id": pa.array(doc_ids, id_type), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with fs.open_output_stream(f"{attempt}.docs") as sink, pa.ipc.new_file(sink, index.schema) as writer:
                writer.write_table(index)
            fs.move(attempt, _name(root, shard))
            fs.move(f"{attempt}.docs", _name(root, shard, ".docs"))
            return len(doc_ids), total

        def encoded(first) -> Iterator[tuple]:
            for b in itertools.chain([first], batches):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield doc, encoder.encode(text.as_py()) + end

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        documents, base = encoded(first), TaskContext.get().partitionId() * PARTS
        for part in itertools.count():
            ahead = next(documents, None)
            if ahead is None:
                return
            n_docs, n_tokens = write(base + part, itertools.chain([ahead], documents), first.schema.field(0).type)
            columns = [pa.array([base + part], pa.int32()), pa.array([n_docs]), pa.array([n_tokens])]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "docs", "tokens"])

    ordered = text_batches(docs).select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).repartitionByRange(shards, "d").sortWithinPartitions("d", "t")
    return sorted(ordered.mapInArrow(run, MANIFEST).collect())  # a row per shard


def read_token_files(spark: SparkSession, folder: str, manifest: list, *, id_type: T.DataType | None = None) -> DataFrame:
    """Documents read back: doc_id (of id_type, long by default), start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    id_name = (id_type or T.LongType()).simpleString()
    bases, before = [], 0
    for shard, docs, tokens in manifest:
        if docs:
            bases.append((shard, before))
        before += tokens

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = _open(folder)
        for b in batches:
            for row in b.to_pylist():
                names = [f"{root}/{_name('', row['shard'], k).lstrip('/')}" for k in ("", ".docs")]
                local = isinstance(fs, pa.fs.LocalFileSystem)
                data, index = (pa.ipc.open_file(pa.memory_map(n) if local else fs.open_input_file(n)) for n in names)
                table, at, pieces, first = index.read_all(), 0, [], 0
                docs, starts, counts = (table.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))
                held = np.zeros(0, dtype="<u4")  # ids from place `first` on
                batch, rows = 0, []
                for doc, start, count in zip(docs, starts, counts, strict=True):
                    if first + len(held) < start + count:
                        parts = [held[start - first :]]
                        have = len(parts[0])
                        while have < count:
                            got = data.get_batch(batch)
                            ids = got.column(0).flatten().to_numpy(zero_copy_only=True)
                            mask = got.column(1).flatten().to_numpy(zero_copy_only=False)
                            parts.append(ids.astype("<u4") if mask.all() else ids[mask].astype("<u4"))
                            have += len(parts[-1])
                            batch += 1
                        held, first = np.concatenate(parts), start
                    rows.append((doc, row["base"] + start, count, held[start - first : start - first + count].tobytes()))
                    at += count
                    if at > 1 << 21:
                        pieces, at = rows, 0
                        rows = []
                        yield _rows(pieces, table.schema.field(0).type)
                if rows:
                    yield _rows(rows, table.schema.field(0).type)

    def _rows(rows: list, kind):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    shards = spark.createDataFrame(bases, "shard int, base long").repartition(max(1, len(bases)), "shard")
    return shards.mapInArrow(run, f"doc_id {id_name}, start long, n_tokens long, ids binary")


def sequence(folder: str, shard: int, row: int):
    """One sequence of a shard and its mask, by memory map where the folder is local: no ids are copied."""
    import pyarrow as pa

    fs, root = _open(folder)
    name = f"{root}/shard-{shard:05d}.arrow"
    data = pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name))
    batch = data.get_batch(row // BATCH_ROWS)
    return batch.column(0)[row % BATCH_ROWS].values, batch.column(1)[row % BATCH_ROWS].values
