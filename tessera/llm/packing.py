"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenized, cut into full windows of ``max_len`` ids (a sequence each) and tails. Tails are cut
into pieces of at most ``piece_len`` ids, and consecutive pieces of a partition are gathered into groups of a
bounded number. Each group is split into k windows by differencing: every piece starts as a partial partition
with one filled window; the two partial partitions with the largest imbalance are merged, the heaviest windows
of one with the lightest of the other, until one is left. k starts at the least count that could hold the
group and rises whenever a window exceeds ``max_len``.

Nothing is shuffled: groups are made of neighbours within a partition, so work and memory are bounded and a
lost task is redone alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_batches

PIECES_SCHEMA = "{id} {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of one partition.
SEQUENCES_PER_PARTITION = 1 << 40


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each size, by k-way Karmarkar-Karp differencing."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, dtype=np.int64)
    left, right = [-1] * n, [-1] * n  # a node is a piece or the union of two nodes
    heap = []
    for i in range(n):
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[-1], nodes[-1] = sizes[i], i
        heap.append((-int(sizes[i]), i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        other, theirs = other[::-1], theirs[::-1]  # ascending against descending
        both = np.flatnonzero((nodes >= 0) & (theirs >= 0))
        merged = np.where(nodes >= 0, nodes, theirs)
        if len(both):
            first = len(left)
            left.extend(nodes[both].tolist())
            right.extend(theirs[both].tolist())
            merged[both] = np.arange(first, first + len(both))
        sums = sums + other
        by = np.argsort(sums, kind="stable")
        sums, merged = sums[by], merged[by]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), order, sums, merged))
        order += 1
    window = np.zeros(n, dtype=np.int64)
    for w, node in enumerate(heap[0][3].tolist()):
        stack = [node] if node >= 0 else []
        while stack:
            at = stack.pop()
            if at < n:
                window[at] = w
            else:
                stack += [left[at], right[at]]
    return window


def balanced_windows(sizes: np.ndarray, max_len: int) -> np.ndarray:
    """A window for each size (each at most max_len), with no window over max_len and as few as differencing allows."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return sizes
    k = max(1, -(-int(sizes.sum()) // max_len))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max() <= max_len:
            return window
        k += max(1, k // 128)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048,
    end_id: int | None = 1, piece_len: int = 512, group_pieces: int = 1024, memo_pieces: int | None = None,
) -> DataFrame:
    """One row per piece: where it stands in its document, its ids, and its place in a sequence.

    A null or empty text is just its end id (no row if ``end_id`` is None). Null and repeated ids are packed
    like any other row. Other columns are ignored, whatever their names. An empty table gives no rows. A very long text is
    encoded at once and is as many pieces as it needs: a task holds one document's ids and group_pieces tails.
    memo_pieces: words whose ids a worker keeps, for less memory or less work (see tokens); ids are the same with any.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm import tokens

        encoder = tokens.encoder(tokenizer_path, memo_pieces or tokens.MEMO_PIECES)
        base = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        end = b"" if end_id is None else np.uint32(end_id).tobytes()
        made, tails, out, held = 0, [], [], 0

        def close() -> None:
            nonlocal made, tails
            window = balanced_windows(np.array([t[2] for t in tails], dtype=np.int64), max_len)
            filled: dict[int, int] = {}
            for (doc, start, length, ids, total), w in zip(tails, window.tolist(), strict=True):
                out.append((doc, start, length, ids, total, base + made + w, filled.get(w, 0)))
                filled[w] = filled.get(w, 0) + length
            made += int(window.max()) + 1
            tails = []

        def batch(schema) -> object:
            nonlocal out, held
            columns = list(zip(*out, strict=True))
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for b in batches:
            schema = schema or pa.schema(
                [(id_col, b.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
            )
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // 4
                full = total - total % max_len
                for start in range(0, full, max_len):
                    out.append((doc, start, max_len, ids[4 * start : 4 * (start + max_len)], total, base + made, 0))
                    made += 1
                held += len(ids)
                for start in range(full, total, piece_len):
                    stop = min(start + piece_len, total)
                    tails.append((doc, start, stop - start, ids[4 * start : 4 * stop], total))
                if len(tails) >= group_pieces:
                    close()
                if held > 1 << 23 and out:
                    yield batch(schema)
        if tails:
            close()
        if out:
            yield batch(schema)

    id_type = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, PIECES_SCHEMA.format(id=f"`{id_col}`", id_type=id_type))


def sequences(pieces: DataFrame, *, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves, and the piece lengths that bound attention.

    Ids are padded to max_len, but for sequences whose length is a power of two: these stay as long as they are.
    """
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    raw = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    n = (F.octet_length("ids") / 4).cast("int")
    missing = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(max_len) - n)
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return whole.select("sequence_id", F.col("p.length").alias("lengths"), raw.alias("ids")).withColumn("ids", F.concat("ids", pad))
