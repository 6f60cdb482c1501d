"""Ranked lexical search over a bit-sliced impact index.

A document's score for an item is the sum of integer impacts, one for each of the item's terms. The index is cut into segments of at
most ``SEGMENT`` documents in order of their id; in a segment each term has one bitmap for each bit of its impacts, over the 64-bit
words of the segment in which it occurs. A search adds bitmaps: bit by bit the sum is the exclusive or of both and the carry, the new
carry their majority, so 64 documents are added at once. The k best of a segment are found on the sum's bitmaps from the most
significant one down: as long as more than k documents have the bit, only they stay, and if fewer have it, they are in and the others
go on. Of documents left with equal scores those with the smaller id, the lower bit, are taken.

Postings of the terms that the items of a block ask for are written once, over all documents; document counts, lengths and frequencies
are those of the whole corpus. Segments are indexed and searched where their postings lie, and only their k best rows per item are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import begin_task, free_name, materialize, text_batches

#: Documents of a segment at most.
SEGMENT = 8_192
#: Items that are searched for in one pass over the documents, which bounds what is broadcast.
BLOCK_ITEMS = 5_000
#: Fixed values of the score: thousandths of the saturation at mean length, its part that depends on length, the scales.
LENGTH_PART, SATURATION, SCALE, WEIGHT_SCALE = 75, 8, 1_000_000_000, 1000
TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Words that a worker remembers.
MEMO, MEMO_CHARS = 300_000, 48


def terms_of(text: str | None) -> list[str]:
    """All terms with repeats; only A-Z are lower-cased."""
    return TERM.findall((text or "").translate(LOWER))


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((SCALE * tf) // (1000 * tf + SATURATION * m))


def slices(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bitmaps): bit d % 64 of bitmaps[b, i] is bit b of the value of document d, where words[i] = d // 64. docs ascend."""
    words, starts = np.unique(docs >> 6, return_index=True)
    bits = max(1, int(values.max()).bit_length()) if len(values) else 1
    place = docs.astype(np.uint64) & np.uint64(63)
    values = values.astype(np.uint64)
    maps = np.empty((bits, len(words)), dtype=np.uint64)
    for b in range(bits):
        maps[b] = np.bitwise_or.reduceat(((values >> np.uint64(b)) & np.uint64(1)) << place, starts)
    return words, maps


class Sum:
    """Bit-sliced sums of a segment's documents."""

    def __init__(self, n_words: int):
        self.maps = np.zeros((48, n_words), dtype=np.uint64)
        self.bits = 0

    def add(self, words: np.ndarray, maps: np.ndarray) -> None:
        """Adds bitmaps that stand at some words, with carries."""
        whole = len(words) == self.maps.shape[1]
        at = slice(None) if whole else words
        carry = np.zeros(maps.shape[1], dtype=np.uint64)
        b = 0
        while b < len(maps) or carry.any():
            if b == len(self.maps):
                self.maps = np.vstack([self.maps, np.zeros_like(self.maps[:16])])
            old = self.maps[b, at]
            if b < len(maps):
                half = old ^ maps[b]
                new, carry = half ^ carry, (old & maps[b]) | (half & carry)
            else:
                new, carry = old ^ carry, old & carry
            self.maps[b, at] = new
            b += 1
        self.bits = max(self.bits, b)

    def top(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above zero: by score, equal ones by document."""
        maps = self.maps[: self.bits]
        sure = np.zeros(self.maps.shape[1], dtype=np.uint64)
        open_ = np.bitwise_or.reduce(maps, axis=0) if len(maps) else sure.copy()
        count = lambda m: int(np.bitwise_count(m).sum())
        need = min(k, count(open_))
        for b in range(self.bits - 1, -1, -1):
            with_bit = open_ & maps[b]
            n = count(with_bit)
            if n > need:
                open_ = with_bit
            else:
                sure |= with_bit
                open_ &= ~maps[b]
                need -= n
                if not need:
                    break
        found = np.concatenate([members(sure), members(open_)[:need]])
        scores = np.zeros(len(found), dtype=np.int64)
        for b in range(self.bits):
            scores |= ((maps[b, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        order = np.lexsort((found, -scores))
        return found[order], scores[order]


def members(bitmap: np.ndarray) -> np.ndarray:
    """The documents of a bitmap, ascending."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, j = np.nonzero(bits)
    return words[i] * 64 + j


def _postings(held):
    """For each document its place among its partition's rows, terms with repeats, and the asked terms with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bit_sliced")
        asked, memo = held.value, {}

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes, terms, tfs, at = [], [], [], [0]
            for text in texts:
                n, mine = 0, Counter()
                for word, times in Counter(TERM.findall(text or "")).items():  # each different word is looked at once
                    n += times
                    t = memo.get(word)
                    if t is None:
                        t = asked.get(word.translate(LOWER), -1)
                        if len(word) <= MEMO_CHARS:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[word] = t
                    if t >= 0:
                        mine[t] += times
                sizes.append(n)
                terms += mine.keys()
                tfs += mine.values()
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return run


class Segment:
    """The index of a run of documents: ids in ascending order, and for each term (words, bitmaps)."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        rows = rows.sort_by([("doc", "ascending")])  # nulls last
        self.ids = rows["doc"].combine_chunks()
        m = 100 - LENGTH_PART + (LENGTH_PART * rows["n"].to_numpy() * n_docs) // n_terms
        lists = rows["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
        term, tf = lists.flatten().to_numpy().astype(np.int64), rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        value = impacts(weights[term], tf, m[doc])
        order = np.argsort(term, kind="stable")  # documents ascend in each term
        term, doc, value = term[order], doc[order], value[order]
        starts = np.flatnonzero(np.concatenate([[len(term) > 0], term[1:] != term[:-1]]))
        ends = np.append(starts[1:], len(term))[: len(starts)]
        self.terms = {int(term[a]): slices(doc[a:b], value[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}

    def search(self, bag: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents for (term, times) pairs."""
        total = Sum(-(-len(self.ids) // 64))
        for t, times in bag:
            if t in self.terms:
                words, maps = self.terms[t]
                for shift in range(times.bit_length()):  # a term that an item repeats is added shifted, for each bit of its count
                    if times >> shift & 1:
                        total.add(words, np.vstack([np.zeros((shift, len(words)), dtype=np.uint64), maps]) if shift else maps)
        return total.top(k)


def _search(held, k: int, n_docs: int, n_terms: int):
    """Cuts a partition's postings into segments, indexes each and searches it for all items: (item, doc, score) of its k best."""

    def best(rows: pa.Table, weights: np.ndarray, bags: list) -> pa.RecordBatch:
        segment = Segment(rows, weights, n_docs, n_terms)
        items, docs, scores = [], [], []
        for item, bag in enumerate(bags):
            found, values = segment.search(bag, k)
            items += [item] * len(found)
            docs += found.tolist()
            scores += values.tolist()
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), segment.ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bit_sliced")
        weights, bags = held.value
        waiting, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                take = min(len(batch) - at, SEGMENT - n)
                waiting.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == SEGMENT:
                    rows, waiting, n = pa.Table.from_batches(waiting), [], 0
                    yield best(rows, weights, bags)
        if n:
            yield best(pa.Table.from_batches(waiting), weights, bags)

    return run


def postings_of(docs: DataFrame, vocabulary: dict[str, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, terms, tfs) of all documents with at least one term, written to the shared folder: n counts all terms with repeats, terms and
    tfs are those of the vocabulary. Null and empty texts have no row; very long ones are read whole."""
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = text_batches(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    return materialize(rows.mapInArrow(_postings(asked), f"doc {kind}, n long, terms array<int>, tfs array<int>").where("n > 0"), "impact-postings")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score), named by the id columns: each item's k documents of highest score above zero, equal scores by id.

    Items of null text or without terms have no rows; repeated items are items of their own; repeated or null ids of documents are
    documents of their own, nulls last among equals. Empty tables give no rows. Other columns are neither read nor returned; item_col and
    id_col of one name are an error. Items are taken in blocks of BLOCK_ITEMS, a pass over the documents each.
    """
    if item_col.lower() == id_col.lower():
        raise ValueError("items and documents need id columns of different names")
    spark = docs.sparkSession
    kinds = [items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
    found, block = None, []

    def search(block: list[tuple]) -> DataFrame:
        bags = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
        postings = postings_of(docs, vocabulary, id_col=id_col, text_col=text_col)
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # of the vocabulary
        weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
        asked = spark.sparkContext.broadcast((weights, [sorted((vocabulary[t], n) for t, n in b.items()) for b in bags]))
        best = postings.mapInArrow(_search(asked, k, n_docs, max(1, n_terms)), f"item int, doc {kinds[1]}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)], f"item int, id {kinds[0]}")
        return top.join(F.broadcast(names), "item").select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")

    for row in items.select(item_col, item_text_col).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK_ITEMS:
            found, block = search(block) if found is None else found.unionByName(search(block)), []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found
