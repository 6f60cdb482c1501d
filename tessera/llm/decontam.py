"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

Test items are the indexed side, each by the longer one of its question and its answer. Items are indexed in classes of length, 64
words, 128 and so on; a class's passages are windows of twice as many words with a stride of as many, so every such part that stands
in a text stands whole in some passage, however long other items are. Impacts are BM25 scores over the part's score against itself,
so a part that a passage holds whole scores 1, and one threshold serves all.

Retrieval is block-max WAND. Of an item's terms, those that come in most items are taken first while their impacts sum
to less than the threshold: without one of the other, essential, terms no passage can reach it. Postings hold essential terms only,
in order of the item and in blocks with their largest impacts; the rest's largest sum is part of every bound. Bounds of all passages of a
text by block are first taken at once, in arrays, and passages none of whose blocks can reach the threshold end there. A passage that
is left has a cursor in each of its terms' postings: cursors are kept sorted by item, the pivot is the first item that the largest
impacts up to it let reach the threshold, the block maxima are asked there, and cursors move to the pivot, or beyond the block if it can't.

Retrieved pairs are verified: 0.8 of the five-word shingles of the part that was retrieved have to stand in the text around the
passage, and 0.8 of the other part's there or anywhere in the text, as question and answer can stand far apart. A part of less than five
words counts by its words around the passage, and elsewhere as one shingle. Where a benchmark has text only, its last sentence is the
answer.

Benchmarks larger than BLOCK_ITEMS are gone through in blocks of that many items, a pass over the documents each, so a worker holds
one block's index; their statistics are those of all items, so that no item's result depends on which others its block has.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import begin_task, free_name, materialize, text_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: What essential terms have to bring at least, as a share of an item's score against itself.
MARGIN = 0.2
SHINGLE, OVERLAP = 5, 0.8
#: Words of the shortest class of items; each further one is twice as long.
STRIDE = 64
#: Items that are broadcast at once, and items of a block of postings.
BLOCK_ITEMS, POSTING_BLOCK = 20_000, 32
MEMO = 300_000
#: Behind all items: where a cursor at its end stands.
END = 1 << 62
EDGES = string.punctuation + "“”„«»‘’…–—¿¡"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their edges; words of punctuation alone are left out."""
    return [w for w in (p.strip(EDGES) for p in (text or "").lower().split()) if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of it; of a single sentence, its halves."""
    sentences = [s for s in map(words_of, SENTENCE.split(text or "")) if s]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def shingle_overlap(part: list[str], held: set[tuple[str, ...]], words: set[str], size: int = SHINGLE) -> float:
    """The share of a part's shingles in held; a part shorter than a shingle counts by its words; an empty one is held."""
    if not part:
        return 1.0
    if len(part) < size:
        return sum(w in words for w in part) / len(part)
    found = [tuple(part[i : i + size]) for i in range(len(part) - size + 1)]
    return sum(s in held for s in found) / len(found)


def place_of(part: list[str], words: list[str], size: int = SHINGLE) -> float:
    """The share of a part's shingles that stand anywhere among words; a part shorter than a shingle is one."""
    size = min(size, len(part))
    return shingle_overlap(part, set(zip(*(words[i:] for i in range(size)), strict=False)), set(), size)


def anchor(row: tuple) -> list[str]:
    """Of (item id, question words, answer words): the longer part, by which the item is retrieved."""
    return row[1] if len(row[1]) >= len(row[2]) else row[2]


def length_class(words: int) -> int:
    """The stride of a part's class."""
    stride = STRIDE
    while stride < words:
        stride *= 2
    return stride


@dataclass
class Index:
    """Items and their postings by term, as arrays (CSR)."""

    items: list
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    essential: list[np.ndarray]  # per term: items
    impacts: list[np.ndarray]
    rest: np.ndarray  # per item: the sum of the other terms' impacts
    others: list[dict[int, float]]  # per item: term -> impact of the other terms
    stride: int


@dataclass
class Statistics:
    """Of all items with words, by what they are retrieved by; df has the terms of the block that is indexed."""

    items: int
    mean: float
    df: dict[str, int]


def statistics_of(rows: list[tuple]) -> Statistics:
    """Of rows that are all items."""
    bags = [Counter(anchor(r)) for r in rows if r[1] or r[2]]
    return Statistics(len(bags), sum(b.total() for b in bags) / max(1, len(bags)), Counter(t for bag in bags for t in bag))


def build_indexes(rows: list[tuple], threshold: float = THRESHOLD, statistics: Statistics | None = None) -> list[Index]:
    """An index for each class of length. Without statistics rows are all items."""
    rows = [r for r in rows if r[1] or r[2]]
    statistics = statistics or statistics_of(rows)
    classes: dict[int, list[tuple]] = {}
    for r in rows:
        classes.setdefault(length_class(len(anchor(r))), []).append(r)
    return [build_index(classes[stride], threshold, statistics) for stride in sorted(classes)]


def build_index(rows: list[tuple], threshold: float = THRESHOLD, statistics: Statistics | None = None) -> Index:
    """From (item id, question words, answer words) of one class; items without words can't be retrieved. Without statistics rows are all items."""
    rows = [r for r in rows if r[1] or r[2]]
    statistics = statistics or statistics_of(rows)
    stride = length_class(max((len(anchor(r)) for r in rows), default=0))
    bags = [Counter(anchor(r)) for r in rows]
    n, mean, df = statistics.items, statistics.mean, statistics.df
    terms = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    rest, others = np.zeros(len(bags)), []
    for d, bag in enumerate(bags):
        size = sum(bag.values())
        score = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in bag.items()}
        whole = sum(score.values())
        mine: dict[int, float] = {}
        common = True
        for t in sorted(score, key=lambda t: (-df[t], t)):
            impact = score[t] / whole
            common = common and rest[d] + impact < threshold - MARGIN
            if common:
                rest[d] += impact
                mine[terms[t]] = impact
            else:
                postings[terms[t]].append((d, impact))
        others.append(mine)
    essential = [np.array([d for d, _ in p], dtype=np.int64) for p in postings]
    impacts = [np.array([v for _, v in p]) for p in postings]
    return Index([r[0] for r in rows], [(q, a) for _, q, a in rows], terms, essential, impacts, rest, others, stride)


class Searcher:
    """Retrieves and verifies the items of one class of length that a text holds."""

    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.memo: dict[str, int] = {}
        lens = np.array([len(p) for p in index.essential], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(lens)])
        self.items = np.concatenate(index.essential) if len(lens) else np.zeros(0, np.int64)
        self.impacts = np.concatenate(index.impacts) if len(lens) else np.zeros(0)
        # block-max: per term, the largest impact of each block it has postings in
        term = np.repeat(np.arange(len(lens)), lens)
        blocks = -(-max(1, len(index.items)) // POSTING_BLOCK)
        key = term * blocks + self.items // POSTING_BLOCK
        uniq, inverse = np.unique(key, return_inverse=True)
        self.block_max = np.zeros(len(uniq))
        np.maximum.at(self.block_max, inverse, self.impacts)
        self.block_of = uniq % blocks
        self.block_at = np.searchsorted(uniq // blocks, np.arange(len(lens) + 1))
        self.block_rest = np.zeros(blocks)
        np.maximum.at(self.block_rest, np.arange(len(index.items)) // POSTING_BLOCK, index.rest)
        self.blocks, self.has = blocks, lens > 0
        self.term_max = [float(m.max()) if len(m) else 0.0 for m in index.impacts]
        self.rest_max = float(index.rest.max()) if len(index.rest) else 0.0
        self.postings: dict[int, tuple[list, list, list, list]] = {}  # of terms that cursors have gone over, at most MEMO entries

    def _postings(self, t: int) -> tuple[list, list, list, list]:
        """A term's items and impacts, and its blocks and their largest impacts."""
        if t not in self.postings:
            if len(self.postings) >= MEMO:
                self.postings.clear()
            low, high = self.block_at[t], self.block_at[t + 1]
            self.postings[t] = (self.index.essential[t].tolist(), self.index.impacts[t].tolist(), self.block_of[low:high].tolist(), self.block_max[low:high].tolist())
        return self.postings[t]

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, its essential terms' impacts) for a passage's distinct terms: the items that can reach the threshold with the rest."""
        least = self.threshold - 1e-9
        # a cursor: [item, place, items, impacts, blocks, block maxima, largest impact]
        cursors = [[held[0][0], 0, *held, self.term_max[t]] for t in terms for held in [self._postings(t)] if held[0]]
        found = []

        def move(c: list, item: int) -> None:
            c[1] = bisect_left(c[2], item, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else END

        while cursors:
            cursors = sorted((c for c in cursors if c[0] != END), key=itemgetter(0))
            bound, pivot = self.rest_max, -1
            for i, c in enumerate(cursors):
                bound += c[6]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // POSTING_BLOCK
            bound = self.block_rest[block]
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[4], block)
                if k < len(c[4]) and c[4][k] == block:
                    bound += c[5][k]
            if bound < least:  # nothing of this block before the next cursor's item
                ahead = (block + 1) * POSTING_BLOCK
                if pivot + 1 < len(cursors):
                    ahead = min(ahead, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    move(c, ahead)
            elif cursors[0][0] == item:
                score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                if score + self.index.rest[item] >= least:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    move(c, item)
        return found

    def term(self, piece: str) -> int:
        found = self.memo.get(piece)
        if found is None:
            word = piece.strip(EDGES)
            found = self.index.terms.get(word, -1) if word else -2
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = found
        return found

    @staticmethod
    def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranges: the range of each element, and the elements."""
        size = stop - start
        owner = np.repeat(np.arange(len(size)), size)
        return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)

    def search(self, text: str | None) -> list[tuple]:
        """(item, score, question overlap, answer overlap), by item, for each item that the text holds."""
        if not text or not self.index.items:
            return []
        pieces = text.lower().split()
        term = self.term
        memo = self.memo
        ids = np.fromiter([memo[p] if p in memo else term(p) for p in pieces], dtype=np.int64, count=len(pieces))
        if (ids == -2).any():  # pieces of punctuation alone are no words
            real = np.flatnonzero(ids != -2)
            ids, pieces = ids[real], [pieces[i] for i in real.tolist()]
        known = np.flatnonzero(ids >= 0)
        known = known[self.has[ids[known]]]
        if not len(known):
            return []
        stride = self.index.stride
        t = ids[known]
        # each word is in the passages that begin at stride * w and stride * (w - 1)
        order = np.lexsort((known, t))
        before = np.full(len(known), -1, dtype=np.int64)
        same = t[order][1:] == t[order][:-1]
        before[order[1:][same]] = known[order[:-1][same]]
        w = known // stride
        passage = np.concatenate([w, w - 1])
        again = np.concatenate([before, before])
        t = np.concatenate([t, t])
        keep = (passage >= 0) & (again < passage * stride)  # the first of its term in the passage
        passage, t = passage[keep], t[keep]
        # blocks whose bound reaches the threshold
        owner, e = self._expand(self.block_at[t], self.block_at[t + 1])
        key, where = np.unique(passage[owner] * self.blocks + self.block_of[e], return_inverse=True)
        bound = np.bincount(where, weights=self.block_max[e]) + self.block_rest[key % self.blocks]
        open_blocks = key[bound >= self.threshold - 1e-9]
        if not len(open_blocks):
            return []
        some = np.isin(passage, open_blocks // self.blocks)
        passage, t = passage[some], t[some]
        order = np.argsort(passage, kind="stable")
        passage, t = passage[order], t[order]
        edges = np.flatnonzero(np.diff(passage)) + 1
        best: dict[int, tuple] = {}
        words: list[str] = []  # of the whole text, once they are asked for
        retrieved = ((p, item, s) for p, mine in zip(passage[np.append(0, edges)].tolist(), np.split(t, edges), strict=True) for item, s in self.wand(mine.tolist()))
        for p, item, s in retrieved:
            start, stop = p * stride, (p + 2) * stride
            here = set(ids[start:stop].tolist())
            s += sum(v for x, v in self.index.others[item].items() if x in here)
            if s < self.threshold - 1e-9:
                continue
            near = words[max(0, start - stride) : stop + stride] if words else [x.strip(EDGES) for x in pieces[max(0, start - stride) : stop + stride]]
            held, said = set(zip(*(near[i:] for i in range(SHINGLE)), strict=False)), set(near)
            q, a = self.index.parts[item]
            overlaps = [shingle_overlap(q, held, said), shingle_overlap(a, held, said)]
            other = int(len(q) >= len(a))  # the part that wasn't retrieved can stand anywhere
            if overlaps[1 - other] >= self.overlap > overlaps[other]:
                words = words or [x.strip(EDGES) for x in pieces]
                overlaps[other] = max(overlaps[other], place_of((q, a)[other], words))
            if min(overlaps) >= self.overlap and (item not in best or best[item][1] < s):
                best[item] = (self.index.items[item], float(s), *overlaps)
        return [best[i] for i in sorted(best)]


def _item_words(row: tuple) -> tuple[list[str], list[str]]:
    """Of (text) or (question, answer)."""
    return question_and_answer(row[0]) if len(row) == 1 else (words_of(row[0]), words_of(row[1]))


def _rows(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_ITEMS, in order of their id."""
    block: list[tuple] = []
    for row in items.orderBy(items.columns[0]).toLocalIterator():
        if len(block) >= BLOCK_ITEMS:
            yield block
            block = []
        block.append((row[0], *_item_words(row[1:])))
    if block:
        yield block


def _statistics(items: DataFrame) -> tuple[tuple[int, float], DataFrame]:
    """(items, mean length) of all items with words, and df(term, df), written to the shared folder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            words = [anchor((None, *_item_words(row))) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["size", "terms"])

    bags = items.select(*items.columns[1:]).mapInArrow(run, "size bigint, terms array<string>").where("size > 0")
    n, total = bags.agg(F.count("*"), F.sum("size")).first()
    df = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return (n, (total or 0) / max(1, n)), materialize(df, "item-terms")


def _indexes(items: DataFrame, threshold: float) -> Iterator[list[Index]]:
    """Indexes for each block of items; a second block makes the statistics of all items needed."""
    blocks = _rows(items)
    block, later = next(blocks, None), next(blocks, None)
    if block is None:
        return
    if later is None:
        yield build_indexes(block, threshold)
        return
    whole, df = _statistics(items)
    while block is not None:
        terms = sorted({t for row in block for t in anchor(row)})
        held = items.sparkSession.createDataFrame([(t,) for t in terms], "term string").join(df, "term").collect()
        yield build_indexes(block, threshold, Statistics(*whole, {r["term"]: r["df"] for r in held}))
        block, later = later, next(blocks, None)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out_col: str = "leaks", item_col: str = "item_id", item_text_col: str = "text",
    question_col: str | None = None, answer_col: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """Adds an array of (item, score, question_overlap, answer_overlap), one for each item that the text holds.

    Null or empty texts, and items without words, hold nothing and aren't held. Very long texts are searched whole. Repeated items are
    items of their own. Documents are neither dropped nor shuffled; other columns are kept and a column named out_col, in any case, is
    replaced. For a benchmark of several blocks the documents are written to the shared folder after each block's pass.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"array<struct<item:{kind},score:double,question_overlap:double,answer_overlap:double>>"
    items = benchmark.select(item_col, *([question_col, answer_col] if question_col else [item_text_col]))
    held = free_name(docs, "held")
    found = text_batches(docs).withColumn(held, F.array().cast(schema))
    indexes = _indexes(items, threshold)
    built = next(indexes, None)
    while built is not None:
        index = docs.sparkSession.sparkContext.broadcast(built)
        leaks = _searcher(index, threshold, overlap, schema)(F.col(text_col))
        found = found.withColumn(held, F.concat(held, leaks))
        built = next(indexes, None)
        if built is not None:
            found = materialize(found, "leaks")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()], F.col(held).alias(out_col))


def _searcher(index, threshold: float, overlap: float, schema: str):
    def leaks(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin_task("decontam")
        searchers = [Searcher(x, threshold, overlap) for x in index.value]
        names = ("item", "score", "question_overlap", "answer_overlap")
        for texts in it:
            yield pd.Series([[dict(zip(names, r, strict=True)) for s in searchers for r in s.search(t)] for t in texts])

    leaks.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(leaks, schema)
