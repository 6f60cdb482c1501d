"""Substring dedup with suffix automata.

Every word covered by a window of ``WORDS`` words in a row is removed if the same words in a row also start in
a document with a smaller id. Windows are judged on the input. Runs of windows that can have equals are routed
by their minimizers (see repeats), so the reference shard of a minimizer is the fragments that share it, and its
suffix automaton goes only to where documents can match it: a broadcast of automata of the whole corpus would
grow with the corpus. Documents are streamed in order of their id: a document's fragments walk through the
automaton of all smaller documents' fragments, which gives for each word the longest match that ends there; where
that reaches WORDS, a window is repeated. Then the document's own fragments are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.shared import begin_task, with_order_key

WORDS = 50


def words_of(text: str | None) -> list[bytes]:
    """Words are runs of bytes other than \\x20 and \\x09-\\x0D: what bytes.split() goes by."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh64_intdigest, words_of(text))), dtype=np.uint64)


WINDOWS = repeats.Windows(WORDS, 8, False, 50_000, word_hashes, "uint64", compare_copies=True)


class SuffixAutomaton:
    """The suffix automaton of several sequences of words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list) -> None:
        """Adds a sequence, and with it all that stand in it."""
        last = 0
        for c in words:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:  # another sequence has it
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matches(self, words: list) -> list[int]:
        """Matching statistics: for each place the longest row of words ending there that some sequence holds."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            out.append(length)
        return out


def shard_spans(rows: list[tuple[int, int, list]], length: int = WORDS) -> list[tuple[int, int, int]]:
    """(key, start, words) spans from a shard's fragments (key, start, words), in order of their keys."""
    automaton, spans, waiting, now = SuffixAutomaton(), [], [], None
    for key, start, words in sorted(rows, key=lambda r: r[:2]):
        if key != now:
            for w in waiting:
                automaton.add(w)
            waiting, now = [], key
        run = None
        for i, m in enumerate(automaton.matches(words) if len(automaton.next) > 1 else []):
            if m >= length:
                if run is None:
                    run = i - length + 1
            elif run is not None:
                spans.append((key, start + run, i - run))
                run = None
        if run is not None:
            spans.append((key, start + run, len(words) - run))
        waiting.append(words)
    return spans


def _spans_of_shards(placed: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("automaton_dedup")

        def record(spans: list[tuple[int, int, int]]):
            columns = zip(*spans, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "start", "length"])

        rows, at, spans = [], None, []
        for b in batches:
            for h, key, start, _, _, units in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != at:
                    spans += shard_spans(rows) if rows else []
                    rows, at = [], h
                    if len(spans) > 50_000:
                        yield record(spans)
                        spans = []
                rows.append((key, start, np.frombuffer(units, dtype=np.uint64).tolist()))
        spans += shard_spans(rows) if rows else []
        if spans:
            yield record(spans)

    return placed.mapInArrow(run, repeats.SPANS_SCHEMA)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", windows: repeats.Windows = WINDOWS) -> DataFrame:
    """(id, n_words, n_removed, kept string): each document's words that are left, joined by one space.

    Null text has no words. Texts of fewer than WORDS words stay whole. Rows with one id, or a null one, are
    documents of their own, in order of their text. An empty table gives an empty result. Very long texts are cut into runs whole; other
    columns of docs are neither read nor returned, so their names can't clash.
    """
    keyed, key = with_order_key(docs.select(id_col, text_col), id_col, text_col)
    spans = repeats.repeated_spans(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), windows, _spans_of_shards)
    joined = repeats.with_spans(keyed, key, spans, "spans").select(F.col(id_col), F.col(text_col), "spans")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows: list[list] = [[], [], []]
            for text, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words, at, kept = words_of(text.as_py()), 0, []
                for run in runs or []:
                    kept += words[at : run["start"]]
                    at = run["stop"]
                kept += words[at:]
                for column, value in zip(rows, (len(words), len(words) - len(kept), b" ".join(kept).decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string()), strict=True)]], names=[id_col, "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")
