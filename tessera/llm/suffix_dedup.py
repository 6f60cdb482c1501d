"""Substring dedup with suffix arrays of shards.

Every byte of a document that a string of ``LENGTH`` bytes covers is removed if that string also starts earlier:
in a document with a smaller id, or before in the same one. Strings never cross documents and are judged on the
input. Runs of windows that can have equals are brought together by their minimizers (see repeats); those that
aren't plain copies are laid out in shards of about SHARD_BYTES, and a shard's suffix array (induced sorting) and
permuted common prefixes give its groups of equal strings: suffixes next to each other in order that have
LENGTH bytes in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.shared import begin_task, free_name, with_order_key
from tessera.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
SHARD_BYTES = 400_000
#: Never a byte of UTF-8: ends a fragment in a shard.
END = 0xFF


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)


WINDOWS = repeats.Windows(LENGTH, 32, True, SHARD_BYTES, utf8, "uint8")


def shard_repeats(pieces: list[bytes], keys: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the strings of a shard's pieces that are equal to one with a smaller (key, start)."""
    text = np.frombuffer(bytes([END]).join(pieces) + bytes([END]), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    offset = np.arange(len(text)) - begin[piece]
    sa = suffix_array(text.astype(np.uint16) + 1, 258)
    common = permuted_common_prefixes(text, sa, length)
    # suffixes that begin with a whole string, in order; a group goes on while the next one shares all of it
    inside = (offset + length <= sizes[piece])[sa]
    joined = (common >= length)[sa]
    order = sa[inside]
    group = np.cumsum(~joined)[inside]
    if not len(order):
        return order, order
    key, place = keys[piece[order]], starts[piece[order]] + offset[order]
    by = np.lexsort((place, key, group))
    first = np.ones(len(by), dtype=bool)
    first[1:] = group[by][1:] != group[by][:-1]
    later = order[by[~first]]
    return piece[later], offset[later]


def _spans_of_shards(placed: DataFrame) -> DataFrame:
    """Spans from fragments that come sorted by h."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("suffix_dedup")

        def spans(rows: list[tuple]):
            keys, starts = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            piece, offset = shard_repeats([r[5] for r in rows], keys, starts)
            order = np.lexsort((offset, piece))
            piece, offset = piece[order], offset[order]
            new = np.ones(len(piece), dtype=bool)
            new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(piece)))
            columns = [keys[piece[at]], (starts[piece[at]] + offset[at]).astype(np.int32), (count + LENGTH - 1).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "length"])

        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SHARD_BYTES and row[0] != rows[-1][0]:  # a minimizer's fragments stay together
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield spans(rows)

    return placed.mapInArrow(run, repeats.SPANS_SCHEMA)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", windows: repeats.Windows = WINDOWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): each document's bytes that are left, and what was removed.

    Null text is empty. Texts shorter than LENGTH bytes stay whole. Rows with one id, or a null one, are documents of
    their own, in order of their text. An empty table gives an empty result. Very long texts are cut into runs whole; other columns
    of docs are neither read nor returned, so their names can't clash.
    """
    keyed, key = with_order_key(docs.select(id_col, text_col), id_col, text_col)
    spans = repeats.repeated_spans(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), windows, _spans_of_shards)
    joined = repeats.with_spans(keyed, key, spans, "spans").select(F.col(id_col), F.col(text_col), "spans")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows: list[list] = [[], [], [], []]
            for text, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw, at, kept = utf8(text.as_py()).tobytes(), 0, []
                for run in runs or []:
                    kept.append(raw[at : run["start"]])
                    at = run["stop"]
                kept.append(raw[at:])
                left = b"".join(kept)
                for column, value in zip(rows, (len(raw), len(raw) - len(left), len(runs or []), left), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_characters(text: str, spans: list[dict]) -> str:
    """A text without the characters all of whose bytes lie in spans (start, stop) of its UTF-8 bytes."""
    raw = utf8(text)
    gone = np.zeros(len(raw) + 1, dtype=np.int64)
    for run in spans:
        gone[run["start"]] += 1
        gone[run["stop"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, lead) if len(lead) else gone
    sizes = np.diff(np.append(lead, len(raw)))
    return raw[~np.repeat(whole, sizes)].tobytes().decode("utf-8")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated strings cut from the texts, by whole characters; chars_col, if there is one, is set anew.

    Every row stays, with an empty text where all of it was repeated; null texts stay null. See without_repeats.
    """
    keyed, key = with_order_key(docs, id_col, text_col)
    spans = repeats.repeated_spans(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), WINDOWS, _spans_of_shards)
    runs, left = free_name(keyed, "spans"), free_name(keyed, "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None else cut_characters(t, r) for t, r in zip(texts, runs, strict=True)], dtype=object)

    joined = repeats.with_spans(keyed, key, spans, runs).withColumn(left, F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(cut(text_col, runs)))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(left).alias(c))
        elif c == chars_col:
            out.append(F.length(left).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
