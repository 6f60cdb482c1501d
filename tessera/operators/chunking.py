"""Chunkers: rows of text to rows of chunks.

Windows of fixed size are sequences of positions in SQL. The recursive splitter is sequential per text, so it is an
Arrow map over rows; nothing here shuffles but semantic chunking's neighbour distances and the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores, text as tx
from tessera.functions.vectors import cosine

# Separators from coarse to fine.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", " ", ""]
CHILD_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
# Fixed value: what a heading is; white space behind the marks may cross lines, titles may be empty.
HEADING = r"(?m)^(#{1,6})\s+(.*)$"


def fixed_size(docs: DataFrame, size: int = 500, overlap: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, content): windows of size, the last one ends with the text; empty texts have none."""
    if size <= overlap:
        raise ValueError("size must be larger than overlap")
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    each = docs.where(n > 0).select(id_col, text_col, F.posexplode(starts).alias("position", "start"))
    return each.select(id_col, "position", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("content"))


def covering_windows(docs: DataFrame, size: int = 3000, overlap: int = 300, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows for extraction: a start at every stride up to the end of the text, blank ones left out."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(size - overlap))
    each = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.posexplode(starts).alias("position", "start"))
    cut = each.select(id_col, "position", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("content"))
    return cut.where(F.regexp_replace("content", r"(?U)\s+", "") != "")


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces put together up to size; the next chunk begins with as many of the last pieces as overlap allows."""
    window: list[str] = []
    total = 0
    for piece in pieces:
        if total + len(piece) > size and window:
            if said := "".join(window).strip():
                yield said
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if said := "".join(window).strip():
        yield said


def split_recursively(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most size characters, split at the coarsest separator that the text holds, finer ones where needed."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *rest = text.split(separator)
        pieces = [p for p in [first, *(separator + r for r in rest)] if p]
    else:
        pieces = list(text)
    chunks, short = [], []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _merge(short, size, overlap)
        short = []
        chunks += split_recursively(piece, size, overlap, finer) if finer else [piece]
    return [*chunks, *_merge(short, size, overlap)]


#: Letters of text whose chunks a task holds at once; a longer text's are held alone.
PIECE = 1 << 20


def _in_pieces(cut: Callable[[str], list[str]]):
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            for _, part in s.groupby(s.str.len().fillna(0).cumsum() // PIECE):
                yield pd.Series([cut(t) if t else [] for t in part], dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def map_chunks(docs: DataFrame, cut: Callable[[str], list[str]], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, position, content) by a function of one text; null and empty texts have no chunks."""

    chunked = F.pandas_udf(_in_pieces(cut), "array<string>")
    return docs.select(id_col, *keep, F.posexplode(chunked(F.col(text_col))).alias("position", "content"))


def recursive(docs: DataFrame, size: int = 500, overlap: int = 50, *, separators: list[str] | None = None, **columns: str) -> DataFrame:
    seps = separators or SEPARATORS
    return map_chunks(docs, lambda t: split_recursively(t, size, overlap, seps), **columns)


def parent_child(
    docs: DataFrame, *, parent_chars: int = 2000, child_chars: int = 400, child_overlap: int = 60, id_col: str = "doc_id", text_col: str = "text", section: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(parents, children): children of each parent, content-addressed, with the section in front if there is one."""
    uri = F.col(id_col).cast("string")
    parents = recursive(docs, parent_chars, 0, id_col=id_col, text_col=text_col).withColumn("parent_id", scores.stable_id(uri, "position", "content"))
    cut = map_chunks(parents, lambda t: split_recursively(t, child_chars, child_overlap, CHILD_SEPARATORS), id_col="parent_id", text_col="content", keep=(id_col,))
    prefix = f"{section}\n" if section else ""
    children = cut.select(
        id_col, "parent_id", scores.stable_id(uri, "position", "content").alias("child_id"), "position", F.concat(F.lit(prefix), "content").alias("content")
    )
    return parents, children


def _sections(text: str, max_chars: int) -> list[str]:
    headings = list(re.finditer(HEADING, text))
    if not headings:
        return split_recursively(text, max_chars, max_chars // 10, SEPARATORS)
    out, trail = [], []
    for i, m in enumerate(headings):
        trail = [*trail[: len(m[1]) - 1], m[2].strip()]
        body = text[m.end() : headings[i + 1].start() if i + 1 < len(headings) else len(text)].strip()
        if body:
            out += [f"{' > '.join(trail)}\n{c}" for c in split_recursively(body, max_chars, max_chars // 10, SEPARATORS)]
    return out


def by_structure(docs: DataFrame, max_chars: int = 1200, **columns: str) -> DataFrame:
    """Markdown sections under their trail of headings; text before the first heading is left out."""
    return map_chunks(docs, lambda t: _sections(t, max_chars), **columns)


def semantic(
    docs: DataFrame, embed: Callable[[Column], Column], *, percentile: float = 0.85, min_chars: int = 200, max_chars: int = 1500, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Chunks cut where neighbouring sentences are further apart than a percentile of their document's distances.

    Distances are found for all sentences of all documents at once; the ordered fold over a document's sentences is
    an aggregate over its own array. Texts of fewer than three sentences are one chunk.
    """
    sentences = docs.select(id_col, F.posexplode(tx.split_sentences(text_col, before_capital=True)).alias("i", "s")).withColumn("v", embed(F.col("s")))
    w = Window.partitionBy(id_col).orderBy("i")
    apart = sentences.withColumn("d", 1 - cosine(F.lag("v").over(w), F.col("v")))
    every = Window.partitionBy(id_col)
    marked = apart.withColumn("t", F.percentile("d", F.lit(percentile)).over(every)).withColumn("n", F.count("*").over(every))
    listed = marked.groupBy(id_col).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s", (F.coalesce(F.col("d") > F.col("t"), F.lit(False))).alias("far")))).alias("a"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        long = F.length(x["s"])
        cut = (acc["now"] != "") & (F.col("n") >= 3) & ((x["far"] & (acc["size"] >= min_chars)) | (acc["size"] + long > max_chars))
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(cut | (acc["now"] == ""), x["s"]).otherwise(F.concat(acc["now"], F.lit(" "), x["s"])).alias("now"),
            F.when(cut | (acc["now"] == ""), long).otherwise(acc["size"] + long + 1).alias("size"),
        )

    folded = listed.select(id_col, F.aggregate("a", start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda c: c != "")).alias("c"))
    return folded.select(id_col, F.posexplode("c").alias("position", "content"))


def chunk_stats(chunks: DataFrame, *by: str, content: str = "content") -> DataFrame:
    n = F.length(content)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), none(F.avg(n)).alias("avg_chars"), F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_chars"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chars"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_chars"), none(F.stddev_pop(n)).alias("std_chars"),
    )


def overlap_ratio(chunks: DataFrame, by: str = "doc_id", threshold: float = 0.4) -> DataFrame:
    """(by, overlap_ratio): the share of neighbouring chunks whose token sets overlap by the threshold; 0 for one chunk."""
    w = Window.partitionBy(by).orderBy("position")
    tokens = chunks.select(by, "position", tx.token_set("content").alias("t"))
    pairs = tokens.withColumn("before", F.lag("t").over(w)).where(F.col("before").isNotNull())
    share = pairs.groupBy(by).agg(F.avg((tx.jaccard("before", "t") >= threshold).cast("double")).alias("overlap_ratio"))
    return chunks.select(by).distinct().join(share, by, "left").select(by, F.coalesce("overlap_ratio", F.lit(0.0)).alias("overlap_ratio"))
