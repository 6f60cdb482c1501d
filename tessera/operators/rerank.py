"""Reranking, diversity and near-duplicate removal over each question's own short list.

Lists come from top-k searches, so they are bounded by k; the sequential ones are folds over an array per question.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx


def rerank(results: DataFrame, queries: DataFrame, judge: Callable[[Column], Column], *, keep: int = 5, floor: float = 0.3, passage_chars: int = 1200) -> DataFrame:
    """Scores results(query_id, chunk_id, content, score, rank, retriever) by a model; unreadable replies keep the first score."""
    asked = results.join(queries.select("query_id", "question"), "query_id")
    raw = judge(tx.fill_template("score", question="question", passage=tx.truncate("content", passage_chars)))
    scored = asked.withColumn("__raw", raw).withColumn("first_stage_score", F.col("score")).withColumn("score", tx.parse_score("__raw", "score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    kept = scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return kept.withColumn("retriever", F.concat(F.coalesce("retriever", F.lit("")), F.lit("+rerank"))).drop("__raw", "question")


def _lists(results: DataFrame, *columns: str) -> DataFrame:
    tokens = results.withColumn("tokens", tx.token_set("content"))
    return tokens.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "tokens", *columns))).alias("items"))


def diversify(results: DataFrame, keep: int = 5, diversity: float = 0.3) -> DataFrame:
    """(query_id, chunk_id, pick): maximal marginal relevance; the first stays first, the earliest wins ties.

    Each pick depends on those before it, so a question's list, which its search has bounded, is one group.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        sets = [set(t) for t in rows["tokens"]]
        score, overlap = rows["score"].tolist(), [0.0] * len(rows)
        left, chosen = list(range(len(rows))), []
        while left and len(chosen) < keep:
            best = left[0] if not chosen else max(left, key=lambda i: ((1 - diversity) * score[i] - diversity * overlap[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                both = len(sets[i] | sets[best])
                overlap[i] = max(overlap[i], len(sets[i] & sets[best]) / both if sets[i] and sets[best] else 0.0)
        out = rows.iloc[chosen]
        return pd.DataFrame({"query_id": out["query_id"], "chunk_id": out["chunk_id"], "pick": range(1, len(out) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    taken = results.select("query_id", "chunk_id", "rank", "score", tx.token_set("content").alias("tokens"))
    return taken.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, pick int")


def deduplicate(results: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, rank): in order, rows that overlap with no kept one by the threshold."""
    step = lambda kept, x: F.when(F.exists(kept, lambda y: tx.jaccard(x["tokens"], y["tokens"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x)))
    lists = _lists(results)
    folded = lists.select("query_id", F.aggregate("items", F.slice("items", 1, 0), step).alias("kept"))
    return folded.select("query_id", F.explode("kept").alias("x")).select("query_id", F.col("x.chunk_id").alias("chunk_id"), F.col("x.rank").alias("rank"))


def merge_unique(left: DataFrame, right: DataFrame, key: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """left and the rows of right whose key left doesn't have; repeats inside right stay."""
    return left.unionByName(right.join(left.select(*key), list(key), "left_anti"))
