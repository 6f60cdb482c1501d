"""Evidence to a prompt: budgets, placement, citations and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.rerank import deduplicate

HEADER_TOKENS = 20


def pack_budget(results: DataFrame, budget: int = 2400, header: int = HEADER_TOKENS, *, by: str = "query_id", order: str = "rank", content: str = "content", key: str = "chunk_id") -> DataFrame:
    """Adds spent and admitted: in order, a row is admitted if it still fits; smaller ones behind a misfit may."""
    cost = (tx.estimate_tokens(content) + header).cast("long")
    lists = results.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), cost.alias("cost")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.transform(F.slice("items", 1, 0), lambda x: F.struct(x["k"].alias("k"), x["cost"].alias("spent"))).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["spent"] + x["cost"]
        fits = total <= budget
        return F.struct(
            F.when(fits, total).otherwise(acc["spent"]).alias("spent"),
            F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["k"].alias("k"), total.alias("spent"))))).otherwise(acc["kept"]).alias("kept"),
        )

    folded = lists.select(by, F.explode(F.aggregate("items", start, step, lambda a: a["kept"])).alias("x"))
    return folded.select(by, F.col("x.k").alias(key), F.col("x.spent").alias("spent"))


def plain_budget(results: DataFrame, budget: int, max_tokens: int = 4096, **columns: str) -> DataFrame:
    """pack_budget without headers, within the lesser of a budget and a model's limit."""
    return pack_budget(results, min(budget, max_tokens), 0, **columns)


def edge_position(rank: Column | str, n: Column | str) -> Column:
    """The place of the row at rank among n: first, then third and so on, the second last."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (rank, n))
    return F.when((n > 2) & (r == 2), n).when((n > 2) & (r > 2), r - 1).otherwise(r)


def build_context(results: DataFrame, budget: int = 2400, threshold: float = 0.75) -> DataFrame:
    """(query_id, context, admitted): without near copies, within the budget, best at the edges, numbered."""
    distinct = results.join(deduplicate(results, threshold).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id", "rank"])
    admitted = distinct.join(pack_budget(distinct, budget).select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    placed = admitted.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("place", edge_position("__r", "__n"))
    rows = placed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "content", "score", "source_uri"))).alias("admitted"))
    block = lambda r: F.format_string("[%d] (source: %s)\n%s", r["place"], F.coalesce(r["source_uri"], F.lit("")), r["content"])
    return rows.select("query_id", F.array_join(F.transform("admitted", block), "\n\n").alias("context"), "admitted")


def validate_citations(answers: DataFrame, answer: str = "answer", admitted: str = "n_admitted") -> DataFrame:
    """Adds n_sentences, n_uncited, invalid (ids), coverage and passed."""
    sentences = tx.split_sentences(answer)
    cited = F.array_distinct(tx.citations(answer))
    uncited = F.size(F.filter(sentences, lambda s: ~s.rlike(r"\[\d+\]")))
    valid = F.when(F.col(admitted) > 0, F.sequence(F.lit(1), F.greatest(F.col(admitted).cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    out = answers.withColumn("n_sentences", F.size(sentences)).withColumn("n_uncited", uncited).withColumn("invalid", F.array_except(cited, valid))
    out = out.withColumn("coverage", F.when(F.col("n_sentences") == 0, 0.0).otherwise(1 - F.col("n_uncited") / F.col("n_sentences")))
    return out.withColumn("passed", (F.col("n_uncited") == 0) & (F.size("invalid") == 0))
