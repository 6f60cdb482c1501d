"""The agent: a bounded loop over a table of questions that aren't resolved yet.

Each hop searches by route, merges new evidence, judges it, and either ends a question or gives it its next query. A
hop's table is written to the shared folder, so the plan doesn't grow with the hops. Questions are dealt out by their ids
first: however few files they come in, each hop judges them with all cores.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import context, routing
from tessera.plans.answering import ABSTAINED, route
from tessera.scratch import materialize

EVIDENCE = "array<struct<chunk_id:string,content:string,score:double,source_uri:string>>"
VERDICT = "sufficient boolean, next_query string"


def _parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def start(queries: DataFrame) -> DataFrame:
    """The first state of queries(query_id, question[, qvec, tenant_id])."""
    return route(queries).withColumns({
        "active_query": F.col("question"), "evidence": F.array().cast(EVIDENCE), "tried": F.array(F.col("question")), "entities": tx.capitalized_mentions("question"),
        "iteration": F.lit(0), "sufficient": F.lit(False), "terminated_by": F.lit(None).cast("string"),
    })


def merge_evidence(held: Column, found: Column) -> Column:
    """held and what of found has a new id."""
    ids = F.transform(held, lambda x: x["chunk_id"])
    return F.concat(held, F.filter(F.coalesce(found, F.array().cast(EVIDENCE)), lambda x: ~F.array_contains(ids, x["chunk_id"])))


def judge(state: DataFrame, model: Callable[[Column], Column] | None) -> DataFrame:
    """Sets sufficient and next_query: no evidence is insufficient; without a judge, with an unreadable reply or with a
    query that was tried before (in any case), what there is has to do."""
    has = F.size("evidence") > 0
    if model is None:
        return state.withColumn("sufficient", has).withColumn("next_query", F.lit(None).cast("string"))
    said = F.array_join(F.transform("evidence", lambda x: x["content"]), "\n")
    # a column per step: rules and parsers name their argument many times, and each time would build the prompt and ask the model anew
    asked = state.withColumn("__p", tx.fill_template("evaluate", context=tx.truncate(said, 4000), question="question"))
    asked = asked.withColumn("__r", model(F.col("__p"))).withColumn("__v", tx.json_object("__r", VERDICT))
    following = F.trim(F.coalesce("__v.next_query", F.lit("")))
    repeated = F.array_contains(F.transform("tried", lambda t: F.lower(t)), F.lower(following))
    enough = has & (F.col("__v").isNull() | F.coalesce("__v.sufficient", F.lit(False)) | ((following != "") & repeated))
    return asked.withColumn("sufficient", enough).withColumn("next_query", F.when(~enough & (following != "") & ~repeated, following)).drop("__p", "__r", "__v")


def run_agent(
    queries: DataFrame, searches: dict[str, Callable[[DataFrame, int], DataFrame]], *, evaluator=None, generator=None, verifier=None, rewriter=None, max_iterations: int = 3, deadline_seconds: float = 15.0, k: int = 8
) -> DataFrame:
    """(query_id, answer, terminated_by, iteration, coverage, needs_human) for each question.

    searches by route (vector, graph, hybrid): a function of (query_id, question, ...) and k to rows with contents. A
    route without one, or a search that fails, finds nothing; one whose route no open question takes isn't run.
    """
    began, state, ended = time.monotonic(), start(queries.repartition(_parts(queries.sparkSession), "query_id")), []
    if rewriter is not None:
        state = state.withColumn("active_query", routing.guarded_rewrite("question", rewriter(tx.fill_template("condense", history=F.lit(""), question="question"))))
    state = materialize(state, "questions")
    for hop in range(max_iterations + 1):
        found = _search(state, searches, k)
        state = judge(state.join(found, "query_id", "left").withColumn("evidence", merge_evidence(F.col("evidence"), F.col("found"))).drop("found"), evaluator)
        late = time.monotonic() - began > deadline_seconds
        capped = hop >= max_iterations or late
        stop = F.col("sufficient") | F.col("next_query").isNull() | F.lit(capped)
        why = F.when(F.size("evidence") == 0, "no_evidence").when(F.col("sufficient"), "sufficient_evidence").otherwise("iteration_cap")
        state = state.withColumn("iteration", F.lit(hop)).withColumn("terminated_by", F.when(stop, why))
        state = materialize(state, f"hop-{hop}")
        ended.append(state.where(F.col("terminated_by").isNotNull()).drop("next_query"))
        state = state.where(F.col("terminated_by").isNull())
        if state.limit(1).count() == 0:
            break
        state = state.withColumn("active_query", F.col("next_query")).withColumn("tried", F.concat("tried", F.array("next_query"))).withColumn("entities", F.array_union("entities", tx.capitalized_mentions("next_query"))).drop("next_query")
    done = ended[0]
    for e in ended[1:]:
        done = done.unionByName(e)
    return _generate(done, generator, verifier)


def _search(state: DataFrame, searches: dict, k: int) -> DataFrame:
    out = None
    asked = state.withColumn("question", F.col("active_query"))
    taken = {r[0] for r in state.select("route").distinct().collect()}  # a handful
    for name, search in searches.items():
        if name not in taken:
            continue
        try:
            rows = search(asked.where(F.col("route") == name), k).select("query_id", F.struct("chunk_id", "content", "score", "source_uri").alias("e"), "rank")
            rows = materialize(rows, f"found-{name}")  # plans are lazy, so a search that fails does so here
        except Exception:  # noqa: BLE001, S112
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return state.select("query_id", F.array().cast(EVIDENCE).alias("found")).limit(0)
    listed = out.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "e"))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda x: x["e"]).cast(EVIDENCE).alias("found"))


def _generate(done: DataFrame, generator, verifier, floor: float = 0.6) -> DataFrame:
    rows = done.select("query_id", F.posexplode("evidence").alias("p", "e")).select("query_id", (F.col("p") + 1).alias("rank"), "e.*")
    built = context.build_context(rows).select("query_id", "context", F.size("admitted").alias("n_admitted"))
    known = done.select("query_id", "question", "terminated_by", "iteration").join(built, "query_id", "left").na.fill({"context": "", "n_admitted": 0})
    known = materialize(known, "contexts")  # read twice below
    if generator is None:
        made = known.withColumn("answer", F.lit(ABSTAINED)).withColumn("terminated_by", F.when(F.col("terminated_by") == "no_evidence", F.col("terminated_by")).otherwise("no_llm"))
    else:
        spoken = known.where("n_admitted > 0").withColumn("answer", generator(tx.fill_template("answer", context="context", question="question")))
        made = spoken.unionByName(known.where("n_admitted = 0").withColumn("answer", F.lit(ABSTAINED)))
    checked = context.validate_citations(made)
    sure = F.lit(1.0) if verifier is None else tx.parse_score(verifier(tx.fill_template("score", question="question", passage="answer")), F.lit(0.0))
    confidence = F.least(F.col("coverage"), sure)
    return checked.select("query_id", "answer", "terminated_by", "iteration", "coverage", (~F.col("passed") | (confidence < floor)).alias("needs_human"))
