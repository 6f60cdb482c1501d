"""The breaker as a stream across restarts, cache look-ups with few comparisons, bounded hops, writers of one store."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, store
from tessera.streaming import reliability

SF = "/root/testdata/sf0.001"
CALLS = "k string, i long, ts timestamp, ok boolean, latency_ms double"
START = dt.datetime(2024, 1, 1)


def test_stream_gives_the_states_of_the_batch(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = np.random.default_rng(3)
    at = np.sort(r.integers(0, 3600, 400))
    rows = [(f"k{i % 3}", i, START + dt.timedelta(seconds=int(s), milliseconds=int(i % 7)), bool(r.random() > 0.4), float(r.choice([10.0, 9000.0]))) for i, s in enumerate(at)]
    out = []

    def run():
        stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        states = reliability.stream_states(stream, key="k", order="i", late="30 seconds")
        q = states.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for a in range(0, 400, 100):  # a run for each file, within which calls come out of order
            part = rows[a : a + 100]
            spark.createDataFrame(part[::-1], CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run()
        run()  # nothing new
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    want = {x.i: x.state for x in reliability.breaker_states(spark.createDataFrame(rows, CALLS), key="k", order="i").collect()}
    got = {x.i: x.state for x in out}
    assert len(got) == len(out) and got == {i: want[i] for i in got} and set(got.values()) >= {"closed", "open", "rejected"}
    last = rows[-1][2] - dt.timedelta(seconds=30)
    assert {x[1] for x in rows if x[2] < last - dt.timedelta(seconds=1)} <= set(got)  # only what the watermark hasn't passed is left


def test_cache_compares_few_pairs():
    rows = [x for x in np.random.default_rng(1).normal(size=(3000, 64))]
    asked = [rows[i] + np.random.default_rng(i).normal(size=64) * 0.1 for i in range(0, 300, 3)]
    hits = reliability.FirstHits(asked, 0.93)
    for a in range(0, 3000, 512):
        hits.see(np.arange(100), np.array(rows[a : a + 512]), np.arange(a, min(a + 512, 3000)).astype(object))
    assert hits.compared < 0.2 * 100 * 3000
    v = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    q = np.array(asked) / np.linalg.norm(asked, axis=1)[:, None]
    near = np.round(q @ v.T, 6) >= 0.93
    assert [x for x in hits.best] == [int(n.argmax()) if n.any() else None for n in near] and near.any(axis=1).sum() > 90


def test_cache_of_tenants_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(reliability, "CACHE_BLOCK", 3)
    kinds = "tenant_id string, corpus_version string, seq string, vector array<double>"
    entries = spark.createDataFrame([("a", "1", "e2", [1.0, 0.0]), ("a", "1", "e1", [1.0, 0.01]), ("a", "2", "e0", [1.0, 0.0]), ("b", "1", "e9", [0.0, 1.0]), (None, "1", "n", [1.0, 0.0]), ("a", "1", "z", None), ("a", "1", "y", [0.0, 0.0])], kinds)
    asked = spark.createDataFrame([(i, t, v, x) for i, (t, v, x) in enumerate([("a", "1", [2.0, 0.0]), ("a", "2", [1.0, 0.1]), ("b", "1", [1.0, 0.0]), ("b", "1", [0.1, 1.0]), (None, "1", [1.0, 0.0]), ("a", "1", None), ("a", "1", [0.0, 0.0])])], "query_id int, tenant_id string, corpus_version string, qvec array<double>")
    got = {r.query_id: r.seq for r in reliability.cached_answers(asked, entries).collect()}
    assert got == {0: "e1", 1: "e0", 3: "e9"}
    assert reliability.cached_answers(asked.limit(0), entries).count() == 0 == reliability.cached_answers(asked, entries.limit(0)).count()


def test_hops_go_on_from_the_best_paths_only(spark):
    r = np.random.default_rng(8)
    ends = {(int(a), int(b)) for a, b in r.integers(0, 40, (220, 2)) if a != b}
    edges = spark.createDataFrame([("t", f"n{a}", f"n{b}", "R", "u", float(r.choice([0.5, 0.6, 0.8, 0.9, 1.0])), "") for a, b in sorted(ends)], "tenant_id string, src string, dst string, rel_type string, source_uri string, confidence double, evidence string")
    seeds = spark.createDataFrame([("t", f"n{i}") for i in range(4)], "tenant_id string, seed string")
    pick = lambda df: {(x.seed, x.rank, x.hops, round(x.path_confidence, 9), tuple(x.eids), tuple(x.nodes)) for x in df.collect()}
    from pyspark.sql import Window

    every = graph.traverse(seeds, edges, max_hops=3, limit=None, told=False)
    w = Window.partitionBy("tenant_id", "seed").orderBy(F.desc("path_confidence"), "hops", "eids")
    want = pick(every.withColumn("rank", F.row_number().over(w)).where("rank <= 25"))
    best = graph.traverse(seeds, edges, max_hops=3, limit=25)
    assert pick(best) == want and every.count() > 10 * len(want)
    for x in best.collect():  # what the edges say leads from node to node
        assert len(x.triples) == x.hops and all({t.src, t.dst} == {a, b} for t, a, b in zip(x.triples, x.nodes, x.nodes[1:], strict=False))


def test_no_write_of_a_store_is_lost(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    rows = lambda text: store.chunk_rows(spark.createDataFrame([("u", 0, text, [1.0])], "source_uri string, position int, content string, embedding array<float>"), tenant_id="t", chapter="1", embed_model="m")
    s.write(rows("one"))
    # a takes its rows, b writes, a goes on
    read = s._current()
    merged = store.upsert(s._rows(["t"], read[1]), rows("A"))
    assert s.write(rows("B")) == 1
    with pytest.raises(Exception, match="exists"):
        s._switch(read, merged.drop("position"), ["t"])
    assert {r.content for r in s.read("t").collect()} == {"one", "B"}
    assert s.write(rows("A")) == 1 and {r.content for r in s.read("t").collect()} == {"one", "A", "B"}
    assert os.path.exists(f"{tmp_path}/s/CURRENT")
