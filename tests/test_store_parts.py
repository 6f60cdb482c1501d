"""Writes of the chunk store part by part: the same rows as at once, and what they leave on disk."""

from __future__ import annotations

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.scratch import shared_dir
from test_results_and_skipping import scanned


def rows(spark, *cut, tenant="t", chapter="1", model="m"):
    """(source, position, content) as rows of the store."""
    made = spark.createDataFrame([(s, p, c, [1.0]) for s, p, c in cut], "source_uri string, position int, content string, embedding array<float>")
    return store.chunk_rows(made, tenant_id=tenant, chapter=chapter, embed_model=model)


def held(s, *tenants):
    return sorted((r.tenant_id, r.chapter, r.source_uri, r.content, r.embed_model, r.is_active, r.created_at) for t in tenants for r in s.read(t, active=False).collect())


@pytest.mark.parametrize("sizes", [(0, 0, 0, 0), (0, 1 << 30, 1 << 30, 0)])
def test_a_write_by_parts_gives_the_rows_of_one_at_once(spark, tmp_path, monkeypatch, sizes):
    """sizes: up to which a write goes at once, for each write; parts are read by whole writes and the other way round."""
    many = [(f"u{i}", i % 3, f"text {i}") for i in range(40)]
    first = rows(spark, *many).cache()
    other = rows(spark, ("v", 0, "of another"), tenant="a b%41/c=d", chapter="9").cache()
    # half of them again and some new ones: of equal keys the last counts, the first chapter and time stay
    again = rows(spark, *many[:20], *[("w", i, "new") for i in range(9)], chapter="2", model="m2")
    again = again.unionByName(rows(spark, many[0], chapter="3", model="m3").withColumn("position", F.lit(99))).cache()
    assert first.count() == 40 and other.count() == 1 and again.count() == 30
    got = []
    for name, limits in (("whole", [1 << 30] * 4), ("parts", sizes)):
        s = store.ChunkStore(spark, f"file://{tmp_path}/{name}")
        for limit, write in zip(limits, (lambda s: s.write(first), lambda s: s.write(other), lambda s: s.write(again), lambda s: s.delete("t", "2", soft=True)), strict=True):
            monkeypatch.setattr(store, "PART_BYTES", limit)
            assert write(s) > 0
            assert len(glob.glob(f"{tmp_path}/{name}/v{s.version()}/{store.PART}=*")) == (0 if limit else store.PARTS)
        got.append(held(s, "t", "a b%41/c=d"))
        assert s.delete("t", "2") == 9 and s.delete("t", "2") == 0
        got.append(held(s, "t", "a b%41/c=d"))
    assert got[:2] == got[2:] and [len(g) for g in got[:2]] == [50, 41]
    assert sorted({(r[1], r[4], r[5]) for r in got[0]}) == [("1", "m", True), ("1", "m2", True), ("1", "m3", True), ("2", "m2", False), ("9", "m", True)]


def test_folders_are_put_together_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDERS", 2)
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    for tenant, limit in (("a", 0), ("b", 1 << 30), ("c", 0)):
        monkeypatch.setattr(store, "PART_BYTES", limit)
        s.write(rows(spark, *[("u", i, f"x{i}") for i in range(12)], tenant=tenant))
    assert set(s._current()[1].values()) == {3} and [s.count(t) for t in "abc"] == [12, 12, 12]


def test_a_write_leaves_only_the_store(spark, tmp_path, monkeypatch):
    """Before, the incoming rows stayed as a table of their own, and snapshots for ever."""
    monkeypatch.setattr(store, "PART_BYTES", 0)
    incoming = lambda: {*glob.glob(f"{shared_dir(spark).removeprefix('file://')}/incoming-*")}
    there, kept = incoming(), spark.conf.get("spark.sql.shuffle.partitions")
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    assert s.drop_superseded() == 0
    for _ in range(3):
        assert s.write(rows(spark, *[(f"u{i}", 0, "x") for i in range(30)])) == 30
    assert incoming() == there and spark.conf.get("spark.sql.shuffle.partitions") == kept
    assert s.drop_superseded() == 2 and s.drop_superseded() == 0 and s.count("t") == 30
    (tmp_path / "s/v4").mkdir()  # of a writer at work
    assert s.drop_superseded() == 0 and {x for x in os.listdir(tmp_path / "s") if x.startswith("v")} == {"v3", "v4"}


def test_a_write_leaves_no_shuffle(spark, tmp_path, monkeypatch):
    """Before, the shuffles' files stayed until the driver happened to collect its garbage."""
    monkeypatch.setattr(store, "PART_BYTES", 0)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x: os.path.getsize(x) for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and os.path.exists(x)}
    s, before = store.ChunkStore(spark, f"file://{tmp_path}/s"), shuffled()
    texts = [random.Random(i).randbytes(2000).hex() for i in range(40)]
    for _ in range(2):
        s.write(rows(spark, *[(f"u{i}", 0, t) for i, t in enumerate(texts)]))
    for _ in range(50):  # files go in the background
        left = sum(n for x, n in shuffled().items() if x not in before)
        if left < 40_000:
            break
        time.sleep(0.1)
    assert left < 40_000 < sum(map(len, texts))  # all that stays are counts by tenant


def test_what_a_failed_write_left_is_not_read(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, f"file://{tmp_path}/s")
    s.write(rows(spark, ("u", 0, "x")))
    monkeypatch.setattr(store, "PART_BYTES", 0)
    broken = rows(spark, *[("u", i, f"bad {i}") for i in range(30)])
    written = []

    def stop(of, part):
        if part == 4:
            raise RuntimeError("stopped")
        written.append(part)
        return of(part)

    switch = s._switch
    monkeypatch.setattr(s, "_switch", lambda read, of, *rest: switch(read, lambda part: stop(of, part), *rest))
    with pytest.raises(RuntimeError, match="stopped"):
        s.write(broken)
    assert written == [0, 1, 2, 3] and os.path.exists(tmp_path / "s/v2") and s.version() == 1 and s.count("t") == 1
    monkeypatch.undo()
    assert s.write(rows(spark, ("w", 0, "y"))) == 1 and {r.content for r in s.read("t").collect()} == {"x", "y"}


def test_a_source_in_all_parts_is_read_without_the_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PART_BYTES", 0)
    s, n = store.ChunkStore(spark, f"file://{tmp_path}/s"), 80_000
    cut = spark.range(n).select(F.format_string("%05d.md", F.col("id") % 4000).alias("source_uri"), F.floor(F.col("id") / 4000).alias("position"), F.lit("c").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    assert s.write(store.chunk_rows(cut, tenant_id="t", chapter="c", embed_model="m")) == n
    one = s.read("t", "c", sources=["01234.md"])
    assert one.count() == 20 and scanned(one) <= n / 2 and s.count("t") == n
