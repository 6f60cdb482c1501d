"""Bitmaps against plain sums, ranks against brute force and SQL, odd rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def test_bitmaps_add_and_rank_as_numbers_do():
    from tessera.llm import bit_sliced as b

    r = np.random.default_rng(11)
    for n in (1, 63, 64, 65, 700):
        want, total = np.zeros(n, dtype=np.int64), b.Sum(-(-n // 64))
        for top in (1, 5, 1 << 20, 1 << 34, 1 << 47, 3):
            docs = np.flatnonzero(r.random(n) < r.choice([0.05, 0.5, 1.0]))
            values = r.integers(0, top + 1, len(docs))
            if len(docs):
                total.add(*b.slices(docs, values))
                want[docs] += values
            for k in (1, 3, 10, n):
                docs_, scores = total.top(k)
                order = [i for i in sorted(range(n), key=lambda i: (-want[i], i)) if want[i] > 0][:k]
                assert docs_.tolist() == order and scores.tolist() == want[order].tolist()


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """(item, rank, doc, score) from dictionaries."""
    from tessera.llm import bit_sliced as b

    bags = [(i, Counter(b.terms_of(t))) for i, t in docs]
    bags = [(i, bag, bag.total()) for i, bag in bags if bag]
    n, total = len(bags), sum(x for *_, x in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(q * b.weight(n, df[t]) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in Counter(b.terms_of(text)).items() if t in bag)
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [5000, 7])
def test_ranks_against_brute_force(spark, monkeypatch, block):
    from tessera.llm import bit_sliced as b

    monkeypatch.setattr(b, "BLOCK_ITEMS", block)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    text = [(r.doc_id, r.text) for r in docs.collect()]
    got = b.rank_documents(docs.repartition(3), items).select("item_id", "rank", "doc_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == brute(text, [(r.item_id, r.text) for r in items.collect()])


def test_many_segments_a_task():
    import pyarrow as pa

    from tessera.llm import bit_sliced as b

    r = np.random.default_rng(4)
    lists = [sorted(set(r.integers(0, 30, 12).tolist())) for _ in range(100)]
    rows = pa.table({"doc": pa.array(range(100), pa.int64()), "n": pa.array([len(x) for x in lists], pa.int64()), "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))})
    weights = r.integers(1, 5000, 30)
    whole = b.Segment(rows, weights, 100, sum(map(len, lists)))
    parts = [b.Segment(rows.slice(a, 33), weights, 100, sum(map(len, lists))) for a in range(0, 100, 33)]
    bag = [(t, 1 + t % 5) for t in range(0, 30, 3)]
    docs, scores = whole.search(bag, 10)
    each = [(-s, d) for p in parts for d, s in zip(p.ids.take(pa.array(p.search(bag, 10)[0])).to_pylist(), p.search(bag, 10)[1].tolist(), strict=True)]
    assert [(-s, d) for s, d in sorted(each)[:10]] == list(zip(scores.tolist(), docs.tolist(), strict=True))


def test_terms_as_they_are_defined(spark):
    import duckdb

    from tessera.llm import bit_sliced as b
    from tessera.llm.queries import OP12_SQL

    odd = ["Ab-cD_e f ÄÖx\x85y 1.5 İZ", "a\tb\nc\x00d\x7fe [f]^g`h{i}~", "", None, "...", "é \U0001f600K K"]
    assert b.terms_of(odd[0]) == ["ab", "cd", "e f", "ÄÖx\x85y", "1", "5", "İz"] and b.terms_of(odd[1]) == list("abcdefghi")
    docs = [(i, t) for i, t in enumerate([*odd, *odd, "zz " * 5000 + "b", "b a", "x"])]
    items = [(i, t) for i, t in enumerate([*odd, "b b a", "none of these"])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in b.rank_documents(*frames).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute(docs, items)
    c = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", [(i, t.replace("\x00", " ") if t else t) for i, t in rows])
    assert sorted(c.sql(OP12_SQL).fetchall()) == got


def test_odd_ids_and_empty_tables(spark):
    from tessera.llm import bit_sliced as b

    docs = spark.createDataFrame([(None, "a b", 1), ("x", "a b", 2), ("x", "a b", 3), ("c", "a", 4)], "name string, text string, rank int")
    items = spark.createDataFrame([(7, "a b", "q"), (7, "b", "q"), (None, "a", "q"), (8, None, "q")], "item_id int, text string, score string")
    got = b.rank_documents(docs, items, id_col="name", k=3)
    assert got.columns == ["item_id", "rank", "name", "score"]
    rows = [(r["item_id"], r["rank"], r["name"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(7, 1, "x"), (7, 2, "x"), (7, 3, None)] * 2 + [(None, 1, "c"), (None, 2, "x"), (None, 3, "x")], key=str)
    assert b.rank_documents(docs.limit(0), items, id_col="name").count() == 0 == b.rank_documents(docs, items.limit(0), id_col="name").count()
    with pytest.raises(ValueError, match="different names"):
        b.rank_documents(docs, items, id_col="Item_ID")
