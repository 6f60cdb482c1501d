"""The corpus pipeline, each stage against brute force on its own input."""

from __future__ import annotations

import numpy as np

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as cp
    from test_operators import brute_bytes

    from tessera.llm.decontam import question_and_answer, shingle_overlap, words_of
    from tessera.llm.shared import materialize
    from tessera.llm.simhash import shingle_set
    from tessera.llm.suffix_dedup import cut_characters

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in cp.STAGES:
        results.append(materialize(stage(spark, results[-1], SF), name))
    assert all(r.columns == columns for r in results[:-1])
    rows = [{r.doc_id: r for r in x.collect()} for x in results[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(i in rows[1]) == q for i, q in labels.items()]) > 0.95
    # of equal texts one stays, the first; a row that goes is like one that stays
    firsts = {}
    for i in sorted(rows[1]):
        firsts.setdefault(rows[1][i].text, i)
    assert set(rows[2]) <= set(firsts.values())
    for i in set(firsts.values()) - set(rows[2]):
        s = shingle_set(rows[1][i].text)
        assert max(len(np.intersect1d(s, o)) / len(np.union1d(s, o)) for j, r in rows[1].items() if j != i for o in [shingle_set(r.text)]) >= 0.8
    want = brute_bytes([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        size, removed, _, kept = want[i]
        assert r.n_chars == len(r.text) and (r.text == rows[2][i].text) == (removed == 0)
        assert 0 <= len(r.text.encode()) - len(kept) <= 6 * max(1, want[i][2])
    assert cut_characters("aéb", [{"start": 1, "stop": 2}]) == "aéb" and cut_characters("aéb", [{"start": 1, "stop": 3}]) == "ab"
    parts = [question_and_answer(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        w = words_of(text)
        held, said = set(zip(*(w[i:] for i in range(5)), strict=False)), set(w)
        return any(shingle_overlap(q, held, said) >= 0.8 and shingle_overlap(a, held, said) >= 0.8 for q, a in parts)

    assert set(rows[4]) == {i for i, r in rows[3].items() if not leaks(r.text)}
    packed = results[-1].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == set(rows[4]) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_run_applies_all_stages(spark):
    import corpus_pipeline as cp

    assert cp.run(spark, SF).select("doc_id").distinct().count() > 100
