"""Blocks of items in decontamination."""

from __future__ import annotations

import numpy as np


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    """Edited passages, so that scores are under 1; items of different lengths and with common words."""
    from tessera.llm import decontam as d

    rng = np.random.default_rng(3)
    said = [[f"w{i}" for i in rng.zipf(1.4, int(rng.integers(20, 60))) % 500] for _ in range(10)]
    items = [(i, f"{' '.join(w[:-9])}. {' '.join(w[-9:])}.") for i, w in enumerate(said)] + [(10, None), (11, "")]
    rows = [(i, " ".join(f"x{k}" if k == 5 else x for k, x in enumerate(w)) + " tail of the text") for i, w in enumerate(said)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {r.doc_id: [tuple(round(v, 9) for v in x) for x in r.leaks] for r in d.with_leaks(docs, bench).collect()}

    want = found()
    assert any(0 < x[1] < 1 for hits in want.values() for x in hits)
    for size in (1, 3, 5):
        monkeypatch.setattr(d, "BLOCK_ITEMS", size)
        assert found() == want
