"""op3 over whole documents against fingerprints, links of all pairs and components in plain Python."""

from __future__ import annotations

import re

import numpy as np
import pytest


def brute(rows: list[tuple]) -> dict:
    """doc_id -> (fingerprint, least doc_id reachable)."""
    import xxhash

    prints = []
    for _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lowered)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
        ones = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        prints.append(sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(h)))
    fp = np.array(prints, dtype=np.uint64)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: (f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_components_of_all_documents(spark, sf):
    from tessera.llm.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, folder).collect()}
    want = brute(rows)
    assert got == want
    assert sum(c != doc for doc, (_, c) in want.items()) > 5


def test_chains_and_odd_texts_of_components(spark):
    from tessera.llm.simhash import near_duplicates

    r = np.random.default_rng(6)
    base = [f"w{x}" for x in r.integers(0, 300, 400)]
    chain = []
    for i in range(40):  # each text differs from the one before in a word, and from the first in many
        base[i * 9] = f"z{i}"
        chain.append((i, " ".join(base)))
    rows = [*chain, (100, None), (101, ""), (102, "  \n"), (103, "one"), (104, "ONE"), (105, "a b"), (106, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Fp int")
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in near_duplicates(docs).collect()} == brute(rows)
