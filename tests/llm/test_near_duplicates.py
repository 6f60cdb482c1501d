"""The near-duplicate groups of the pipeline against all pairs."""

from __future__ import annotations

import numpy as np


def brute_groups(texts):
    from tessera.llm.simhash import shingle_set

    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 0.8 * max(len(sets[i]), len(sets[j])) > min(len(sets[i]), len(sets[j])):
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def groups(spark, texts):
    from tessera.llm.simhash import near_duplicate_texts

    rows = near_duplicate_texts(spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")).collect()
    assert len(rows) == len(texts)
    return [r for _, r in sorted((r.key, r.root) for r in rows)]


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = vocabulary[rng.integers(len(vocabulary))]
    return " ".join(out)


def test_copies_of_one_original_are_one_group(spark):
    """Each copy is like the original, not like the other copies."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    original = [vocabulary[i] for i in rng.integers(0, 3000, 300)]
    texts = [edited(rng, original, 6, vocabulary) for _ in range(200)]
    texts.insert(100, " ".join(original))
    assert set(brute_groups(texts)) == {0}
    assert set(groups(spark, texts)) == {0}


def test_pairs_of_long_texts_are_all_found(spark):
    """Zipf words and similarities around 0.8: word fingerprints of such pairs often differ too much."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = 1 / np.arange(1, 3001)
    texts = ["", " ", "one", "One", "two"]
    for size in (30, 300, 1000, 3000):
        for share in (0.018, 0.02, 0.021, 0.022, 0.024):
            for _ in range(2):
                words = [vocabulary[i] for i in rng.choice(3000, size, p=weights / weights.sum())]
                texts += [" ".join(words), edited(rng, words, max(1, int(share * size)), vocabulary)]
    want = brute_groups(texts)
    assert 10 < len(texts) - len(set(want)) < len(texts) // 2
    assert groups(spark, texts) == want
