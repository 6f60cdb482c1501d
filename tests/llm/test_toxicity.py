"""Segments against brute force, the law of the best segment, weights, held-out labels, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """By definition: the best segment (of equal ones the shortest, then the first), then the same on both sides of it."""

    def within(a: int, b: int) -> list[tuple[int, int]]:
        best = max(((sum(scores[i : j + 1]), i - j, -i, i, j) for i in range(a, b) for j in range(i, b)), default=None)
        if best is None or best[0] <= 0:
            return []
        return [*within(a, best[3]), (best[3], best[4]), *within(best[4] + 1, b)]

    return within(0, len(scores))


def test_segments_by_definition():
    from tessera.llm.toxicity import segments

    r = np.random.default_rng(3)
    for _ in range(300):
        x = np.where(r.random(14) < 0.6, -r.integers(1, 6, 14), r.integers(1, 9, 14)) + r.random(14) / 64
        got = segments(x)
        assert [(a, b) for a, b, _ in got] == maximal(x.tolist())
        assert all(abs(s - x[a : b + 1].sum()) < 1e-9 for a, b, s in got)
    assert segments(np.zeros(0)) == [] and segments(np.full(5, -1.0)) == []


def test_rate_of_the_extreme_value_law():
    from tessera.llm.toxicity import tail_rate

    # two scores, +1 with p and -1 with q: the root is log(q / p)
    assert tail_rate(np.array([1.0, -1.0]), np.array([0.2, 0.8])) == pytest.approx(math.log(4))
    assert tail_rate(np.array([-1.0]), np.array([1.0])) == 1 and tail_rate(np.array([1.0, -0.1]), np.array([0.5, 0.5])) == 1
    r = np.random.default_rng(5)
    x = r.choice([2.0, -1.0], p=[0.1, 0.9], size=(2000, 400))
    rate = tail_rate(np.array([2.0, -1.0]), np.array([0.1, 0.9]))
    sums = np.cumsum(x, axis=1)
    best = (sums - np.minimum.accumulate(np.hstack([np.zeros((2000, 1)), sums[:, :-1]]), axis=1)).max(axis=1)
    k = -math.log(np.mean(best <= 6)) / 400 * math.exp(rate * 6)
    assert np.mean(best > 10) == pytest.approx(1 - math.exp(-k * 400 * math.exp(-rate * 10)), abs=0.03)


def test_weights_follow_stems():
    from tessera.llm.toxicity import ToxicModel, weigh

    counts = {"vil": (60, 20), "vile": (60, 0), "vile$": (30, 0), "vilen": (30, 0), "vilen$": (30, 0), "villa": (0, 20), "vill": (0, 20), "the": (90, 800), "the$": (90, 800), "odd": (1, 0), "odd$": (1, 0)}
    m = ToxicModel(0.1, weigh(counts, 0.1), 0.5)
    assert m.word("vile") > 2 and m.word("vilesto") == m.weights["vile"] and m.word("villages") == 0 and m.word("the") == 0 == m.word("odd")
    assert m.piece("(the-vile!)") == m.word("vile") and m.scores("The  vile\nVILE").tolist() == [-0.5, m.word("vile") - 0.5, m.word("vile") - 0.5]


def test_held_out_labels(spark):
    from tessera.llm import toxicity as x
    from tessera.llm.quality import held_out

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = x.fit(docs, labels.where(~held_out()))
    rows = x.score_documents(docs, model).join(labels, "doc_id").where(held_out()).select("doc_id", "text", "score", "predicted", "toxic", "passages").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.9 and np.mean([r.predicted for r in clean]) < 0.06
    assert np.mean([r.score for r in toxic]) > 0.8 > 0.1 > np.mean([r.score for r in clean])
    for r in rows[:200]:  # a row's score is that of its own text, and passages are where they say
        n, found, best, excess = model.features(r.text)
        assert r.score == pytest.approx(model.score(best, excess))
        assert all(0 <= p.start < p.end <= len(r.text) and not r.text[p.start].isspace() and not r.text[p.end - 1].isspace() and p.expected < 0.05 for p in r.passages)
        assert all(p.score == pytest.approx(model.scores(r.text[p.start : p.end]).sum()) for p in r.passages)


def test_odd_rows_and_labels(spark):
    from tessera.llm import toxicity as x

    kinds = "doc_id long, text string, Score string, found int"
    rows = [(1, "you vile thing " * 30, "a", 1), (2, "a fine day it is " * 30, "b", 2), (None, None, "c", 3), (3, "", "d", 4), (4, "vile " + "fine " * 60_000 + "vile vile vile", "e", 5), (2, "a fine day it is " * 30, "b", 2), (5, "漢字" * 40_000, "f", 6)]
    more = [(100 + i, ("you vile thing" if i % 4 == 0 else "a fine day") + f" it{i}", "", 0) for i in range(200)]
    docs = spark.createDataFrame(rows + more, kinds)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (1, None), (999, 1)], "doc_id long, toxic int")
    model = x.fit(docs, labels)
    out = x.score_documents(docs, model)
    assert out.columns == ["doc_id", "text", "found", "score", "predicted", "passages"]
    got = {r.found: r for r in out.where("found > 0").collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == got[4].predicted == got[6].predicted == 0
    assert out.where("doc_id = 2").count() == 2 and got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got.values())
    assert [got[5].text[p.start : p.end] for p in got[5].passages][-1] == "vile vile vile"
    assert x.score_documents(docs.limit(0), model).count() == 0
    for some, share in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), 1 / 152)):
        assert x.score_documents(docs.limit(1), x.fit(docs, some)).first().score == pytest.approx(share)
    assert x.fit(docs.limit(0), labels).score(-4.0, 0.0) == pytest.approx(0.5)
