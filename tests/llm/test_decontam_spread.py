"""Items whose question and answer stand apart, whatever else the benchmark holds."""

from __future__ import annotations

import numpy as np
import pytest


def words(n: int, seed: int) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


@pytest.mark.parametrize("longest", [0, 302, 5000])
def test_spread_leaks_do_not_depend_on_other_items(spark, longest):
    from tessera.llm.decontam import with_leaks

    question, answer = words(18, 1), words(9, 2)
    items = [(0, f"{question}. {answer}.")] + [(i, f"{words(20, 100 + i)}. {words(8, 200 + i)}.") for i in range(1, 29)]
    if longest:
        items.append((99, f"{words(longest - 10, 5)}. {words(10, 6)}."))
    rows = [
        (1, f"{words(300, 10)} {question} {words(150, 11)} {answer} {words(80, 12)}"),  # apart
        (2, f"{answer} {words(3000, 13)} {question}"),  # far apart, the other way round
        (3, f"{words(300, 14)} {question} {words(150, 15)}"),  # no answer
        (4, f"{words(300, 16)} {answer} {words(150, 17)}"),
        (5, f"{words(40, 18)} {question}. {answer}."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.item, x.question_overlap, x.answer_overlap) for x in r.leaks] for r in with_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [(0, 1.0, 1.0)], 2: [(0, 1.0, 1.0)], 3: [], 4: [], 5: [(0, 1.0, 1.0)]}


def test_a_long_item_is_found(spark):
    from tessera.llm.decontam import with_leaks

    item = f"{words(4000, 21)}. {words(900, 22)}."
    docs = spark.createDataFrame([(1, f"{words(500, 23)} {item} {words(500, 24)}"), (2, item[: len(item) // 2])], "doc_id long, text string")
    got = {r.doc_id: [x.item for x in r.leaks] for r in with_leaks(docs, spark.createDataFrame([(7, item), (8, words(12, 25))], "item_id long, text string")).collect()}
    assert got == {1: [7], 2: []}


def test_short_answers_elsewhere_count_as_a_whole():
    from tessera.llm import decontam as d

    question = words(30, 31).split()
    search = d.Searcher(d.build_index([(0, question, ["red", "blue"]), (1, words(30, 32).split(), words(30, 33).split())]))
    near = " ".join([*question, "x", "blue", "red"])
    apart = " ".join([*question, *words(400, 34).split(), "red", "blue"])
    torn = " ".join([*question, *words(400, 34).split(), "red", "and", "blue"])
    assert [len(search.search(t)) for t in (near, apart, torn)] == [1, 1, 0]
