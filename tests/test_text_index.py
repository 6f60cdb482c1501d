"""The stored text index against the search without one, stems against known pairs and brute force, what is read, odd rows."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.operators import retrieval, text_index

SF = "/root/testdata/sf0.001"

# Pairs of the rules' public description and of its steps.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consols consol consonant conson consort consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir constable constabl
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoped hope hoping hope falling fall hissing hiss failing fail filing file sized size tanned tan
relational relat conditional condit rational ration valenci valenc digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
triplicate triplic formative format formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac
adoption adopt communism communism activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll by by say say cry cri dying die skies sky news news
generously generous general general generate generat communities communiti proceed proceed proceeded proceed innings inning happy happi y y sensational sensat fluently fluentli apology apolog"""


def test_stems_of_known_words():
    pairs = PAIRS.split()
    known = dict(zip(pairs[::2], pairs[1::2], strict=True))
    wrong = {w: (stem(w), s) for w, s in known.items() if stem(w) != s}
    assert wrong == {}
    assert [stem(x) for x in ("", "a", "x86", "naïve", "'cause", "dog's", "boys'", "123")] == ["", "a", "x86", "naïve", "caus", "dog", "boy", "123"]


@pytest.fixture(scope="module")
def tables(spark):
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    short = questions.select((F.col("query_id") + 1000).alias("query_id"), F.concat_ws(" ", F.slice(F.split("question", " "), 3, 3)).alias("question"))
    return questions.unionByName(short), spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def built(spark, tables, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('text')}/index"
    text_index.build_index(tables[1], path)
    return path


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in df.collect())


def test_results_are_those_without_an_index(spark, tables, built):
    questions, corpus = tables
    index = text_index.TextIndex.open(spark, built)  # from the folder alone
    for all_terms in (True, False):
        want = rows(retrieval.lexical_search(questions, corpus, 7, all_terms=all_terms))
        assert rows(index.search(questions, 7, all_terms=all_terms)) == want and len(want) > 50
    want = rows(retrieval.cover_density(questions, corpus, 7))
    assert rows(index.cover_density(questions, 7)) == want and want


def test_only_buckets_and_terms_asked_for_are_read(spark, tables, built):
    index = text_index.TextIndex.open(spark, built)
    asked = index.asked(tables[0].limit(1))
    plan = index.postings(asked)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(term" in plan and "PartitionFilters: [bucket" in plan
    # rows of all terms are looked up for the rarest one's chunks only
    asked = index.asked(tables[0])
    rarest = asked.where("place = 1").agg(F.sum("df")).first()[0]
    found = index._all(asked, "tf").count()
    terms = asked.agg(F.max("n_terms")).first()[0]
    assert found <= rarest * terms and found < index.search(tables[0], 1 << 30, all_terms=False).count()


def test_stemmed_search_by_brute_force(spark, tmp_path):
    docs = ["Consoling the knights, consistently", "a knight consoles", "knightly consistency", "running runs ran", "Relational operators are operating", "", None, "the operator of relations runs", "consolidate " * 3 + "knots"]
    asked = ["knights consoled", "Run operators", "consistent knight", "the of", "unknown knight", None]
    corpus = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    index = text_index.build_index(corpus, f"file://{tmp_path}/stemmed", stem=True)
    bags = [Counter(stem(w) for w in (d or "").lower().replace(",", " ").split()) for d in docs]
    df = Counter(t for b in bags for t in b)
    mean = sum(b.total() for b in bags) / len(docs)
    for every in (True, False):
        want = []
        for q, said in enumerate(asked):
            terms = {stem(w) for w in (said or "").lower().split() if w not in retrieval.STOP_WORDS}
            scored = []
            for i, b in enumerate(bags):
                held = [t for t in terms if b[t]]
                if held and (len(held) == len(terms) or not every):
                    s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for t in held)
                    scored.append((-round(s, 6), i))
            want += [(q, rank, i, round(-s, 5)) for rank, (s, i) in enumerate(sorted(scored)[:4], 1)]
        assert rows(index.search(queries, 4, all_terms=every)) == sorted(want) and want
    assert {r.chunk_id for r in index.cover_density(queries.where("query_id = 0"), 5).collect()} == {0, 1}


def test_empty_tables(spark, tables, tmp_path):
    questions, corpus = tables
    empty = text_index.build_index(corpus.limit(0), f"file://{tmp_path}/none")
    assert empty.search(questions, 5).count() == 0 == empty.cover_density(questions, 5).count()
    assert (empty.chunks, empty.mean) == (0, 0.0)
