from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scores, text as tx, vectors
from tessera.operators import chunking
from tessera.sources import loaders


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<float>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_clean_text(spark):
    assert one(spark, tx.clean_text("t"), t="15% of $2.3M  and calc(a[0]") == "15% of $2.3M and calc(a[0]"
    assert one(spark, tx.clean_text("t"), t="ofﬁce retrie-\nval é-\n x Ａ\x07") == "office retrieval éx A"
    assert one(spark, tx.clean_text("t"), t="a\r\nb\n\n\n\nc \t d ") == "a\nb\n\nc d"
    assert one(spark, tx.clean_text("t", preserve_layout=False), t=" a\n\nb c ") == "a b c"
    assert one(spark, tx.clean_text("t"), t=None) == ""


def test_parsers(spark):
    table = [("8", 0.8), ("Score: 7.5 of 10", 0.75), ("12", 1.0), ("none", 0.3), ("", 0.3)]
    for raw, want in table:
        assert one(spark, tx.parse_score("t", F.lit(0.3)), t=raw) == pytest.approx(want)
    for raw, want in [("it is supported", "SUPPORTED"), ("UNSUPPORTED", "UNSUPPORTED"), ("supported, or contradicted?", "CONTRADICTED"), ("?", None)]:
        assert one(spark, tx.match_verdict("t"), t=raw) == want
    assert one(spark, tx.json_array("t"), t='sure: ["a", "b"] ok') == ["a", "b"]
    assert one(spark, tx.json_object("t", "a int"), t='x {"a": 3} y').a == 3 and one(spark, tx.json_object("t", "a int"), t="no") is None
    assert [one(spark, tx.yes_no("t"), t=t) for t in ("yes.", "NO", "maybe")] == [1.0, 0.0, None]
    assert one(spark, tx.relation_type("t"), t=" works at ") == "WORKS_AT"
    assert one(spark, tx.split_sentences("t"), t="A b. C d! e? f") == ["A b.", "C d!", "e?", "f"]
    assert one(spark, tx.citations("t"), t="x [2] y [10]") == [2, 10]
    assert one(spark, tx.capitalized_mentions("t"), t="does Ada Lovelace know Acme-Co?") == ["Ada Lovelace", "Acme-Co"]
    assert one(spark, tx.fill_template("evaluate", context=F.lit("c"), question=F.lit("q")), t="").count("{") == 1


def test_names_and_renders(spark):
    assert one(spark, tx.canonicalize("t"), t="Ácme  Corp.") == one(spark, tx.canonicalize("t"), t="ACME, Inc") == "acme"
    assert one(spark, tx.triple_sentence(F.lit("A"), F.lit("WORKS_AT"), F.lit("B"), "t"), t="e") == 'A works at B. Supporting text: "e"'
    assert one(spark, tx.jaccard(tx.token_set("t"), tx.token_set(F.lit("a b"))), t="A c") == pytest.approx(1 / 3)
    assert one(spark, tx.jaccard(tx.token_set("t"), tx.token_set(F.lit("a"))), t=" ") == 0
    assert one(spark, tx.estimate_tokens("t"), t="") == 1
    assert one(spark, tx.fuzzy_ratio("t", F.lit("meridian project")), t="meridian projects") > 0.9


def test_vectors_and_scores(spark):
    assert one(spark, vectors.cosine("v", F.array(F.lit(0.0), F.lit(0.0))), v=[1.0, 2.0]) == 0
    assert one(spark, vectors.l2_normalize("v"), v=[0.0, 0.0]) == [0, 0] and one(spark, vectors.l2_normalize("v"), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 4.0)], "query_id long, chunk_id string, score double")
    assert sorted(r.score for r in scores.min_max_scale(rows).collect()) == [0, 1, 1, 1]
    assert sorted(r.score for r in scores.max_scale(rows).collect()) == [0.25, 1, 1, 1]
    sized = spark.range(1).select(*[c.alias(k) for k, c in scores.estimate_capacity(F.lit(200_000)).items()]).first()
    assert (sized.chunks, sized.raw_vector_gb) == (5_600_000, 17.2)
    load = spark.range(1).select(*[c.alias(k) for k, c in scores.estimate_load(F.lit(5000)).items()]).first()
    assert (load.queries_per_day, round(load.peak_qps, 1)) == (40_000, 6.9)
    assert one(spark, scores.content_hash(F.lit("u"), F.lit(3), "t"), t="x") == hashlib.sha256(b"u|3|x").hexdigest()


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 950), (2, ""), (3, None), (4, "ab")], "doc_id long, text string")
    rows = [(r.doc_id, len(r.content)) for r in chunking.fixed_size(docs).orderBy("doc_id", "position").collect()]
    assert rows == [(1, 500), (1, 500), (4, 2)]
    with pytest.raises(ValueError):
        chunking.fixed_size(docs, 50, 50)
    assert [r.position for r in chunking.covering_windows(docs, 100, 10).where("doc_id = 1").orderBy("position").collect()] == list(range(11))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 80))
def test_recursive_chunks_are_bounded_and_keep_all_words(text, size):
    chunks = chunking.split_recursively(text, size, size // 4, chunking.SEPARATORS)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(chunks)) >= set(text.replace("\n", "").replace(" ", ""))


def test_structured_chunks(spark):
    md = "lost\n# A\nintro words\n## B\nbody of b\n# C\n\n### D\nlast"
    docs = spark.createDataFrame([(1, md), (2, "no headings here")], "doc_id long, text string")
    rows = [r.content for r in chunking.by_structure(docs).orderBy("doc_id", "position").collect()]
    assert rows == ["A\nintro words", "A > B\nbody of b", "C > D\nlast", "no headings here"]
    parents, children = chunking.parent_child(docs)
    assert children.join(parents, "parent_id", "left_anti").count() == 0
    assert {r.child_id for r in children.collect()} == {r.child_id for r in chunking.parent_child(docs)[1].collect()}


def test_semantic_chunks(spark):
    from tessera.operators.models import hashed_embedding

    topics = [" ".join(["Cats purr and cats sleep."] * 12), " ".join(["Stars burn far away."] * 14)]
    docs = spark.createDataFrame([(1, " ".join(topics)), (2, "One. Two."), (3, "")], "doc_id long, text string")
    rows = chunking.semantic(docs, lambda c: hashed_embedding(c, 64)).orderBy("doc_id", "position").collect()
    assert [r.content for r in rows if r.doc_id == 1] == topics and [r.content for r in rows if r.doc_id == 2] == ["One. Two."]
    stats = chunking.chunk_stats(spark.createDataFrame(rows), "doc_id").where("doc_id = 2").first()
    assert (stats.chunks, stats.avg_chars, stats.std_chars) == (1, 9.0, 0.0)


def test_loaders(spark, tmp_path):
    import zipfile

    (tmp_path / "a.md").write_text("# Title here\n\ntext")
    (tmp_path / "b.html").write_text("<title>T</title><nav>menu</nav><main><p>Hello</p></main><footer>f</footer>")
    (tmp_path / "c.csv").write_text("name,note\nada,\nbob,x\n")
    (tmp_path / "d.txt").write_bytes(b"ok \xff")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    got = {r.metadata["source"]: r for r in loaders.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.md"].metadata["title"] == "Title here" and got["b.html"].text == "Hello" and got["b.html"].metadata["title"] == "T"
    assert got["c.csv"].text == "Table with columns: name, note.\nname: ada\nname: bob; note: x" and got["c.csv"].metadata["row_count"] == "2"
    assert got["d.txt"].text == "ok �" and got["e.docx"].text == "Head\n\nbody"
    with pytest.raises(ValueError):
        loaders.parse_file("x.exe", b"")
    assert loaders.load_text_files(spark, str(tmp_path / "a.md")).first().text.startswith("# Title")


def test_golden_cases(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"cases": [{"id": "x", "query": "q?", "relevant_keywords": ["a"]}, {"case_id": "y", "question": "r?", "is_answerable": false, "relevance_grades": {"c": 2}}]}')
    rows = loaders.load_golden(spark, str(tmp_path / "g.json")).orderBy("case_id").collect()
    assert [(r.case_id, r.question, r.is_answerable, r.relevant_chunk_ids) for r in rows] == [("x", "q?", True, ["a"]), ("y", "r?", False, [])]
    assert rows[1].relevance_grades == {"c": 2}


def test_static_results(spark):
    rows = spark.createDataFrame([("c1", "apples and pears", {"k": "v"}), ("c2", "", {"k": "v"}), ("c3", "pears", {"k": "w"})], "chunk_id string, content string, metadata map<string,string>")
    asked = spark.createDataFrame([(1, "apples pears figs")], "query_id long, question string")
    assert [(r.chunk_id, r.score) for r in loaders.static_results(rows, asked).orderBy("rank").collect()] == [("c1", 0.6667), ("c3", 0.3333)]
    assert [r.chunk_id for r in loaders.static_results(rows, asked, metadata_filter={"k": "v"}).collect()] == ["c1"]


def test_random_order_is_no_matter(spark):
    rows = [(i, f"name {i}") for i in range(50)]
    random.Random(0).shuffle(rows)
    table = spark.createDataFrame(rows, "n long, name string")
    assert loaders.csv_text(table, F.col("n")).first().text.splitlines()[1] == "n: 0; name: name 0"
