"""The jobs over growing and repeated input, against plain Python and their SQL, and from the command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from test_registry import SF, TABLES, norm

from jobs import chunk_feed, queries, retrieval_report

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KINDS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert got and got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert before == {k: spark.conf.get(k, None) for k in before} and not spark.streams.active


def put(spark, path, name, rows):
    """A file more of documents."""
    spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{path}/tmp-{name}")
    os.makedirs(f"{path}/in", exist_ok=True)
    (part,) = (x for x in os.listdir(f"{path}/tmp-{name}") if x.startswith("part-"))
    os.rename(f"{path}/tmp-{name}/{part}", f"{path}/in/{name}.parquet")


def versions(rows):
    from tessera.operators.chunking import SEPARATORS, split_recursively

    return {(i, n, c, lang) for i, (text, lang) in rows.items() for n, c in enumerate(split_recursively(text, 40, 8, SEPARATORS) if text else [])}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_feed_takes_what_is_new(spark, tmp_path):
    path, said = str(tmp_path), lambda i: f"Document {i}. " + " ".join(f"word{k}" for k in range(i * 7 % 40))
    args = (f"{path}/in", f"{path}/out", f"{path}/checkpoint")
    rows = {i: (said(i), "en" if i % 3 else "de") for i in range(30)}
    put(spark, path, "a", [(i, t, p) for i, (t, p) in rows.items()] + [(None, "no id", "en"), (3, said(3), "de")])
    first = chunk_feed.run(spark, *args, size=40, overlap=8)
    held = lambda: {(r.doc_id, r.position, r.content, r.part) for r in chunk_feed.current(spark, f"{path}/out").collect()}
    assert held() == versions(rows) and (first["batches"], first["documents"], first["rejected"]) == (1, 30, 1)

    stood = files(f"{path}/out")
    assert chunk_feed.run(spark, *args, size=40, overlap=8) == {"batches": 0, "documents": 0, "chunks": 0, "withdrawn": 0, "rejected": 0}
    assert files(f"{path}/out") == stood

    # new documents, a new version (in another part), two withdrawn, one of them for the first time and null
    put(spark, path, "b", [(40, said(40), None), (5, "A new version of it. " * 5, "fr"), (6, " \n", "en"), (7, None, "en"), (99, None, "en")])
    second = chunk_feed.run(spark, *args, size=40, overlap=8)
    rows |= {40: (said(40), None), 5: ("A new version of it. " * 5, "fr"), 6: (None, "en"), 7: (None, "en")}
    assert held() == versions(rows) and (second["documents"], second["withdrawn"]) == (5, 3)
    assert stood.items() <= files(f"{path}/out").items()  # what stood is not written again

    put(spark, path, "c", [(i, None, "en") for i in rows])  # a batch without chunks
    assert chunk_feed.run(spark, *args, size=40, overlap=8)["withdrawn"] == len(rows) and held() == set()


def test_feed_repeats_a_batch_that_was_cut_off(spark, tmp_path):
    path = str(tmp_path)
    args = (f"{path}/in", f"{path}/out", f"{path}/checkpoint")
    put(spark, path, "a", [(i, f"text {i} " * 20, "en") for i in range(9)])
    chunk_feed.run(spark, *args, size=40, overlap=8)
    want = sorted(map(str, chunk_feed.current(spark, f"{path}/out").collect()))
    commit = f"{path}/checkpoint/commits/0"
    os.remove(commit)  # as if the driver had died behind the writes
    os.remove(f"{path}/checkpoint/commits/.0.crc")
    assert chunk_feed.run(spark, *args, size=40, overlap=8)["batches"] == 1
    assert os.path.exists(commit) and sorted(map(str, chunk_feed.current(spark, f"{path}/out").collect())) == want


def test_feed_of_an_empty_table(spark, tmp_path):
    put(spark, str(tmp_path), "a", [])
    done = chunk_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert done["chunks"] == 0


def report(spark, path, run, relevant, **more):
    docs = [(i, f"alpha beta gamma word{i % 5} " + "filler " * i, "en") for i in range(20)]
    spark.createDataFrame(docs, KINDS).write.mode("overwrite").parquet(f"{path}/d")
    spark.createDataFrame([(1, "alpha word3"), (2, "nothing here"), (3, None), (4, "beta word1 " + "x" * 160)], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/q")
    spark.createDataFrame([(i, 1 if i in relevant else 0) for i in range(20)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{path}/{run}-j")
    return retrieval_report.run(spark, f"{path}/d", f"{path}/q", f"{path}/{run}-j", f"{path}/out", run=run, **more)


def test_report_and_change(spark, tmp_path):
    path = str(tmp_path)
    assert report(spark, path, "one", {3, 8, 13, 18, 1, 6}) == {"cases": 3, "regressed": []}
    rows = {r.case_id: r for r in retrieval_report.cases(spark, f"{path}/out").collect()}
    assert {k: r.segment for k, r in rows.items()} == {"1": "short", "2": "short", "4": "medium"}
    assert (rows["1"].precision, rows["1"].mrr, rows["1"].hit_rate) == (0.8, 1.0, 1.0) and rows["4"].relevant == 6
    assert (rows["2"].precision, rows["2"].recall, rows["2"].mrr, rows["2"].retrieved) == (0.0, 1.0, 0.0, 0)
    stood = files(f"{path}/out")
    assert report(spark, path, "two", {0, 1, 6}, baseline="one") == {"cases": 3, "regressed": ["all", "short"]}
    assert stood.items() <= files(f"{path}/out").items()  # another run's partitions stay
    told = {r.segment: r for r in retrieval_report.summary(spark, f"{path}/out").where("run = 'two'").collect()}
    assert told["short"].mrr_change < 0 and told["all"].cases == 3
    assert report(spark, path, "two", {3, 8, 13, 18, 1, 6}, baseline="one")["regressed"] == []  # a run again, with other judgements
    assert {r.run for r in retrieval_report.summary(spark, f"{path}/out").collect()} == {"one", "two"} and retrieval_report.cases(spark, f"{path}/out").count() == 6
    with pytest.raises(ValueError, match="no run three"):
        report(spark, path, "two", {3}, baseline="three")


@pytest.mark.parametrize("module", ["chunk_feed", "retrieval_report"])
def test_command_lines(tmp_path, module):
    common = [sys.executable, f"{ROOT}/jobs/{module}.py", "--documents", f"{SF}/documents.parquet*", "--output", f"file://{tmp_path}/out"]
    more = ["--checkpoint", f"file://{tmp_path}/checkpoint"] if module == "chunk_feed" else ["--questions", f"{SF}/benchmark.parquet", "--judgements", f"{SF}/labels.parquet"]
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"size": 300} if module == "chunk_feed" else {"run": "cli"}))
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run([*common, *more, "--config", str(config)], env=env, capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    events = [json.loads(x[x.index("{") :]) for x in done.stderr.splitlines() if '"event"' in x]
    assert [e["event"] for e in events if e["event"] != "batch"] == ["reads", "wrote", "done"] and os.path.isdir(tmp_path / "out")
    missing = subprocess.run(common[:2], env=env, capture_output=True, text=True, timeout=100)
    assert missing.returncode == 2 and "no value for" in missing.stderr
