"""Queries against their SQL on the smallest tables, and the entry module with and without the optional subpackage."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    root = entry_module.__file__.rsplit("/", 1)[0]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e\nassert 'dense_topk' in e.queries() and not any(k.startswith('op1') for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""})
