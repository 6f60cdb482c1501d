"""Fingerprints of text without spaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def likeness_of(spark, a, b):
    from tessera.llm.syncmers import fingerprint_documents, likeness

    made = fingerprint_documents(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")).orderBy("doc_id")
    x, y = (r.fingerprint_sketch for r in made.collect())
    return spark.createDataFrame([(x, y)], made.select("fingerprint_sketch", F.col("fingerprint_sketch").alias("o")).schema).select(likeness(F.col("fingerprint_sketch"), F.col("o")).alias("l")).first().l


def test_a_shift_leaves_unbroken_text_alike(spark):
    r = np.random.default_rng(2)
    han = "".join(chr(c) for c in r.integers(0x4E00, 0x9FA5, 4000))
    base64 = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 4000))
    thai = "".join(chr(c) for c in r.integers(0x0E01, 0x0E2E, 4000))
    for text in (han, base64, thai):
        for shift in (1, 3, 15):
            assert likeness_of(spark, text, text[7 : 7 + shift] + text) > 0.8
        assert likeness_of(spark, text, text[1000:] + text[:1000]) > 0.8 and likeness_of(spark, text, text[::-1]) < 0.1
    assert likeness_of(spark, han, base64) == 0.0


def test_units(spark):
    from tessera.llm.syncmers import UNITS

    said = {"plain words, as they are!": ["plain", "words,", "as", "they", "are!"], "漢字かな abc漢x": ["漢", "字", "か", "な", "abc", "漢", "x"], "x" * 40: ["x" * 16, "x" * 16, "x" * 8],
            "https://example.org/a1b2c3": ["https://e", "xa", "mple", ".o", "rg/a", "1b2", "c3"], "sixteen_letters_": ["sixteen_letters_"], "": []}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = [r.u for r in rows.orderBy("i").select(F.regexp_extract_all("t", F.lit(UNITS), F.lit(0)).alias("u")).collect()]
    assert got == list(said.values()) and all("".join(u) == t.replace(" ", "") for u, t in zip(got, said, strict=True))
