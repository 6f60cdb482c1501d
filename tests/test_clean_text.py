"""clean_text over whole tables, held against a version in plain Python."""

from __future__ import annotations

import hashlib
import random
import unicodedata

from conftest import SF

from tessera.functions import text as tx

SPACE = {c for c in map(chr, range(0x3001)) if unicodedata.category(c) in ("Zs", "Zl", "Zp")} | set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85")


def brute(text: str | None) -> str:
    t = text or ""
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = t.replace(ligature, letters)
    word = lambda c: c == "_" or c.isalnum()
    out, i = [], 0
    while i < len(t):  # a word broken by a hyphen at the end of a line
        stop = i + 2
        while stop < len(t) and t[stop] in SPACE:
            stop += 1
        if t[i + 1 : i + 2] == "-" and word(t[i]) and "\n" in t[i + 2 : stop] and stop < len(t) and word(t[stop]):
            out += [t[i], t[stop]]
            i = stop + 1
        else:
            out.append(t[i])
            i += 1
    t = unicodedata.normalize("NFKC", "".join(out))
    t = "".join(c for c in t if c in "\t\n\r" or not (ord(c) < 32 or ord(c) == 127))
    out = []
    for c in t.replace("\t", " "):
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    t = "".join(out).replace("\r\n", "\n").replace("\r", "\n")
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    low, high = 0, len(t)
    while low < high and t[low] in SPACE:
        low += 1
    while high > low and t[high - 1] in SPACE:
        high -= 1
    return t[low:high]


def test_clean_text_on_a_fixture(spark):
    rng = random.Random(4)
    pieces = ["a", "é", "ß", "ñ", "語", "7", "_", "-", "-\n", "- \n ", "\n", "\r\n", "\r", " ", "\t", " ", "　", "\x07", "\x0b", "\x7f", "\x1c", "e\u0301", "ﬁ", "ﬃ", "Ａ", "½", "é", ".", "[", "$1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(2000)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tx.clean_text("t").alias("c")).collect()
    wrong = [(texts[r.i], r.c, brute(texts[r.i])) for r in rows if r.c != brute(texts[r.i])]
    assert len(rows) == len(texts) and not wrong, wrong[:3]


def test_clean_text_query_covers_all_languages(spark):
    from tessera.plans import registry

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r.h for r in registry.QUERIES["clean_text"](spark, SF).collect()}
    assert len({r.lang for r in docs}) > 1
    assert got == {r.doc_id: hashlib.sha256(brute(r.text).encode()).hexdigest() for r in docs}
