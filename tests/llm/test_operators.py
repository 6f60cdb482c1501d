"""The training-data operators against brute force, with nulls, empty and very long texts, ties, repeats and clashing names."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, key string, spans string, score string, fingerprint string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, loops, nulls, a long text without spaces."""
    passage, base = words(120, 1), words(200, 2)
    near = base.split()
    near[50], near[120] = "changed", "again"
    rows = [(5, base), (1, base), (2, " ".join(near)), (3, words(40, 3) + " " + passage + " " + words(30, 4)), (4, words(10, 5) + " " + passage), (6, None), (7, ""), (8, "short")]
    rows += [(9, "ha " * 400), (10, "ha " * 300 + "x"), (11, "z" * 30_000), (12, "é漢 " * 150), (13, passage), (14, words(60, 6) + "\n" + passage[:300]), (15, "short")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Several partitions; extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", "s", "x", "f") for i, t in texts], ODD).repartition(3)


def test_piece_encoder_equals_library():
    import public_tokenizers as P

    from tessera.llm.tokens import PieceEncoder

    r = random.Random(0)
    alphabet = [" ", " ", "\n", "\t", "a", "B", "é", "12", "!", "'s", "'", "#", "ß", "Σ", "<|endoftext|>", "漢", "\r", "́", "\xa0", "\x00"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = PieceEncoder(P.path(name), memo_pieces=200)
        assert e.prepare is not None
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
            assert e.encode(t) == e.whole(t), repr(t)


def test_added_tokens_are_the_librarys():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tessera.llm.tokens import PieceEncoder

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain, e = Tokenizer.from_file(P.path(name)), PieceEncoder(P.path(name))
        for t in ("a <|endoftext|> b", "<|startoftext|>a", "x<|endoftext|><|endoftext|>\n", "<|ENDOFTEXT|> <|endoftext", "a <| endoftext|>"):
            assert np.frombuffer(e.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_differencing_balances_and_holds():
    from tessera.llm.packing import balanced_windows, differencing

    assert sorted(np.bincount(differencing(np.array([4, 5, 6, 7, 8]), 2), weights=[4, 5, 6, 7, 8])) == [14, 16]
    r = np.random.default_rng(0)
    for _ in range(30):
        sizes = r.integers(1, 513, r.integers(1, 400))
        w = balanced_windows(sizes, 2048)
        sums = np.bincount(w, weights=sizes)
        assert sums.max() <= 2048 and len(sums) <= -(-sizes.sum() // 2048) + 2
    assert balanced_windows(np.array([2048, 2048]), 2048).tolist() in ([0, 1], [1, 0])


def test_packing(spark, docs, texts):
    import public_tokenizers as P

    from tessera.llm.packing import pack_documents, sequences
    from tessera.llm.tokens import PieceEncoder

    path = P.path("byte_bpe_50k.json")
    pieces = pack_documents(docs, path)
    rows = pieces.collect()
    e = PieceEncoder(path)
    for i, t in texts:
        mine = sorted((r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert b"".join(x[2] for x in mine) == e.whole(t or "") + (1).to_bytes(4, "little")
        assert [x[0] for x in mine] == list(np.cumsum([0, *[x[1] for x in mine]])[:-1])
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    for r in sequences(pieces).collect():
        n = sum(r.lengths)
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 2048)
    even = spark.createDataFrame([(i, "a" * 0) for i in range(8)], "doc_id int, text string").coalesce(1)
    assert [len(r.ids) for r in sequences(pack_documents(even, path)).collect()] == [32]
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id int, text string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pack_documents(odd, path).collect()) == [("3", 1), ("None", 2), ("None", 2)]
    assert pack_documents(docs.limit(0), path).count() == 0


def test_token_files_round_trip(spark, docs, texts):
    import public_tokenizers as P

    from tessera.llm.shared import scratch_path
    from tessera.llm.token_files import read_token_files, sequence, write_token_files
    from tessera.llm.tokens import PieceEncoder

    path, folder = P.path("word_bpe_49k.json"), scratch_path(spark, "t")
    manifest = write_token_files(docs, folder, path, seq_len=64, shards=3)
    rows = sorted(read_token_files(spark, folder, manifest).collect(), key=lambda r: r.doc_id)
    e, at = PieceEncoder(path), 0
    for (i, t), r in zip(sorted(texts), rows, strict=True):
        want = e.whole(t or "") + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(want) // 4, want)
        at += r.n_tokens
    first = next(m[0] for m in manifest if m[1])
    ids, mask = sequence(folder, first, 0)
    assert len(ids) == len(mask) == 64 and ids.to_pylist()[: rows[0].n_tokens] == np.frombuffer(bytes(rows[0].ids), "<u4")[:64].tolist()
    assert read_token_files(spark, folder, write_token_files(docs.limit(0), scratch_path(spark, "t"), path)).count() == 0
    # ids of 32 bits, null and repeated ones, and several shards of a range
    odd = spark.createDataFrame([(None, "a"), (7, "b c"), (7, None), (7, "b c"), (2, "d " * 200), (9, "")], "doc_id int, text string")
    folder = scratch_path(spark, "t")
    manifest = write_token_files(odd, folder, path, seq_len=16, shards=1, shard_tokens=3)
    assert len(manifest) > 1 and sum(m[1] for m in manifest) == 6
    rows = read_token_files(spark, folder, manifest, id_type=odd.schema["doc_id"].dataType).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 2, 7, 7, 7, 9]
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1]) and rows[1].n_tokens > 200


def test_syncmers(spark, docs, texts):
    from tessera.llm.syncmers import fingerprint_documents, likeness, positioned_anchors, with_next

    rows = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert rows[1].fingerprint == rows[5].fingerprint != rows[2].fingerprint and rows[6].fingerprint == rows[7].fingerprint
    pairs = fingerprint_documents(docs).select("doc_id", "fingerprint_sketch")
    two = pairs.alias("a").join(pairs.alias("b"), F.expr("a.doc_id = 1 AND b.doc_id IN (2, 5, 13)")).select(F.col("b.doc_id").alias("d"), likeness(F.col("a.fingerprint_sketch"), F.col("b.fingerprint_sketch")).alias("l"))
    near = {r.d: r.l for r in two.collect()}
    assert near[5] == 1.0 and 0.7 < near[2] < 1.0 and near[13] < 0.1
    # the same passage has the same anchors wherever it stands
    spot = {i: {r.hash for r in positioned_anchors(docs).where(f"doc_id = {i}").collect()} for i in (3, 13)}
    assert len(spot[13] - spot[3]) <= 2
    lead = {r.doc_id: r.next_text for r in with_next(docs.select("doc_id", "text"), "doc_id", ["text"], 3).collect()}
    order = sorted(texts)
    assert lead == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    assert sorted(str(r.next_text) for r in with_next(odd, "doc_id", ["text"], 3).collect()) == ["None", "a", "b", "b"]
    assert with_next(odd.limit(0), "doc_id", ["text"], 3).count() == 0


def chained(values):
    """Spark's xxhash64 over several longs."""
    import struct

    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(units):
    """(hash, position) of the closed syncmers of 8 units with inner substrings of 3."""
    inner = [chained(units[i : i + 3]) for i in range(len(units) - 2)]
    at = [i for i in range(len(units) - 7) if min(inner[i : i + 6]) in (inner[i], inner[i + 5])]
    return [(chained(units[i : i + 8]) & 0x7FFFFFFF, i) for i in at] or [(chained(units) & 0x7FFFFFFF, 0)]


def brute_sketch(units):
    first = {}
    for h, i in brute_anchors(units):
        first.setdefault(h, i)
    return sorted(first.items())[:64]


def brute_likeness(a, b):
    a, b = dict(a), dict(b)
    union = sorted({*a, *b})[:64]
    matched = sorted((a[h], b[h]) for h in union if h in a and h in b)
    return sum(k == 0 or matched[k - 1][1] < y for k, (_, y) in enumerate(matched)) / len(union)


def test_fingerprints_and_likeness_by_definition(spark):
    import re

    import xxhash

    from tessera.llm.syncmers import anchor_positions, fingerprint_documents, likeness, positioned_anchors, unit_hashes

    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)] + ["x" * 40]
    long = [words[i] for i in r.integers(0, len(words), 900)]
    short = [words[i] for i in r.integers(0, 20, 60)]
    texts = [" ".join(long), " ".join(long[:450] + long[600:]), " ".join(long[450:] + long[:450]), " ".join(short), " ".join(short[:7]), "ab " * 300, "", None]
    units = []
    for t in texts:
        found = [xxhash.xxh64_intdigest(u, 42) for u in re.findall("[^\x20\x09-\x0d]{1,16}", t or "")]
        units.append([u - (1 << 64) if u >> 63 else u for u in found])
    made = fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sketches = [brute_sketch(u) for u in units]
    assert {x.doc_id: x.fingerprint for x in made.collect()} == {k: "".join(f"{h << 32 | i:016x}" for h, i in s) for k, s in enumerate(sketches)}
    pairs = made.select(F.struct("doc_id", "fingerprint_sketch").alias("a")).join(made.select(F.struct("doc_id", "fingerprint_sketch").alias("b")))
    got = {(x.i, x.j): x.l for x in pairs.select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), likeness(F.col("a.fingerprint_sketch"), F.col("b.fingerprint_sketch")).alias("l")).collect()}
    assert got == {(i, j): brute_likeness(a, b) for i, a in enumerate(sketches) for j, b in enumerate(sketches)}
    assert got[0, 0] == got[6, 7] == 1.0 and 0.5 < got[0, 1] < 1.0 and got[0, 3] == 0.0
    listed = positioned_anchors(made.where("doc_id = 0")).collect()
    assert sorted((x.hash, x.position) for x in listed) == sorted(brute_anchors(units[0]))
    share = len(listed) / len(long)
    assert 0.25 < share < 0.45  # two of six places of the least substring
    few = spark.createDataFrame([("",), ("a b",)], "t string").select(F.size(anchor_positions(unit_hashes(F.col("t")))).alias("n")).collect()
    assert [x.n for x in few] == [0, 0]


def test_next_row_of_string_ids_and_clashing_names(spark):
    from tessera.llm.syncmers import with_next

    rows = spark.createDataFrame([(f"k{i:03d}", f"t{i}", i, "x") for i in range(50)], "id string, text string, bucket int, NEXT_text string")
    got = {r.id: (r.next_text, r.bucket) for r in with_next(rows, "id", ["text"], 7).collect()}
    assert got == {f"k{i:03d}": (f"t{(i + 1) % 50}", i) for i in range(50)}


def test_texts_without_a_closed_syncmer_have_an_anchor(spark):
    from tessera.llm.syncmers import fingerprint_documents, likeness

    rows = spark.createDataFrame([(i, f"a{i} b{i} c{i} d e f g h") for i in range(60)], "doc_id long, text string")
    made = fingerprint_documents(rows).select("fingerprint", likeness(F.col("fingerprint_sketch"), F.col("fingerprint_sketch")).alias("same")).collect()
    assert all(r.same == 1.0 and len(r.fingerprint) == 16 for r in made) and len({r.fingerprint for r in made}) == 60


def test_simhash_links_against_all_pairs(spark):
    from tessera.llm.simhash import components, fingerprint_links

    r = np.random.default_rng(3)
    base = r.integers(-(2**63), 2**63 - 1, 60)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, 5), replace=False)) for b in base for _ in range(6)]
    fps = sorted(set(near))
    rows = spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(3)
    got = {x.node: x.root for x in components(fingerprint_links(rows)).collect()}
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_near_duplicates(spark, docs, texts):
    import xxhash

    from tessera.llm.simhash import near_duplicates, simhash, without_near_duplicates

    t = "one two THREE four five"
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("one two three", "two three four", "three four five")]
    assert simhash(t) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5) and simhash(None) == simhash(" ") == 0
    rows = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(rows) == len(texts) and rows[5].component_id == rows[1].component_id == 1 and rows[7].component_id == 6 and rows[6].fingerprint == "0" * 16
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 9, 11, 12, 13, 14] or 2 not in {r.doc_id for r in kept.collect()}
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c d e"), (2, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in without_near_duplicates(odd).collect()) == ["None", "a b", "c d e"]
    assert near_duplicates(odd).count() == 5 and near_duplicates(odd.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    from tessera.llm.suffix_array import permuted_common_prefixes, suffix_array

    r = random.Random(0)
    for _ in range(400):
        u = np.array([r.randint(1, r.choice([1, 2, 26])) for _ in range(r.randint(0, 60))], dtype=np.uint8)
        sa, b = suffix_array(u, 257), bytes(u)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        p = permuted_common_prefixes(u, sa, 16)
        for k in range(1, len(sa)):
            i, j, n = sa[k], sa[k - 1], 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert p[i] == min(n, 16)


def brute_bytes(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def brute_words(texts, length=50):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w, mine = (t or "").encode().split(), []
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            mine.append(tuple(w[p : p + length]))
            if mine[-1] in seen:
                gone[p : p + length] = b"\1" * length
        seen.update(mine)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("max_units", [1_000_000, 1])
def test_substring_dedups_against_brute_force(spark, docs, texts, max_units):
    from tessera.llm import automaton_dedup, suffix_dedup

    got = suffix_dedup.without_repeats(docs, windows=dataclasses.replace(suffix_dedup.WINDOWS, max_units=max_units)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_bytes(texts)
    got = automaton_dedup.without_repeats(docs, windows=dataclasses.replace(automaton_dedup.WINDOWS, max_units=max_units)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_words(texts)


def test_substring_dedups_of_odd_ids(spark):
    from tessera.llm import automaton_dedup, suffix_dedup

    long = words(80, 9)
    odd = spark.createDataFrame([(None, long), (1, long), (1, long), (1, "x"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.without_repeats(odd).collect()) == [0, 0, 0, len(long), len(long)]
    assert sorted(r.n_removed for r in automaton_dedup.without_repeats(odd).collect()) == [0, 0, 0, 80, 80]
    assert suffix_dedup.without_repeats(odd.limit(0)).count() == automaton_dedup.without_repeats(odd.limit(0)).count() == 0


def test_suffix_automaton_matches():
    from tessera.llm.automaton_dedup import SuffixAutomaton

    r = random.Random(1)
    for _ in range(100):
        held = [[r.randint(0, 3) for _ in range(r.randint(0, 20))] for _ in range(3)]
        asked = [r.randint(0, 3) for _ in range(20)]
        a = SuffixAutomaton()
        for h in held:
            a.add(h)
        stands = lambda x: any(h[i : i + len(x)] == x for h in held for i in range(len(h) - len(x) + 1))
        assert a.matches(asked) == [max(n for n in range(i + 2) if n == 0 or stands(asked[i + 1 - n : i + 1])) for i in range(20)]


def test_cut_repeats_keeps_characters(spark):
    from tessera.llm.suffix_dedup import cut_repeats

    rows = spark.createDataFrame([(1, "漢字" * 60, "a", 0), (2, "x" + "漢字" * 60 + "y", "b", 0), (3, None, "c", 0)], "doc_id long, text string, left string, n_chars long")
    got = {r.doc_id: r for r in cut_repeats(rows).collect()}
    assert got[2].text == "xy" and got[2].n_chars == 2 and got[2].left == "b" and got[3].text is None and len(got[1].text) < 120


def test_decontamination(spark):
    from tessera.llm.decontam import with_leaks

    items = [(i, f"{words(20, 100 + i)}. {words(8, 200 + i)}.") for i in range(12)] + [(20, None), (21, "")]
    leak = items[3][1]
    rows = [(1, words(300, 7) + " " + leak.upper() + " " + words(50, 8)), (2, words(300, 9)), (3, None), (4, ""), (5, leak.split(".")[0]), (6, leak), (7, "... " + leak.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, Leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [x.item for x in r.found] for r in with_leaks(docs, bench, out_col="found").collect()}
    assert got == {1: [3], 2: [], 3: [], 4: [], 5: [], 6: [3], 7: [3]}
    assert all(not r.found for r in with_leaks(docs, bench.limit(0), out_col="found").collect())
    long = spark.createDataFrame([(None, words(60_000, 5) + " " + leak), (1, None), (1, None)], "doc_id int, text string")
    assert sorted(str([x.item for x in r.leaks]) for r in with_leaks(long, bench).collect()) == ["[3]", "[]", "[]"]
    clash = with_leaks(docs, bench)
    assert clash.columns == ["doc_id", "text", "leaks"] and with_leaks(docs.limit(0), bench).count() == 0


def test_wand_retrieves_what_all_scores_do(spark):
    """Cursors over items with few different words, so that many share terms and blocks."""
    from tessera.llm import decontam as d

    r = np.random.default_rng(9)
    parts = [(i, [f"w{k}" for k in r.zipf(1.3, 14) % 300], [f"w{k}" for k in r.zipf(1.3, 6) % 300]) for i in range(500)]
    index = d.build_index(parts)
    search = d.Searcher(index)
    reached = 0
    for _ in range(200):
        _, q, a = parts[r.integers(500)]
        mine = {index.terms[w] for w in [*q[: r.integers(6, 15)], *a, *[f"w{k}" for k in r.integers(0, 300, 12)]] if w in index.terms}
        scores = np.zeros(500)
        for t in mine:
            np.add.at(scores, index.essential[t], index.impacts[t])
        want = {i: scores[i] for i in np.flatnonzero((scores + index.rest >= search.threshold - 1e-9) & (scores > 0))}
        got = dict(search.wand(sorted(mine)))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        reached += len(got)
    assert reached > 150


def test_decontamination_against_brute_force(spark):
    from tessera.llm import decontam as d

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    parts = [(r.item_id, *d.question_and_answer(r.text)) for r in items]
    search = d.Searcher(d.build_index(parts))
    want = set()
    for r in docs:
        w = d.words_of(r.text)
        held, said = set(zip(*(w[i:] for i in range(5)), strict=False)), set(w)
        want |= {(r.doc_id, i) for i, q, a in parts if d.shingle_overlap(q, held, said) >= 0.8 and d.shingle_overlap(a, held, said) >= 0.8}
    assert {(r.doc_id, x[0]) for r in docs for x in search.search(r.text)} == want and want


def test_quality_is_learnt_and_compiled(spark):
    from tessera.llm import quality as q

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = q.fit(docs, labels.where(~q.held_out()))
    scored = q.score_documents(docs, model).join(labels, "doc_id").where(q.held_out()).collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    x = q.with_statistics(docs.limit(50)).select([F.col("stats")[s].alias(s) for s in q.STATISTICS]).collect()
    compiled = q.score_documents(docs.limit(50), model).select("score").collect()
    assert np.allclose(model.score(np.array([tuple(r) for r in x])), [r.score for r in compiled])
    odd = spark.createDataFrame([(None, None, 9), (1, "", 9), (1, "a " * 100_000, 9)], "doc_id long, text string, SCORE int")
    assert all(0 <= r.score <= 1 for r in q.score_documents(odd.select("doc_id", "text"), model).collect())
    assert q.fit(docs.limit(0), labels).score(np.zeros((1, len(q.STATISTICS)))) == pytest.approx(0.5)


def plain_statistics(text):
    t = text or ""
    words, lines = [w for w in re.split("[\x20\x09-\x0d]+", t) if w], t.split("\n")
    kinds = [unicodedata.category(c) for c in t]
    letters = sum(k[0] == "L" for k in kinds)
    plain = set(" \t\n\x0b\f\r.,;:!?'\"()|-")
    chars, n = max(len(t), 1), max(len(words), 1)
    return {
        "chars": len(t), "words": len(words), "mean_word": len(t) / n, "distinct_words": len(set(words)) / n, "letters": letters / chars,
        "upper": kinds.count("Lu") / max(letters, 1), "digits": sum(k[0] == "N" for k in kinds) / chars,
        "symbols": sum(k[0] not in "LN" and c not in plain for c, k in zip(t, kinds, strict=True)) / chars, "exclaims": t.count("!") / n,
        "bars": t.count("|") / n, "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines),
    }


def plain_score(model, text):
    said, total = plain_statistics(text), model.intercept
    for rule, weight in model.rules:
        if all((said[quality.STATISTICS[j]] > cut) == above for j, above, cut in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_quality_query_against_rules_row_by_row(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = queries.op5_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and model.rules
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-12) and r.predicted == (r.score >= 0.7)


def test_quality_of_odd_rows(spark):
    model = quality.RuleModel(-0.5, [(((0, True, 3.0), (11, False, 0.9)), 1.25), (((5, True, 0.5),), -2.0), (((6, False, 0.1), (8, False, 0.0)), 0.75)])
    odd = [(None, None, 1), (1, "", 2), (1, "", 2), (2, " \t\n ", 3), (3, "A" * 200_000, 4), (4, "x!\n" * 50_000, 5), (5, "Éß 12 ٣ \u2028|", 6), (6, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, SCORE int")
    rows = quality.score_documents(docs, model).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in rows) == sorted((str(i), round(plain_score(model, t), 9)) for i, t, _ in odd)
    assert [c.lower() for c in quality.score_documents(docs, model).columns].count("score") == 1
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_chat_round_trip(spark):
    from tessera.llm.chat import FORMAT_SCHEMA, format_records, read_back, render, parse, turn_records

    for turns in ([], [("user", "<|im_end|>\n\\<|x\\|"), ("assistant", "")], [("", "a"), ("assistant", "\\")], [("a\nb\\n\n", "x" * 300_000), ("assistant", "\n")]):
        assert parse(render(turns)[0]) == turns
    layouts = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
    ]
    odd = [None, "no json", "[1]", json.dumps({"what": {"ever": 1}}), json.dumps({"messages": []})]
    df = spark.createDataFrame([(i, r, "c") for i, r in enumerate([*map(json.dumps, layouts), *odd])], "id int, record string, layout string")
    rows = {r.id: r.chat for r in format_records(df).collect()}
    for i in range(len(layouts)):
        assert [(t.role, t.text) for t in rows[i].turns] == [("user", "q"), ("assistant", "a")]
        assert [rows[i].formatted[a:b] for a, b in rows[i].loss_spans] == ["a"]
    assert [rows[6 + k].layout for k in range(5)] == [None, None, None, None, "messages"] and rows[9].fingerprint and FORMAT_SCHEMA
    parts = [{"type": "text", "text": "q"}, {"type": "image", "url": "u"}]
    wider = [
        {"id": 1, "messages": [{"role": "user", "content": "q", "at": 3}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}}, {"prompt": "q", "completion": "a", "source": "s"},
        {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "a"}]}, {"messages": [{"role": "user", "content": ["q"]}, {"role": "assistant", "content": [{"text": "a"}]}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "c") for i, r in enumerate(wider)], "id int, record string, Chat string")
    for r in format_records(df).collect():
        assert [(t.role, t.text) for t in r.chat.turns] == [("user", "q"), ("assistant", "a")], wider[r.id]
    assert format_records(df.limit(0)).count() == turn_records(df.limit(0).selectExpr("id AS conv_id", "id AS turn", "record AS role", "record AS text")).count() == 0
    turns = spark.createDataFrame([(1, None, None, None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    got = read_back(format_records(turn_records(turns)).select("conv_id", "chat.formatted", "chat.loss_spans")).collect()
    assert {r.conv_id: r.read.loss_text for r in got} == {1: "xx", None: ""}


def test_html_main_text(spark):
    from tessera.llm.html_main import extract_main_text, main_text

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(__import__("html").unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert main_text(r.html) == " ".join(p for p in parts if p)
    prose = "The cat sat on the mat and it was the best of all the days that we have had in this house."
    page = f"<div class='menu'><a href=a>Home</a> <a href=b>News</a></div><div><p>{prose}<p>Short one.<p>{prose}</div><div id=comments><p>{prose}</div><div class='cookie-notice'>{prose}</div><form>{prose}</form>"
    assert main_text(page) == f"{prose} Short one. {prose}"
    assert main_text("<main><h2>T &amp; x</h2><p>a &lt;b&gt;\n c</p></main><script>var p='<p>'</script>") == "T & x a <b> c"
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p" * 50_000, "t"), (4, "<div>" * 5_000 + "x", "t")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[1] == got[2] == "" and set(got) == {1, 2, 3, 4}


@pytest.mark.parametrize("name", ["op2_fingerprints", "op3_simhash", "op7_suffix_dedup", "op8_automaton_dedup", "op9_chat"])
def test_queries_return_the_columns_of_their_contract(spark, name):
    from tessera.llm import queries

    want = {
        "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op3_simhash": "doc_id fingerprint component_id",
        "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op8_automaton_dedup": "doc_id n_words n_removed kept_sha256",
        "op9_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    }[name].split()
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want and got.count() > 0


def test_op1_and_op6_digests(spark):
    from tessera.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(queries.op6_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    rows = queries.op1_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    used = {r.sequence_id for r in rows}
    assert sum(r.length for r in rows) > 0.95 * 2048 * (len(used) - 8)


def test_op2_edits(spark):
    from tessera.llm import queries

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, SF).collect()}
    for k, (i, t) in enumerate(docs):
        h = len(t) // 2
        edited = t[: len(t) - h] + docs[(k + 1) % len(docs)][1][:h]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert np.mean([r.near_edited for r in got.values()]) > 0.25 > 0.05 > np.mean([r.near_next for r in got.values()])
