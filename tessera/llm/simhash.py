"""SimHash near-duplicates with anchor-point covering.

Fingerprints are 64-bit SimHashes of 3-word shingles. Two of them link if they differ in at most 3 bits; then
they differ in at most one bit of either the low or the high half. The anchors of a half are the words of the
perfect Hamming code of length 31 over the half's first 31 bits, a covering code of radius 1. A fingerprint is
at home at the one anchor within the radius and is replicated to every anchor within radius + 1 (1 or 16 of
them), so of two linked fingerprints the second is at the home of the first, in one of the halves. Fingerprints
are compared at each anchor, home rows with all rows; only a spanning forest of the links found leaves it.

Equal fingerprints are one row before anything is replicated, so exact copies cost nothing here. Components of
the links are found by alternating large-star and small-star rounds over tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import begin_task, free_name, materialize, split_by_keys, text_batches, with_order_key

SHINGLE = 3
MAX_BITS = 3
#: Rows of an anchor compared at once with its home rows.
BLOCK = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8, A-Z as lower case: what split() and lower() of bytes go by."""
    return (text or "").encode("utf-8", "replace").lower().split()


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; none without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None) -> int:
    """The fingerprint of a text: bit set if set in over half the shingles' XXH64 (seed 42); zero without words."""
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], dtype="<u8"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): one row per document; null text as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        for b in batches:
            values = np.array([simhash(t.as_py()) for t in b.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], names=[id_col, "fp"])

    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


#: Pairs of places (1..31) whose exclusive or is a syndrome: the two-bit flips that lead from a word to a code word.
_PAIRS = np.zeros((32, 15), dtype=np.uint64)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << (j - 1)) for i in range(1, 32) for j in range(i + 1, 32) if i ^ j == _s]


def syndrome(x: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit words: the exclusive or of the places (1..31) of their bits."""
    out = np.zeros(len(x), dtype=np.uint64)
    for place in range(1, 32):
        out ^= np.where(x >> np.uint64(place - 1) & np.uint64(1), np.uint64(place), np.uint64(0))
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (row, anchor key, is home) of all their anchors in both halves."""
    rows, keys, homes = [], [], []
    for half in (0, 1):
        x = fp >> np.uint64(32 * half) & np.uint64((1 << 31) - 1)
        s = syndrome(x)
        tag = np.uint64(half << 31)
        index = np.arange(len(fp))
        rows.append(index)
        keys.append(np.where(s > 0, x ^ (np.uint64(1) << (s - np.uint64(1)) % np.uint64(64)), x) | tag)
        homes.append(np.ones(len(fp), dtype=bool))
        off = np.flatnonzero(s > 0)
        rows.append(np.repeat(off, 15))
        keys.append((x[off, None] ^ _PAIRS[s[off].astype(int)]).ravel() | tag)
        homes.append(np.zeros(15 * len(off), dtype=bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def anchor_links(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links of one anchor's rows that join its components: at most len(fp) - 1 of them.

    Pairs are looked at in blocks; of those that join different components one for each component is taken at a time, so
    there are few rounds however many pairs a block has.
    """
    root, at_home = np.arange(len(fp)), np.flatnonzero(home)
    found: list[tuple[int, int]] = []
    for low in range(0, len(at_home), BLOCK):
        mine = at_home[low : low + BLOCK]
        for start in range(0, len(fp), BLOCK):
            i, j = np.nonzero(np.bitwise_count(fp[mine, None] ^ fp[None, start : start + BLOCK]) <= MAX_BITS)
            i, j = mine[i], j + start
            while True:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                first = np.unique(root[i], return_index=True)[1]
                for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                    ra, rb = a, b
                    while root[ra] != ra:
                        ra = root[ra]
                    while root[rb] != rb:
                        rb = root[rb]
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        found.append((a, b))
                while (root[root] != root).any():
                    root = root[root]
    return found


def fingerprint_links(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(a bigint, b bigint) links between the nodes of (fp) or (fp, node, seed) whose fingerprints differ in at most MAX_BITS bits.

    Fingerprints have to be distinct, or distinct for their seed; without a node column they are the nodes. They are compared only
    with those of their seed. Not all links: a spanning forest of each anchor's, so the components are those of all links.
    """
    nodes = "node" in rows.columns

    def replicate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for low in range(0, len(fp), 4096):
                part = fp[low : low + 4096]
                index, keys, homes = anchors(part)
                columns, names = [part[index].view("<i8"), homes], ["fp", "home"]
                if nodes:
                    columns.append(b.column(1).to_numpy()[low : low + 4096][index])
                    keys = keys | (b.column(2).to_numpy()[low : low + 4096][index].astype(np.uint64) << np.uint64(32))
                    names.append("node")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.view("<i8"), *columns)], names=["anchor", *names])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, node: np.ndarray):
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            size = stops - starts
            out = []
            two = starts[size == 2]
            near = (home[two] | home[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS)
            out.append(np.stack([node[two[near]], node[two[near] + 1]], axis=1))
            for a, b in zip(starts[size > 2].tolist(), stops[size > 2].tolist(), strict=True):
                found = anchor_links(fp[a:b], home[a:b])
                if found:
                    out.append(node[a:b][np.array(found)])
            pairs = np.concatenate(out).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(pairs[:, 0], pairs[:, 1])), pa.array(np.maximum(pairs[:, 0], pairs[:, 1]))], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column(0).to_numpy(), b.column(1).to_numpy().view("<u8"), b.column(2).to_numpy(zero_copy_only=False), b.column(3 if nodes else 1).to_numpy())
            last = now[0][-1]
            cut = int(np.searchsorted(now[0], last))  # sorted: the last anchor may go on
            if cut or (held and held[-1][0][-1] != last):
                whole = [np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in now), strict=True)]
                if len(whole[0]):
                    yield links(*whole)
                held = []
            held.append(tuple(c[cut:] for c in now))
        if held:
            yield links(*[np.concatenate(c) for c in zip(*held, strict=True)])

    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = rows.select("fp", "node", "seed") if nodes else rows.select("fp")
    placed = taken.mapInArrow(replicate, "anchor bigint, fp bigint, home boolean" + ", node bigint" * nodes).repartition(n, "anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links the least node reachable, by large-star and small-star rounds.

    Each round's table is written to the shared folder; rounds go on until one changes nothing.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sums = None
    # the least neighbours under an expression of their own key: so the join has an exchange of its own for either side and AQE
    # can split the many neighbours of one node over tasks
    own = F.bitwise_not(F.bitwise_not("u")).alias("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(own, F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u to the least of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(own, "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", sums and sums[0])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sums:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sums = now


def to_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the least id whose fingerprint is reachable over links.

    Null and empty texts have the zero fingerprint and link like any other; a null id is never the least unless
    its whole component is null. Repeated ids are rows of their own. An empty table gives an empty result. Very long texts are read
    whole, a text at a time; other columns of docs are neither read nor returned, so their names can't clash.
    """
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("first"))
    linked = components(fingerprint_links(distinct))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, to_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: Near-duplicate groups of texts: shingles and similarity of the exact check, and independent fingerprints to find candidates.
CHECK_SHINGLE, CHECK_SIMILARITY, SEEDS = 5, 0.8, 2
#: Common shingles are counted in one of so many texts, and at most so many are told apart.
SAMPLED, COMMON = 16, 50_000
#: Rows whose shingles a worker holds at once, and classes of the parities that go along with shingles.
PART, FOLD = 256, 1024


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="<u8", count=len(words))


def word_fingerprints(hashes: np.ndarray) -> list[int]:
    """SEEDS fingerprints over the distinct words of a text: an edit changes little of them, other than of shingles'."""
    own = np.unique(hashes)
    return [majority(_mix(own + np.uint64(seed) * _A)) for seed in range(SEEDS)]


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the CHECK_SHINGLE-word shingles (of the whole sequence, if shorter) of a text's words."""
    size = min(CHECK_SHINGLE, len(hashes))
    n = len(hashes) - size + 1
    h = np.full(n if size else 1, size, dtype="<u8")
    for i in range(size):
        h = _mix(h * _A + hashes[i : i + n])
    return np.unique(h.view("<i8"))


def shingle_set(text: str | None) -> np.ndarray:
    return shingles_of(word_hashes(text))


def in_parts(batches: Iterator) -> Iterator:
    """The same rows in batches of at most PART."""
    for b in batches:
        for low in range(0, b.num_rows, PART):
            yield b.slice(low, PART)


def common_shingles(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, counts) of at most COMMON shingles that come in several texts of a sample by key.

    They only order shingles, so any sample gives the same groups: the better it is, the fewer texts meet in vain.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()))], names=["s"])

    sample = keyed.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(each, "s bigint")
    rows = sample.groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    found = np.array(sorted((r["s"], r["count"]) for r in rows), dtype="<i8").reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def parity(s: np.ndarray) -> bytes:
    """Bits of the parities of hashes in a power of two of classes, two and more of them per hash (up to 2 ** 16 in all)."""
    bits = 1 << min(16, max(8, (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """A number of hashes by which the sets of two parities differ at least; the longer one is folded."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def profiles(keyed: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, d, fp, n, prefix, parity, fold) of all texts, read once: a digest of the text, its word fingerprints and, of its n shingles,
    the parities, those in FOLD classes, and the prefix: the first in the order of how common they are, then of the hash. Two sets at
    CHECK_SIMILARITY share one of their prefixes' shingles, as what is left is too small for the overlap.
    """
    import hashlib

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")

        def lists(of: list):
            sizes = np.cumsum([0, *map(len, of)])
            return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, dtype="<i8"), *of])))

        for b in in_parts(batches):
            digests, marks, sizes, first, bits, folds = [], [], [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                digests.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
                words = word_hashes(text)
                marks.append(np.array(word_fingerprints(words), dtype="<u8").view("<i8"))
                s = shingles_of(words)
                sizes.append(len(s))
                bits.append(parity(s))
                folds.append(np.packbits(np.bincount(s & (FOLD - 1), minlength=FOLD) & 1, bitorder="little").view("<i8"))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                first.append(s[: len(s) - math.ceil(CHECK_SIMILARITY * len(s) - 1e-9) + 1].copy())
            columns = [b.column(0), pa.array(digests, pa.binary()), lists(marks), pa.array(sizes, pa.int32()), lists(first), pa.array(bits, pa.binary()), lists(folds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "d", "fp", "n", "prefix", "parity", "fold"])

    return text_batches(keyed).select("key", "text").mapInArrow(run, "key bigint, d binary, fp array<bigint>, n int, prefix array<bigint>, parity binary, fold array<bigint>")


def by_shingle(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run on the columns, as arrays, of all rows of some shingles; rows has the shingle first, and run's result fits schema."""

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        names = [c.split()[0] for c in schema.split(", ")]
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy() for c in b.columns]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # sorted: the last shingle may go on
            if cut or (held and held[-1][0][-1] != now[0][-1]):
                for out in run(*[np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                held = []
            held.append([c[cut:] for c in now])
        if held:
            for out in run(*[np.concatenate(c) for c in zip(*held, strict=True)]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "s").sortWithinPartitions("s").mapInArrow(whole, schema)


def _enough(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """If rows i and j can be at CHECK_SIMILARITY when this is the first shingle, in order, that they share."""
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= CHECK_SIMILARITY / (1 + CHECK_SIMILARITY) * (n[i] + n[j]) - 1e-6


def _shared(s: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows whose shingle another row has."""
    same = s[1:] == s[:-1]
    more = np.concatenate([same, [False]]) | np.concatenate([[False], same])[: len(s)]
    yield s[more], key[more], n[more], pos[more]


def _stars(s: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Each shingle's rows with one of them, the same in all shingles that hold it as far as can be; two such choices."""
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        order = np.lexsort((key.view("<u8") * np.uint64(factor), s))
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
        i = np.repeat(order[starts], np.diff(np.append(starts, len(s))))
        keep = _enough(n, pos, i, order) & (key[i] != key[order])
        a, b = key[i[keep]], key[order[keep]]
        yield np.minimum(a, b), np.maximum(a, b)


def _mixed(s: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of shingles that stand in several components."""
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    keep = (np.bincount(group, weights=root != root[np.flatnonzero(new)][group]) > 0)[group]
    yield s[keep], key[keep], n[keep], pos[keep], root[keep]


def _apart(s: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, *bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All pairs of a shingle's rows that are in different components, but for those that sizes, places or parities rule out."""
    marks = np.stack(bits, axis=1).view("<u8")
    most = (1 - CHECK_SIMILARITY) / (1 + CHECK_SIMILARITY)
    found, held, i = [np.empty((0, 2), dtype="<i8")], 0, np.arange(len(s))
    for step in range(1, len(s)):
        i = i[: np.searchsorted(i, len(s) - step)]
        i = i[s[i] == s[i + step]]
        if not len(i):
            break
        near = i[(root[i] != root[i + step]) & _enough(n, pos, i, i + step)]
        differ = np.bitwise_count(marks[near] ^ marks[near + step]).sum(axis=1)
        near = near[differ <= most * (n[near] + n[near + step]) + 1e-6]
        found.append(np.stack([np.minimum(key[near], key[near + step]), np.maximum(key[near], key[near + step])], axis=1))
        held += len(near)
        if held >= 1 << 20:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pairs[:, 0], pairs[:, 1]
            found, held = [np.empty((0, 2), dtype="<i8")], 0
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pairs[:, 0], pairs[:, 1]


def near_duplicate_texts(keyed: DataFrame) -> DataFrame:
    """(key, root) for keyed(key bigint, text): root is the least key of the group; every row is there once.

    Equal texts are one group. Two different texts are linked if their shingle sets have a Jaccard similarity of
    CHECK_SIMILARITY or more, and groups are the components of all such links. Most are found first: texts one of whose
    SEEDS word fingerprints differs in at most MAX_BITS bits (at anchors, as a spanning forest), and stars of the texts
    that share a shingle of their prefixes. As both leave pairs out, all pairs that share a prefix's shingle and are
    still in different components are checked after that, so no link between groups is missed. Texts are never shuffled
    but for those of candidates.
    """
    every = materialize(profiles(keyed, *common_shingles(keyed)), "profiles")
    first = every.groupBy("d").agg(F.min("key").alias("first"))
    exact = materialize(every.select("key", "d").join(first, "d").select("key", "first"), "copies")
    copies = exact.where("key <> first").select("key")
    some, rest = split_by_keys(every, "key", copies)
    ordered = some.join(copies, "key", "left_anti").select(*rest.columns).unionByName(rest).drop("d")

    rows = ordered.select("key", F.posexplode("fp").alias("seed", "fp"))
    distinct = rows.groupBy("seed", "fp").agg(F.min("key").alias("node")).select("fp", "node", "seed")
    equal = rows.join(distinct, ["seed", "fp"]).where("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b"))

    placed = ordered.select(F.posexplode("prefix").alias("pos", "s"), "key", "n").select("s", "key", "n", "pos")
    shared = materialize(by_shingle(placed, _shared, "s bigint, key bigint, n int, pos int"), "shared")
    stars = by_shingle(shared, _stars, "a bigint, b bigint")

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))], names=["key", "s"])

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("simhash")
        most = (1 - CHECK_SIMILARITY) / (1 + CHECK_SIMILARITY)
        for b in in_parts(batches):
            c = b.to_pydict()
            keep = [parity_distance(x, y) <= most * (m + n) + 1e-6 for x, y, m, n in zip(c["pa"], c["pb"], c["na"], c["nb"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def standing(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that are links."""
        ends = [ordered.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "ab"]
        near = pairs.distinct().join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "pa", "pb")
        candidates = materialize(near.mapInArrow(close, "a bigint, b bigint"), "candidates")
        keys = candidates.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        held, _ = split_by_keys(keyed.select("key", "text"), "key", keys)
        shingles = materialize(held.join(keys, "key", "left_semi").select("key", "text").mapInArrow(sets, "key bigint, s array<bigint>"), "shingles")
        both = candidates.join(shingles.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(shingles.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
        overlap = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.where(overlap >= CHECK_SIMILARITY * (F.size("sa") + F.size("sb") - overlap)).select("a", "b"), "standing")

    links = standing(fingerprint_links(distinct).unionByName(equal).unionByName(stars))
    joined = components(links)
    rooted = shared.join(joined, shared["key"] == joined["node"], "left").select("s", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
    mixed = by_shingle(rooted, _mixed, "s bigint, key bigint, n int, pos int, root bigint")
    marked = mixed.join(ordered.select("key", *[F.col("fold")[i].alias(f"f{i}") for i in range(FOLD // 64)]), "key").select(*mixed.columns, *[f"f{i}" for i in range(FOLD // 64)])
    linked = components(links.unionByName(standing(by_shingle(marked, _apart, "a bigint, b bigint"))))
    return exact.join(linked, exact["first"] == linked["node"], "left").select("key", F.coalesce("root", "first").alias("root"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for near copies: of each group the row with the least id stays (see near_duplicate_texts).

    Null texts count as empty, and so as copies of each other. Rows with one id, or a null one, are told apart by their
    place in the order of id and text. All columns are kept, whatever their names; only rows that may go are shuffled. Very long texts
    are compared by all their shingles.
    """
    keyed, key = with_order_key(docs, id_col, text_col)
    roots = near_duplicate_texts(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")))
    gone = materialize(roots.where("key <> root").select("key"), "near-copies")
    some, rest = split_by_keys(keyed, key, gone)
    mark = free_name(keyed, "gone")
    kept = some.join(gone.select(F.col("key").alias(mark)), F.col(key) == F.col(mark), "left_anti")
    return kept.unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
