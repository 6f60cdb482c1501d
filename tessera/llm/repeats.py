"""Where equal windows meet: routing of repeated passages without comparing documents with each other.

A window is ``length`` units in a row (bytes or words). Its minimizer is the k-mer with the least hash in it, the
leftmost of equal ones, so equal windows have the same minimizer. A run is a maximal row of windows of one
document whose minimizers are equal; its fragment are the units that those windows cover. Words or characters that go
on and on are one run. Two hashes name a run: h, of the minimizer, and f, of the fragment. A window can only have
an equal one in a run with the same h, so nearly all of a corpus ends where an h has one run only. What is left is
compared unit by unit by the operator that asks (see suffix_dedup and automaton_dedup), group of h by group:

- of each different fragment the first run is compared, and with ``compare_copies`` the first copy (of another document, where
  repeats within one don't count);
- further copies are members of their fragment, which stands before them, and are repeated whole: they have its two hashes.

Members within a batch are settled before the shuffle and dealt out by themselves, so a passage that stands in a
third of all documents brings one or two runs of a batch together. A group with more than ``max_units`` units is split by further
units: windows are told apart by where their minimizer stands in them, in intervals, and by the units that all
windows of an interval have around it. Equal windows stay together; after two such splits a group is one window's copies. So
every group that is compared is bounded, and all are compared in the same way.

Documents of fewer than ``length`` units have no window. Very long texts are cut into overlapping parts of BATCH_UNITS.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import begin_task, materialize, split_by_keys, text_batches

#: Units that are hashed at once, so that the arrays stay in a core's cache (positions take 24 bits beside the hash).
BATCH_UNITS = 1 << 16
#: Units whose runs are looked through together for copies.
GATHER_UNITS = 1 << 22
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_POSITION = np.uint64((1 << 24) - 1)

RUNS_SCHEMA = "h long, f long, key long, start int, windows int, loops boolean, settled boolean"
FOUND_SCHEMA = "h long, f long, key long, start int, windows int, kind int"
#: Kinds of found rows: a member of a fragment that two runs before it have; a run to compare with others of its h; one of a too large group.
MEMBER, COMPARE, SPLIT = 0, 1, 2
#: Rows of one h that are looked at together; of more than that all are split.
HOLD = 1 << 19


@dataclass(frozen=True)
class Windows:
    """length: units of a window; k: units of a k-mer (a power of two); own_document: repeats within a document count;
    max_units: units of one group's fragments that are compared in one task, larger groups are split; units: of a text, of dtype;
    compare_copies: a fragment's first copy is compared too, so that the units decide that it is one."""

    length: int
    k: int
    own_document: bool
    max_units: int
    units: Callable[[str], np.ndarray]
    dtype: str
    compare_copies: bool = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers_held[0]) < n:
        n = max(n, 2 * BATCH_UNITS)
        for i, base in enumerate((int(_A) | 1, pow(int(_A) | 1, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers_held[i] = np.multiply.accumulate(p)
    return _powers_held[0][:n], _powers_held[1][:n]


_powers_held = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)]


def unit_hashes(units: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers and of all windows of an array of units."""
    h, size, kmers = _mix(units.astype(np.uint64) * _A + _B), 1, None
    while True:
        if size == w.k:
            kmers = h
        if 2 * size > w.length:
            break
        h = _mix(h[:-size] * _A + h[size:])
        size *= 2
    rest = w.length - size
    return kmers, _mix(h[: len(h) - rest] * _B + h[rest:])


def runs(units: np.ndarray, doc: np.ndarray, w: Windows, width: int = 0, of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(h, f, start, windows, loops) of the runs in concatenated documents; doc: the document of each unit; start: among units.

    loops: the minimizer comes more than once in the run. With a width documents are fragments of runs with the hashes ``of``: their
    windows are split by the minimizer's place in them, in intervals of that width, and h is of the units that an interval's windows share.
    """
    n = len(units) - w.length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=d) for d in (np.uint64, np.uint64, np.int64, np.int64, bool))
    kmers, windows = unit_hashes(units, w)
    least = (kmers & ~_POSITION) | np.arange(len(kmers), dtype=np.uint64)
    span, size = w.length - w.k + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = span - size
    least = np.minimum(least[: len(least) - rest], least[rest:])[:n] & _POSITION
    valid = doc[:n] == doc[w.length - 1 :]
    least = least.astype(np.int64)
    interval = (least - np.arange(n)) // width if width else None
    value = kmers[least]
    told = least * (span + 1) + interval if width else value
    new = np.ones(n, dtype=bool)
    new[1:] = (told[1:] != told[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:n] != doc[: n - 1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    keep = valid[starts]
    starts, stops = starts[keep], stops[keep]
    up, down = _powers(len(units) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(units.astype(np.uint64) * _B + _A) * up[: len(units)])])
    between = lambda a, b: _mix((sums[b] - sums[a]) * down[a])
    f = _mix(between(starts, stops + w.length - 1) + windows[starts] * _A + windows[stops - 1] * _B + (stops - starts).astype(np.uint64))
    if not width:
        return value[starts], f, starts, stops - starts, least[starts] != least[stops - 1]
    low, at = interval[starts] * width, least[starts]
    high = np.minimum(low + width, span) - 1
    h = _mix(between(at - low, at - high + w.length) + of[doc[starts]] * _A + low.astype(np.uint64) * _B + np.uint64(width))
    return h, f, starts, stops - starts, np.zeros(len(starts), dtype=bool)


def batches_of(texts: Iterator[tuple[int, str | None]], w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, offsets, units, doc) of documents put together to about BATCH_UNITS; very long ones in overlapping parts.

    keys and offsets by document part: offset is the place in its document at which a part begins.
    """
    keys, offsets, parts, held = [], [], [], 0

    def whole():
        return np.array(keys), np.array(offsets), np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    for key, text in texts:
        units = w.units(text) if text else np.zeros(0, dtype=np.uint8)
        for at in range(0, max(1, len(units) - w.length + 1), BATCH_UNITS):
            part = units[at : at + BATCH_UNITS + w.length - 1]
            if len(part) < w.length:
                continue
            if held and held + len(part) > 2 * BATCH_UNITS:
                yield whole()
                keys, offsets, parts, held = [], [], [], 0
            keys.append(key)
            offsets.append(at)
            parts.append(part)
            held += len(part)
            if held >= BATCH_UNITS:
                yield whole()
                keys, offsets, parts, held = [], [], [], 0
    if parts:
        yield whole()


def copies_and_members(key: np.ndarray, new: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(copies, members) of fragments' runs in order of key and place; new: where a fragment begins.

    Where repeats within a document don't count, copies are the runs in other documents than the first one's. Members are the copies
    that aren't compared.
    """
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    copy = ~new if w.own_document else key != key[lead]
    member = copy.copy()
    if w.compare_copies:
        at = np.flatnonzero(copy)
        member[at[np.unique(lead[at], return_index=True)[1]]] = False
    return copy, member


def joined_members(key: np.ndarray, place: np.ndarray, count: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their windows): rows that aren't settled, and of settled ones that follow each other in a document the first, with the windows of all.

    Of a settled run only what it covers is asked for, so the copies of a passage are one row however many runs it has.
    """
    at = np.flatnonzero(settled)
    at = at[np.lexsort((place[at], key[at]))]
    if not len(at):
        return np.arange(len(key)), count
    first = np.ones(len(at), dtype=bool)
    first[1:] = (key[at[1:]] != key[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + count[at[:-1]])
    starts = np.flatnonzero(first)
    rest = np.flatnonzero(~settled)
    return np.concatenate([rest, at[starts]]), np.concatenate([count[rest], np.add.reduceat(count[at], starts)])


def settled_batch(gathered: list[tuple], w: Windows, units: list[bytes] | None = None):
    """A record batch of RUNS_SCHEMA (and units) of gathered (h, f, key, place, windows, loops): members are settled."""
    import pyarrow as pa

    h, f, key, place, count, loops = (np.concatenate(c) for c in zip(*gathered, strict=True))
    if (key[1:] >= key[:-1]).all() and units is None:  # rows are in order of key and place already
        order = np.argsort(h ^ (f * _A), kind="stable")
    else:
        order = np.lexsort((place, key, f, h))
    h, f, key, place, count, loops = (c[order] for c in (h, f, key, place, count, loops))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
    settled = copies_and_members(key, new, w)[1]
    rows, count = joined_members(key, place, count, settled)
    h, f, key, place, loops, settled, order = (c[rows] for c in (h, f, key, place, loops, settled, order))
    columns = [pa.array(c) for c in (h.view(np.int64), f.view(np.int64), key, place.astype(np.int32), count.astype(np.int32), loops, settled)]
    names = ["h", "f", "key", "start", "windows", "loops", "settled"]
    if units is not None:
        columns.append(pa.array([b"" if s else units[i] for i, s in zip(order.tolist(), settled.tolist(), strict=True)], pa.binary()))
        names.append("units")
    return pa.RecordBatch.from_arrays(columns, names=names)


def document_runs(docs: DataFrame, w: Windows) -> DataFrame:
    """RUNS_SCHEMA for docs(key, text): runs, members within a batch settled already."""

    def find(batches: Iterator) -> Iterator:
        begin_task("repeats")
        texts = ((k, t.as_py()) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        gathered, size = [], 0
        for keys, offsets, units, doc in batches_of(texts, w):
            h, f, start, count, loops = runs(units, doc, w)
            if not len(h):
                continue
            part = doc[start]
            place = start - np.searchsorted(doc, np.arange(len(keys)))[part] + offsets[part]
            gathered.append((h, f, keys[part], place, count, loops))
            size += len(units)
            if size >= GATHER_UNITS:
                yield settled_batch(gathered, w)
                gathered, size = [], 0
        if gathered:
            yield settled_batch(gathered, w)

    return text_batches(docs).select("key", "text").mapInArrow(find, RUNS_SCHEMA)


def split_runs(pieces: DataFrame, w: Windows, width: int) -> DataFrame:
    """RUNS_SCHEMA and units for pieces(h, key, start, units): the runs of intervals of that width of the minimizer's place."""

    def find(batches: Iterator) -> Iterator:
        begin_task("repeats")
        held, size = [], 0

        def split():
            units = np.concatenate([p[3] for p in held])
            sizes = np.array([len(p[3]) for p in held])
            doc = np.repeat(np.arange(len(held)), sizes)
            of, keys, starts = (np.array([p[i] for p in held], dtype=np.int64) for i in range(3))
            h, f, start, count, loops = runs(units, doc, w, width, of.view(np.uint64))
            part = doc[start]
            place = start - (np.cumsum(sizes) - sizes)[part] + starts[part]
            cut = [units[a : a + c + w.length - 1].tobytes() for a, c in zip(start.tolist(), count.tolist(), strict=True)]
            return settled_batch([(h, f, keys[part], place, count, loops)], w, cut)

        for b in batches:
            for h, key, start, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                units = np.frombuffer(raw, dtype=w.dtype)
                if held and size + len(units) > BATCH_UNITS:
                    yield split()
                    held, size = [], 0
                held.append((h, key, start, units))
                size += len(units)
        if held:
            yield split()

    return pieces.select("h", "key", "start", "units").mapInArrow(find, f"{RUNS_SCHEMA}, units binary")


def found_runs(every: DataFrame, w: Windows, last: bool = False) -> DataFrame:
    """FOUND_SCHEMA (and units, if every has them) for RUNS_SCHEMA: runs that are compared, have to be split or are members.

    last: groups are one window's copies and aren't split any more.
    """
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [c for c in every.columns if c not in ("loops", "settled")]

    def group(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin_task("repeats")

        def rows(t, kind: np.ndarray, keep: np.ndarray | None = None):
            t = t.select(out).append_column("kind", pa.array(kind.astype(np.int32)))
            return (t if keep is None else t.filter(pa.array(keep))).to_batches()

        def decide(parts: list, carried: int, hot: bool):
            """Whole groups of h, or a part of one hot group; the first rows were carried over from the part before."""
            t = pa.Table.from_batches(parts).combine_chunks()
            h, f, key, windows, loops = (t.column(x).to_numpy() for x in ("h", "f", "key", "windows", "loops"))
            new_h, new_f = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
            new_h[1:] = h[1:] != h[:-1]
            new_f[1:] = new_h[1:] | (f[1:] != f[:-1])
            of_h, of_f = np.cumsum(new_h) - 1, np.cumsum(new_f) - 1
            copy, member = copies_and_members(key, new_f, w)
            compared = (np.bincount(of_h, weights=new_f)[of_h] > 1) | (np.bincount(of_f, weights=copy & ~member)[of_f] > 0) | (loops & w.own_document) | hot
            units = np.bincount(of_h, weights=(compared & ~member) * (windows + (w.length - 1)))[of_h]
            kind = np.where(member, MEMBER, np.where((units > w.max_units) | hot, COMPARE if last else SPLIT, COMPARE))
            if last:  # a window's further places in the first document aren't repeats of another one
                compared &= new_f | copy
            keep = member | compared
            keep[:carried] = False
            ends = np.flatnonzero(of_f == of_f[-1])
            first_copy = ends[copy[ends]][:1]
            return rows(t, kind, keep), t.take(np.concatenate([ends[:1], first_copy])).to_batches()

        held, size, carried, hot, at = [], 0, 0, False, None
        for b in batches:
            settled = b.column(b.schema.get_field_index("settled")).to_numpy(zero_copy_only=False)
            cut = len(settled) - int(settled.sum())
            if cut < b.num_rows:
                yield from rows(pa.Table.from_batches([b.slice(cut)]), np.full(b.num_rows - cut, MEMBER))
            b = b.slice(0, cut)
            h = b.column(0).to_numpy()
            if held and len(h):
                same = int(np.searchsorted(h, at, "right"))
                held.append(b.slice(0, same))
                size += same
                b, h = b.slice(same), h[same:]
                if len(h):
                    yield from decide(held, carried, hot)[0]
                    held, size, carried, hot = [], 0, 0, False
                elif size > HOLD:
                    made, held = decide(held, carried, True)
                    yield from made
                    size = carried = sum(x.num_rows for x in held)
                    hot = True
            if len(h):
                at = h[-1]
                cut = int(np.searchsorted(h, at))
                if cut:
                    yield from decide([b.slice(0, cut)], 0, False)[0]
                held, size = [b.slice(cut)], len(h) - cut
        if held:
            yield from decide(held, carried, hot)[0]

    dealt = F.when(F.col("settled"), F.xxhash64("key", "start")).otherwise(F.col("h"))
    placed = every.repartition(n, dealt).sortWithinPartitions("settled", "h", "f", "key", "start")
    return materialize(placed.mapInArrow(group, FOUND_SCHEMA.replace(", kind", ", units binary, kind") if "units" in out else FOUND_SCHEMA), "runs")


FRAGMENTS_SCHEMA = "h long, key long, start int, windows int, kind int, units binary"


def fragments(docs: DataFrame, found: DataFrame, w: Windows) -> DataFrame:
    """The units of the found runs that aren't members, as bytes of the unit array: FRAGMENTS_SCHEMA, written to the shared folder."""

    def cut(batches: Iterator) -> Iterator:
        begin_task("repeats")
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            size = 0
            for key, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                units = w.units(text.as_py())
                for run in wanted.as_py():
                    piece = units[run["start"] : run["start"] + run["windows"] + w.length - 1].tobytes()
                    for column, value in zip(rows, (run["h"], key, run["start"], run["windows"], run["kind"], piece), strict=True):
                        column.append(value)
                    size += len(piece)
                if size > 1 << 23:
                    yield _record(rows)
                    rows, size = [[] for _ in range(6)], 0
            if rows[0]:
                yield _record(rows)

    def _record(rows: list[list]):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["h", "key", "start", "windows", "kind", "units"])

    wanted = found.where(F.col("kind") != MEMBER).groupBy("key").agg(F.collect_list(F.struct("h", "start", "windows", "kind")).alias("wanted"))
    some, _ = split_by_keys(docs, "key", wanted)
    return materialize(some.join(wanted, "key").select("key", "text", "wanted").mapInArrow(cut, FRAGMENTS_SCHEMA), "fragments")


SPANS_SCHEMA = "key long, start int, length int"


def repeated_spans(docs: DataFrame, w: Windows, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SPANS_SCHEMA for docs(key, text): what is covered by windows that also start earlier; spans may overlap.

    compare makes spans of fragments (FRAGMENTS_SCHEMA) that come sorted by h within partitions.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found_runs(document_runs(docs, w), w)
    pieces = fragments(docs, found, w)
    levels, names = [(found, pieces)], pieces.columns
    places = w.length - w.k + 1
    for width in (math.isqrt(places - 1) + 1, 1):
        rest = levels[-1][1].where(F.col("kind") == SPLIT)
        if rest.isEmpty():
            break
        split = found_runs(split_runs(rest, w, width), w, last=width == 1)
        levels.append((split, split))
    whole = [f.where(F.col("kind") == MEMBER).select("key", "start", (F.col("windows") + (w.length - 1)).alias("length")) for f, _ in levels]
    compared = [p.where(F.col("kind") == COMPARE).select(*names) for _, p in levels]
    together = reduce(DataFrame.unionByName, compared).repartition(n, "h").sortWithinPartitions("h")
    return materialize(reduce(DataFrame.unionByName, [*whole, compare(together)]), "spans")


def with_spans(docs: DataFrame, key: str, spans: DataFrame, out: str) -> DataFrame:
    """docs with their merged spans in column out, null where there are none; documents without any aren't shuffled."""
    merged = document_spans(spans).select(F.col("key").alias(f"{key}_of_spans"), F.col("spans").alias(out))
    some, rest = split_by_keys(docs, key, spans.select("key"))
    joined = some.join(merged, some[key] == merged[f"{key}_of_spans"], "left").drop(f"{key}_of_spans")
    return joined.unionByName(rest.withColumn(out, F.lit(None).cast("array<struct<start:int,stop:int>>")))


def document_spans(spans: DataFrame) -> DataFrame:
    """(key, spans array<struct<start,stop>>): each document's spans merged, in order.

    A document's spans are as bounded as its text. They are merged per task first, as rows of one run come together.
    """
    w = Window.partitionBy("key").orderBy("start", "stop")
    reach = spans.select("key", "start", (F.col("start") + F.col("length")).alias("stop"))
    new = reach.withColumn("before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    group = new.withColumn("g", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w))
    merged = group.groupBy("key", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
