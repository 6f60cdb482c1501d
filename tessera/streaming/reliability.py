"""Circuit breaking, retries, load shedding and answer caching, in batch and as a stream."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.scratch import materialize

WINDOW_SECONDS, FAILURES, MIN_CALLS, SLOW_SHARE, SLOW_MS, OPEN_SECONDS, PROBES = 60, 5, 5, 0.5, 8000.0, 30, 3

# The rungs of the ladder with what each sets and saves.
LADDER = [
    ("lower_ef_search", {"ef_search": "40"}, 8),
    ("disable_rerank", {"rerank": "false"}, 220),
    ("shrink_context", {"top_k": "3", "token_budget": "1200"}, 400),
    ("disable_condensation", {"condense": "false"}, 250),
]


def trip_signals(events: DataFrame, *, key: str, ts: str = "ts", ok: str = "ok", latency: str = "latency_ms", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Adds events, failures, slow and trips over each key's preceding window."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    n, bad, slow = F.count("*").over(w), F.sum((~F.col(ok)).cast("long")).over(w), F.sum((F.col(latency) >= SLOW_MS).cast("long")).over(w)
    out = events.withColumn("events", n).withColumn("failures", bad).withColumn("slow", slow)
    return out.withColumn("trips", (F.col("failures") >= FAILURES) | ((F.col("events") >= MIN_CALLS) & (F.col("slow") / F.col("events") >= SLOW_SHARE)))


class Breaker:
    """The state machine over one key's calls in order: closed, open for OPEN_SECONDS, half open for PROBES good calls."""

    def __init__(self) -> None:
        self.state, self.opened, self.probes = "closed", 0.0, 0
        self.calls: list[tuple[float, bool, float]] = []

    def offer(self, at: float, ok: bool, ms: float) -> str:
        """Lets a call through or rejects it; the state that the call leaves, 'rejected' if it wasn't made."""
        if self.state == "open":
            if at - self.opened < OPEN_SECONDS:
                return "rejected"
            self.state, self.probes = "half_open", PROBES
        self.calls.append((at, ok, ms))
        if self.state == "half_open":
            if not ok:
                self.state, self.opened = "open", at
            else:
                self.probes -= 1
                if self.probes == 0:
                    self.state, self.calls = "closed", []
            return self.state
        self.calls = [c for c in self.calls if at - c[0] <= WINDOW_SECONDS]
        failures, slow = sum(not c[1] for c in self.calls), sum(c[2] >= SLOW_MS for c in self.calls)
        if failures >= FAILURES or (len(self.calls) >= MIN_CALLS and slow / len(self.calls) >= SLOW_SHARE):
            self.state, self.opened = "open", at
        return self.state


def breaker_states(events: DataFrame, *, key: str, ts: str = "ts", ok: str = "ok", latency: str = "latency_ms", order: str | None = None) -> DataFrame:
    """Adds state to each call. Sorted within partitions and walked call by call: a key's calls are never held together."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = events.columns
    placed = events.repartition(n, key).sortWithinPartitions(key, ts, *([order] if order else []))

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, breaker = object(), Breaker()
        for b in batches:
            names = b.schema.names
            states = []
            for k, at, good, ms in zip(*(b.column(names.index(c)).to_pylist() for c in (key, ts, ok, latency)), strict=True):
                if k != now:
                    now, breaker = k, Breaker()
                states.append(breaker.offer(at.timestamp(), bool(good), float(ms or 0.0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string())], names=[*names, "state"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return placed.mapInArrow(walk, f"{fields}, state string").select(*kept, "state")


def stream_signals(events: DataFrame, *, key: str, ts: str = "ts", ok: str = "ok", latency: str = "latency_ms", late: str = "2 minutes", slide: str = "10 seconds") -> DataFrame:
    """The windowed form for streams: sliding windows with a watermark, one trips flag per key and window."""
    held = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, f"{WINDOW_SECONDS} seconds", slide), F.col(key))
    counts = held.agg(F.count("*").alias("events"), F.sum((~F.col(ok)).cast("long")).alias("failures"), F.sum((F.col(latency) >= SLOW_MS).cast("long")).alias("slow"))
    return counts.withColumn("trips", (F.col("failures") >= FAILURES) | ((F.col("events") >= MIN_CALLS) & (F.col("slow") / F.col("events") >= SLOW_SHARE)))


def stream_states(events: DataFrame, *, key: str, ts: str = "ts", ok: str = "ok", latency: str = "latency_ms", order: str | None = None, late: str = "2 minutes") -> DataFrame:
    """breaker_states for a stream: each call with the state that it leaves, once the watermark has passed it.

    A key's state is the machine and the calls that the watermark hasn't passed; a timer of the key fires when it does, and the calls it has
    passed go through the machine in order of ts, then of the column order. Calls that come later than ``late`` are dropped by the stream.
    State of this kind needs spark.sql.streaming.stateStore.providerClass to name the RocksDB provider, and it survives restarts with the
    query's checkpoint. ts has to be a timestamp.
    """
    marked = events.withWatermark(ts, late)
    fields = T.StructType([*events.schema.fields, T.StructField("state", T.StringType())])
    names = [key, ts, ok, latency, order]
    return marked.groupBy(key).transformWithState(_BreakerProcessor(events.schema, names), fields, "append", "eventTime")


class _BreakerProcessor(StatefulProcessor):
    def __init__(self, schema: T.StructType, names: list[str | None]):
        self.schema, self.names = schema, [None if n is None else schema.fieldNames().index(n) for n in names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.machine = handle.getValueState("machine", "state string, opened double, probes int, at array<double>, ok array<boolean>, ms array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        new = [tuple(r) for r in rows]
        if new:
            self.waiting.appendList(new)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self._wait([tuple(r) for r in self.waiting.get()])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        _, ts, ok, latency, order = self.names
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if r[ts].timestamp() <= passed), key=lambda r: (r[ts], *([r[order]] if order is not None else [])))
        breaker = Breaker()
        if self.machine.exists():
            breaker.state, breaker.opened, breaker.probes, *calls = self.machine.get()
            breaker.calls = list(zip(*calls, strict=True))
        out = [Row(*self.schema.fieldNames(), "state")(*r, breaker.offer(r[ts].timestamp(), bool(r[ok]), float(r[latency] or 0.0))) for r in ready]
        self.machine.update((breaker.state, float(breaker.opened), breaker.probes, *([c[i] for c in breaker.calls] for i in range(3))))
        left = [r for r in held if r[ts].timestamp() > passed]
        if left:
            self.waiting.put(left)
            self._wait(left)
        else:
            self.waiting.clear()
        return iter(out)

    def _wait(self, rows: list[tuple]) -> None:
        """Until the watermark has passed the first of rows."""
        first = min(r[self.names[1]].timestamp() for r in rows)
        self.handle.registerTimer(int(first * 1000) + 1)

    def close(self) -> None:
        pass


def with_retries(call: Callable[[], object], tries: int = 3, base: float = 0.5, cap: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """A call inside a client, repeated after growing pauses; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if i == tries - 1:
                raise
            sleep(min(base * 2**i, cap) + random.random() * base)
    return None


def degrade(config: Column | str, pressure: Column | str) -> Column:
    """A map of settings under the first rungs of the ladder."""
    out, p = (F.col(config) if isinstance(config, str) else config), (F.col(pressure) if isinstance(pressure, str) else pressure)
    for i, (_, sets, _saves) in enumerate(LADDER):
        rung, names = F.create_map(*[F.lit(x) for pair in sets.items() for x in pair]), list(sets)
        out = F.when(p > i, F.map_concat(F.map_filter(out, lambda k, _: ~k.isin(names)), rung)).otherwise(out)  # noqa: B023
    return out


#: Question vectors that are broadcast at once, rows of entries looked at at once, and numbers of a vector that are looked at first.
CACHE_BLOCK, CACHE_TILE, CACHE_HEAD = 4096, 512, 16


class FirstHits:
    """For a block of questions the first entry at the threshold among the tiles that it is shown.

    A vector's first numbers bound its cosine with another: the rest of both adds at most the product of the rests' norms. Only pairs
    that the bound lets through are compared whole, and none with an entry behind a hit that the question has. Norms of rests are those
    after a rotation by the questions' own principal axes, so that the first numbers tell the most.
    """

    def __init__(self, vectors: list, threshold: float):
        q = np.array(vectors, dtype=np.float64)
        self.axes = np.linalg.svd(q, full_matrices=True)[2].T if len(q) else np.eye(0)
        self.q, self.head, self.rest = self._rotated(q)
        self.threshold = threshold
        self.best: np.ndarray = np.full(len(q), None, dtype=object)
        self.compared = self.pairs = 0

    def _rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.linalg.norm(v, axis=1)
        v = (v / np.where(n == 0, 1, n)[:, None]) @ self.axes
        head = v[:, :CACHE_HEAD]
        return v, head, np.sqrt(np.maximum(0, (v**2).sum(axis=1) - (head**2).sum(axis=1)))

    def see(self, of: np.ndarray, vectors: np.ndarray, seq: np.ndarray, own: np.ndarray | None = None) -> None:
        """Entries in ascending order of seq, for the questions of; own: by question the entry that doesn't count."""
        open_ = np.array([self.best[i] is None or self.best[i] > seq[0] for i in of])
        of = of[open_]
        if not len(of):
            return
        e, head, rest = self._rotated(vectors)
        self.pairs += len(of) * len(e)
        i, j = np.nonzero(self.head[of] @ head.T + np.outer(self.rest[of], rest) >= self.threshold - 1e-6)
        if own is not None:
            other = np.array([own[a] != seq[b] for a, b in zip(of[i], j, strict=True)], dtype=bool)
            i, j = i[other], j[other]
        self.compared += len(i)
        hit = np.round((self.q[of[i]] * e[j]).sum(axis=1), 6) >= self.threshold
        for a, b in zip(of[i[hit]].tolist(), j[hit].tolist(), strict=True):
            if self.best[a] is None or seq[b] < self.best[a]:
                self.best[a] = seq[b]


def cached_answers(queries: DataFrame, entries: DataFrame, threshold: float = 0.93, own: str | None = None) -> DataFrame:
    """(query_id, seq): the first entry(tenant_id, corpus_version, seq, vector) at the threshold for each query; misses have none.

    own: a column of queries with the entry that is the query itself and doesn't count. Questions go through in blocks that are broadcast;
    entries aren't shuffled, a task keeps the first hit of each question, and only pairs of one tenant and version meet whose first numbers
    let them reach the threshold (see FirstHits). Vectors of norm 0 have cosine 0; null vectors, tenants and versions hit nothing.
    """
    spark = entries.sparkSession
    kinds = queries.schema["query_id"].dataType.simpleString(), entries.schema["seq"].dataType.simpleString()
    named = lambda df, *more: df.where("tenant_id is not null and corpus_version is not null").select(F.concat_ws("\0", "tenant_id", "corpus_version").alias("key"), *more)
    asked = named(queries.where(F.col("qvec").isNotNull()), "query_id", "qvec", *([F.col(own).alias("own")] if own else []))
    rows = named(entries.where(F.col("vector").isNotNull() & F.col("seq").isNotNull()), "seq", "vector")
    found, block = None, []

    def hits(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in block])
        near = rows.mapInArrow(_first_hits(sent, threshold, own is not None), f"place int, seq {kinds[1]}")
        first = near.groupBy("place").agg(F.min("seq").alias("seq"))
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"place int, query_id {kinds[0]}")
        return first.join(F.broadcast(names), "place").select("query_id", "seq")

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == CACHE_BLOCK:
            some = materialize(hits(block), "cache-hits")
            found, block = some if found is None else found.unionByName(some), []
    if block or found is None:
        found = hits(block) if found is None else found.unionByName(hits(block))
    return found.groupBy("query_id").agg(F.min("seq").alias("seq"))


def _first_hits(sent, threshold: float, has_own: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = sent.value
        of_key: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            of_key.setdefault(r[0], []).append(i)
        held = {key: (FirstHits([block[i][2] for i in mine], threshold), mine, np.array([block[i][3] for i in mine], dtype=object) if has_own else None) for key, mine in of_key.items()}
        kind = None
        for b in batches:
            kind = b.schema.field(1).type
            tile = pa.Table.from_batches([b]).sort_by([("key", "ascending"), ("seq", "ascending")])
            keys = np.array(tile["key"].to_pylist(), dtype=object)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high or keys[low] not in held:
                    continue
                hits, mine, own = held[keys[low]]
                for at in range(low, high, CACHE_TILE):
                    part = tile.slice(at, min(CACHE_TILE, high - at))
                    hits.see(np.arange(len(mine)), np.array(part["vector"].to_pylist(), dtype=np.float64), np.array(part["seq"].to_pylist(), dtype=object), own)
        out = [(mine[i], hits.best[i]) for hits, mine, _ in held.values() for i in range(len(mine)) if hits.best[i] is not None]
        if out:
            places, seqs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(seqs, kind)], names=["place", "seq"])

    return run


class SemanticCache:
    """The cache of one process: first in, first out, an entry serves its own tenant and corpus version only."""

    def __init__(self, threshold: float = 0.93, max_entries: int = 1000):
        self.threshold, self.max_entries = threshold, max_entries
        self.entries: list[tuple] = []
        self.hits = self.asked = 0

    def get(self, vector: list[float], tenant: str, version: str) -> object | None:
        self.asked += 1
        v = np.asarray(vector, dtype=float)
        for t, c, u, answer in self.entries:
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if (t, c) == (tenant, version) and size and float(u @ v) / size >= self.threshold:
                self.hits += 1
                return answer
        return None

    def put(self, vector: list[float], answer: object, tenant: str, version: str) -> None:
        self.entries.append((tenant, version, np.asarray(vector, dtype=float), answer))
        del self.entries[: -self.max_entries]

    @property
    def hit_rate(self) -> float:
        return self.hits / self.asked if self.asked else 0.0


def hit_rate(lookups: DataFrame) -> DataFrame:
    return lookups.agg(F.avg(F.col("seq").isNotNull().cast("double")).alias("hit_rate"))


def fit_context(chunks: pd.Series | list[str], budget: int, max_tokens: int = 4096) -> list[str]:
    """Whole blocks that fit into a budget, in order, misfits left out: the list form of context.pack_budget."""
    out, spent, most = [], 0, min(budget, max_tokens)
    for c in chunks:
        cost = max(1, len(c) // 4)
        if spent + cost <= most:
            out.append(c)
            spent += cost
    return out
