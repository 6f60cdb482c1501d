"""Toxicity by maximum-scoring segments.

A word's score is its log-odds between toxic and clean labelled documents, under a Dirichlet prior of ``prior`` documents in the
classes' shares, lowered by two and a half standard errors. Its units are its prefixes of three to eight letters and the word as a whole, and the
longest one that enough labelled documents have counts: an inflected form that was never seen weighs what its stem does, and one
seen often weighs by itself. Only weights above zero count; less ``drift``, most words score below zero.

A text is scanned once (Ruzzo and Tompa): the scan finds all disjoint segments whose score can't be raised by making them longer or
shorter. For words of the corpus in random order the best segment of n words has an extreme-value law,
P(S > x) = 1 - exp(-k n exp(-rate x)); the rate solves E[exp(rate * score)] = 1 over the words of all documents, k is counted on
clean labelled documents. Segments with less than ``significant`` expected by chance are the toxic passages. A document's score is a
logistic function of the standardized score of its best segment and of the excess of all its passages, fitted on the labelled rows.

Fits read at most ``max_rows`` labelled rows, those with the least hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import begin_task, free_name, materialize, text_batches

#: Labelled rows that a model is fitted on, and units that it keeps, at most.
MAX_ROWS, MAX_UNITS = 20_000, 100_000
PRIOR, DRIFT, SIGNIFICANT = 10.0, 0.5, 0.05
#: Standard errors that log-odds are lowered by, and documents that a unit needs.
ERRORS, ENOUGH = 2.5, 4
SHORTEST, LONGEST = 3, 8
#: Letters; a sign of a script without spaces is a word of its own.
WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W\d_぀-ヿ㐀-䶿一-鿿豈-﫿]+")
PIECE = re.compile(r"\S+")
#: Pieces that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 300_000, 48
#: Width of a bin of the scores of words.
BIN = 0.05
#: Bounds of the standardized score of the best segment; without any segment it is the lower one.
LEAST, MOST = -4.0, 40.0


def units(word: str) -> list[str]:
    """Prefixes from short to long, then the word with an end mark."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f"{word}$"]


def weigh(counts: dict[str, tuple[int, int]], base: float, prior: float = PRIOR, errors: float = ERRORS, enough: int = ENOUGH) -> dict[str, float]:
    """Weights by unit, from (toxic, clean) documents by unit, for units that don't weigh what the longest shorter unit told weighs.

    Units of fewer than ``enough`` documents weigh what shorter ones do. base: the share of toxic documents.
    """
    told, out = {"": 0.0}, {}
    of_toxic, of_clean = prior * base, prior * (1 - base)
    for unit in sorted(counts, key=lambda u: (len(u), u)):  # an end mark makes a word longer than its last prefix
        toxic, clean = counts[unit]
        if toxic + clean < enough:
            continue
        parent = unit[:-1]
        while parent and parent not in told:
            parent = parent[:-1]
        odds = math.log((toxic + of_toxic) / (clean + of_clean)) - math.log(of_toxic / of_clean)
        value = max(0.0, odds - errors * math.sqrt(1 / (toxic + of_toxic) + 1 / (clean + of_clean)))
        told[unit] = told[parent]
        if abs(value - told[parent]) > 0.1:
            out[unit] = told[unit] = value
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order, by one scan with a stack of candidates (Ruzzo and Tompa)."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # [first, last, sum before, sum up to its end, nearest candidate before it with a smaller sum before]
    for i in at.tolist():
        first, left, right = i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([first, i, left, right, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class Memo(dict):
    """What pieces weigh; one that is missing is weighed, and remembered if it isn't long."""

    def __init__(self, weigh: Callable[[str], float]):
        super().__init__()
        self.weigh = weigh

    def __missing__(self, piece: str) -> float:
        value = self.weigh(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = value
        return value


@dataclass
class ToxicModel:
    base: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    k: float = 1.0
    significant: float = SIGNIFICANT
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memo: Memo | None = field(default=None, repr=False, compare=False)

    def word(self, word: str) -> float:
        """The weight of a lower-case word: of the longest unit that is told."""
        for unit in reversed(units(word)):
            if unit in self.weights:
                return self.weights[unit]
        return 0.0

    def piece(self, piece: str) -> float:
        """Of what stands between spaces: that of its most toxic word."""
        return max(map(self.word, WORD.findall(piece)), default=0.0)

    def scores(self, text: str | None) -> np.ndarray:
        """One score for each piece of the whole text."""
        if self.memo is None:
            self.memo = Memo(self.piece)
        pieces = (text or "").lower().split()
        return np.fromiter(map(self.memo.__getitem__, pieces), dtype=float, count=len(pieces)) - self.drift

    def features(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], float, float]:
        """(words, segments, standardized score of the best one, excess of the significant ones)."""
        scores = self.scores(text)
        found = segments(scores)
        n = len(scores)
        if not found:
            return n, found, LEAST, 0.0
        floor = math.log(self.k * n)
        excess = [self.rate * s - floor for _, _, s in found]
        return n, found, float(np.clip(max(excess), LEAST, MOST)), float(np.log1p(sum(x for x in excess if x > -math.log(self.significant))))

    def score(self, best: float, excess: float) -> float:
        b, c, d = self.coefficients
        return 1 / (1 + math.exp(-max(-MOST, min(MOST, b + c * best + d * excess))))

    def passages(self, text: str, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """(start, end, score, expected by chance) of the significant segments, in characters of the text."""
        chance = [(a, b, s, self.k * n * math.exp(-min(700.0, self.rate * s))) for a, b, s in found]
        chance = [x for x in chance if x[3] < self.significant]
        if not chance:
            return []
        spans = [m.span() for m in PIECE.finditer(text)]
        return [(spans[a][0], spans[b][1], s, e) for a, b, s, e in chance]


def tail_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1; 1 where there is none (no value above zero, or the mean isn't below it)."""
    if not len(values) or values.max() <= 0 or (values * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    total = lambda r: float((shares * np.exp(np.minimum(r * values, 700))).sum())
    while total(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Intercept and weights by Newton steps with a small ridge on the weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.array([1e-6] + [1.0] * x.shape[1]) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -MOST, MOST)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(y, text) of the labelled documents that are learnt from, written to the shared folder."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    mine = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    one = mine.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return materialize(one.join(F.broadcast(picked), "id").select((F.col("y") > 0).cast("int").alias("y"), F.col("t.text").alias("text")), "toxic-sample")


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by unit and class, summed while a partition lasts."""
    begin_task("toxicity")
    sums: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(u[:SHORTEST], u, n * (y == 1), n * (y == 0)) for (u, y), n in sums.items()]
        sums.clear()
        return pd.DataFrame(rows, columns=["root", "unit", "toxic", "clean"])

    for batch in batches:
        for y, text in zip(batch["y"], batch["text"], strict=True):
            seen = {u for w in set(WORD.findall(text.lower())) if len(w) <= MEMO_CHARS for u in units(w)}
            sums.update((u, y) for u in seen)
            if len(sums) > 1_000_000:
                yield out()
    yield out()


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS,
    max_units: int = MAX_UNITS, prior: float = PRIOR, drift: float = DRIFT, significant: float = SIGNIFICANT,
) -> ToxicModel:
    """A model of labels on docs; the law of words is that of all documents.

    Null labels, null ids and labels of no document are left out; null texts are empty. Of documents with one id the one with the
    least hash of its text counts. No labelled rows: every text scores 0.5; one class only: its smoothed share. What comes to the driver is
    at most max_units units, a histogram and three numbers for each of max_rows rows.
    """
    sample = _labelled(docs, labels, id_col, text_col, label_col, max_rows)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < total:
        share = (toxic + 1) / (total + 2) if total else 0.5
        return ToxicModel(coefficients=(math.log(share / (1 - share)), 0.0, 0.0))
    base = toxic / total

    def weighed(rows: pd.DataFrame) -> pd.DataFrame:
        told = weigh(dict(zip(rows["unit"], zip(rows["toxic"], rows["clean"], strict=True), strict=True)), base, prior)
        return pd.DataFrame(list(told.items()), columns=["unit", "weight"])

    counts = sample.mapInPandas(_unit_counts, "root string, unit string, toxic long, clean long").groupBy("root", "unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    told = counts.groupBy("root").applyInPandas(weighed, "unit string, weight double")
    kept = told.orderBy(F.length("unit"), F.desc("weight"), "unit").limit(max_units).collect()
    model = ToxicModel(base, {r["unit"]: r["weight"] for r in kept}, drift, significant=significant)

    held = docs.sparkSession.sparkContext.broadcast(model)
    bins = text_batches(docs.select(F.coalesce(text_col, F.lit("")).alias("text"))).mapInPandas(_histogram(held), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    values, n = np.array([r["bin"] * BIN for r in bins]), np.array([float(r["n"]) for r in bins])
    model.rate = tail_rate(values, n / max(1.0, n.sum()))

    seen = sample.mapInPandas(_segment_scores(held, 1 / model.rate), "y int, n long, scores array<double>").collect()
    words = sum(r["n"] for r in seen if not r["y"])
    above = sum(len(r["scores"]) for r in seen if not r["y"])
    model.k = (above + 1) / (words + 1) * math.e
    rows = []
    for r in seen:
        excess = [model.rate * s - math.log(model.k * max(1, r["n"])) for s in r["scores"]]
        rows.append((r["y"], np.clip(max(excess, default=LEAST), LEAST, MOST), np.log1p(sum(x for x in excess if x > -math.log(significant)))))
    data = np.array(sorted(rows), dtype=float)
    model.coefficients = tuple(float(v) for v in logistic(data[:, 1:], data[:, 0]))
    return model


def _histogram(held):
    """How often each score comes, by bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("toxicity")
        model = held.value
        least = -math.ceil(model.drift / BIN)  # no weight is below zero
        sums = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                n = np.bincount(np.rint(model.scores(text) / BIN).astype(np.int64) - least, minlength=len(sums))
                n[: len(sums)] += sums
                sums = n
        bins = np.flatnonzero(sums)
        yield pd.DataFrame({"bin": bins + least, "n": sums[bins]})

    return run


def _segment_scores(held, least: float):
    """For each text its class, words and the scores of its segments above least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("toxicity")
        model = held.value
        for batch in batches:
            rows = []
            for y, text in zip(batch["y"], batch["text"], strict=True):
                scores = model.scores(text)
                rows.append((y, len(scores), [s for _, _, s in segments(scores) if s > least]))
            yield pd.DataFrame(rows, columns=["y", "n", "scores"])

    return run


def score_documents(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score, predicted (1 if score >= threshold) and passages (start, end, score, expected) to every row, without a shuffle.

    start and end are characters of the text, expected the number of such passages by chance. Null texts score as empty ones; texts of any
    length are scanned whole; repeated rows stay; an empty table gives no rows. Columns of these names, in any case, are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted", "passages")]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        begin_task("toxicity")
        mine = held.value
        for texts in it:
            rows = []
            for text in texts:
                n, found, best, excess = mine.features(text)
                spans = mine.passages(text, found, n) if found else []
                rows.append((mine.score(best, excess), [{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in spans]))
            yield pd.DataFrame(rows, columns=["score", "passages"])

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(run, "score double, passages array<struct<start:int,end:int,score:double,expected:double>>")
    found = free_name(docs, "found")
    s = F.col(found)
    rows = text_batches(docs).select(*kept, scored(F.col(text_col)).alias(found))
    return rows.select(*kept, s["score"].alias("score"), (s["score"] >= threshold).cast("int").alias("predicted"), s["passages"].alias("passages"))
