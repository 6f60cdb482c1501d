"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Small trees are grown over text statistics on bootstrap samples of the labelled rows. Every path from a root
to a node is a rule, a conjunction of threshold conditions; a logistic model with a lasso penalty weighs the
rules, most of them with zero; what is left is a sum of CASE expressions over the statistics, evaluated in the
JVM on every text.

Only the fit runs on the driver, on at most ``max_rows`` labelled rows: those with the least hash of their id, so
the choice doesn't depend on the order of rows or the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free_name

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 20_000
WHITE = "[\\x20\\x09-\\x0D]+"

STATISTICS = ("chars", "words", "mean_word", "distinct_words", "letters", "upper", "digits", "symbols", "exclaims", "bars", "lines", "distinct_lines")


def with_statistics(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """Adds a struct of the statistics of a whole text; null counts as empty, and no ratio divides by zero."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    one = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    lines = F.split(t, "\n")
    raw = df.withColumn(out, F.struct(
        F.length(t).cast("double").alias("chars"), words.alias("w"), lines.alias("l"), kept("[^\\p{L}]+").alias("letters"),
        kept("[^\\p{Lu}]+").alias("upper"), kept("[^\\p{N}]+").alias("digits"), kept("[\\p{L}\\p{N}\\s.,;:!?'\"()|-]+").alias("symbols"),
        one("!").cast("double").alias("exclaims"), one("|").cast("double").alias("bars"),
    ))
    s = F.col(out)
    chars, n = F.greatest(s["chars"], F.lit(1.0)), F.greatest(F.size(s["w"]), F.lit(1)).cast("double")
    return raw.withColumn(out, F.struct(
        s["chars"].alias("chars"), F.size(s["w"]).cast("double").alias("words"), (s["chars"] / n).alias("mean_word"),
        (F.size(F.array_distinct(s["w"])) / n).alias("distinct_words"), (s["letters"] / chars).alias("letters"),
        (s["upper"] / F.greatest(s["letters"], F.lit(1.0))).alias("upper"), (s["digits"] / chars).alias("digits"),
        (s["symbols"] / chars).alias("symbols"), (s["exclaims"] / n).alias("exclaims"), (s["bars"] / n).alias("bars"),
        F.size(s["l"]).cast("double").alias("lines"), (F.size(F.array_distinct(s["l"])) / F.size(s["l"])).alias("distinct_lines"),
    ))


Condition = tuple[int, bool, float]  # statistic, above, threshold


def grow(x: np.ndarray, y: np.ndarray, depth: int, min_leaf: int, rng: np.random.Generator, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The paths to every node of a regression tree (Gini) over a random half of the statistics at each split."""
    rules = [path] if path else []
    if depth == 0 or len(y) < 2 * min_leaf or y.min() == y.max():
        return rules
    best = (1e-7 * len(y), -1, 0.0)
    p = y.mean()
    whole = len(y) * p * (1 - p)
    for j in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero((v[1:] > v[:-1]) & (np.arange(1, len(v)) >= min_leaf) & (np.arange(1, len(v)) <= len(v) - min_leaf))
        if not len(at):
            continue
        n_left, left = at + 1.0, ones[at]
        n_right, right = len(v) - n_left, ones[-1] - left
        gain = whole - left * (1 - left / n_left) - right * (1 - right / n_right)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], int(j), float((v[at[i]] + v[at[i] + 1]) / 2))
    _, j, cut = best
    if j < 0:
        return rules
    for above in (False, True):
        side = (x[:, j] > cut) == above
        rules += grow(x[side], y[side], depth - 1, min_leaf, rng, (*path, (j, above, cut)))
    return rules


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept has no penalty."""
    n, m = r.shape
    lipschitz = 0.25 * (np.linalg.norm(np.hstack([np.ones((n, 1)), r]), 2) ** 2) / n + 1e-9
    w, b = np.zeros(m), 0.0
    zw, zb, t = w, b, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ zw + zb))) - y) / n
        step = zw - (r.T @ g) / lipschitz
        new_w = np.sign(step) * np.maximum(np.abs(step) - penalty / lipschitz, 0)
        new_b = zb - g.sum() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return float(b), w


@dataclass
class RuleModel:
    """A fitted model: score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for j, above, cut in rule:
                value = F.col(stats)[STATISTICS[j]]
                holds = holds & (value > cut if above else value <= cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * covers(rule, x)
        return 1 / (1 + np.exp(-total))

    def describe(self) -> list[str]:
        text = lambda rule: " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {cut:.6g}" for j, above, cut in rule)
        return [f"{weight:+.3f} if {text(rule)}" for rule, weight in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit_arrays(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, penalty: float = 1e-4, tree_rows: int = 4000, max_rules: int = 250, seed: int = 7) -> RuleModel:
    """Fit on a matrix of statistics. No rows: score 0.5; one class only: its smoothed share.

    Each tree is grown on a bootstrap sample of tree_rows rows at most; the max_rules rules that tell most go to the lasso.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    found: dict[bytes, tuple[Condition, ...]] = {}
    for _ in range(trees):
        pick = rng.integers(0, len(y), min(len(y), tree_rows))
        for rule in grow(x[pick], y[pick], depth, max(5, len(pick) // 200), rng):
            mask = covers(rule, x)
            if 0 < mask.sum() < len(y):
                found.setdefault(np.packbits(mask).tobytes(), rule)  # rules that hold for the same rows are one
    rules = list(found.values())
    gain = [abs(y[covers(r, x)].mean() - y.mean()) * np.sqrt(covers(r, x).sum()) for r in rules]
    rules = [rules[i] for i in np.argsort(gain)[::-1][:max_rules]]
    r = np.stack([covers(rule, x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    b, w = lasso_logistic(r, y, penalty)
    return RuleModel(b, [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-3])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, **options) -> RuleModel:
    """Fit on the labelled rows with the least hash of their id, max_rows at most (a bounded collect).

    Null labels, labels of no document and documents without a label are left out. Of documents with one id the one with the least
    hash of its text counts, as often as there are labels of that id.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    stats = with_statistics(mine, "t").select("id", F.struct(F.xxhash64("t").alias("h"), *[F.col("stats")[s].alias(s) for s in STATISTICS]).alias("s"))
    rows = stats.groupBy("id").agg(F.min("s").alias("s")).join(F.broadcast(picked), "id").select("y", *[F.col("s")[s].alias(s) for s in STATISTICS])
    data = np.array([tuple(r) for r in rows.collect()], dtype=float).reshape(-1, len(STATISTICS) + 1)
    data = data[np.lexsort(data.T[::-1])]
    return fit_arrays(data[:, 1:], data[:, 0], **options)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, never learnt from: crc32 of the id as text, mod 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted (1 if score >= threshold) to every row; columns of these names, in any case, are replaced.

    Null texts score as empty ones; texts of any length are scored whole. Repeated rows stay; an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    stats = free_name(docs, "stats")
    scored = with_statistics(docs, text_col, stats).select(*kept, model.column(stats).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
