"""Quality by a sparse rule ensemble over text statistics.

Statistics are Spark columns over the whole text. Shallow boosted trees are
grown on the statistics of a bounded sample of labelled texts; every path from
the root to a node becomes a conjunctive rule ("symbol share > a and words <=
b"). A lasso logistic regression weighs the rules, which leaves few, and those
are compiled back into Spark column expressions: scoring is one projection
without Python.

The model is fitted on at most ``fit_rows`` labelled texts, those with the
smallest hash of their id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 6000
TREES, DEPTH, BINS = 30, 3, 32
WORD = r"[^\x20\x09-\x0D]+"

Condition = tuple[str, bool, float]  # (statistic, above, threshold): above means >, else <=


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, doubles, never null; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("double")  # noqa: E731  characters outside the class
    chars = F.length(whole).cast("double")
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words).cast("double")
    solid = count(r"[\x20\x09-\x0D]+")
    letters = count(r"[^\p{L}]+")
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    return {
        "words": F.log1p(n_words),
        "word_length": share(solid, n_words),
        "letter_share": share(letters, solid),
        "upper_share": share(count(r"[^\p{Lu}]+"), letters),
        "digit_share": share(count(r"[^0-9]+"), solid),
        "symbol_share": share(count(r"[\p{L}\p{N}\s.,;:'\"?!()-]+"), solid),
        "stop_share": share(count(r"[^.,;:?!]+"), n_words),
        "distinct_share": share(F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).cast("double"), n_words),
        "line_length": share(chars, count(r"[^\n]+") + 1),
    }


STATISTICS = (
    "words", "word_length", "letter_share", "upper_share", "digit_share", "symbol_share", "stop_share", "distinct_share", "line_length",
)


@dataclass
class Ensemble:
    """Rules (conjunctions of conditions) with their weights, and the bias."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def logit(self) -> Column:
        """The ensemble as one column expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, threshold in rule:
                holds = holds & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return total


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: list[np.ndarray], depth: int, least: int) -> tuple[list[tuple[tuple[int, bool, float], ...]], np.ndarray]:
    """One regression tree on gradients: the paths to its nodes, and its step for every row."""
    placed = [np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bins)]
    step, paths = np.zeros(len(x)), []

    def split(rows: np.ndarray, path: tuple[tuple[int, bool, float], ...], left: int) -> None:
        if path:
            paths.append(path)
        best = (1e-6, -1, 0.0)
        if left:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, cuts in enumerate(bins):
                if not len(cuts):
                    continue
                size = len(cuts) + 1
                at = placed[j][rows]
                gs, hs, ns = (np.bincount(at, weights=w, minlength=size).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, float(cuts[k]))
        if best[1] < 0:
            step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            return
        _, j, cut = best
        low = x[rows, j] <= cut
        split(rows[low], (*path, (j, False, cut)), left - 1)
        split(rows[~low], (*path, (j, True, cut)), left - 1)

    split(np.arange(len(x)), (), depth)
    return paths, step


def extract(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3) -> list[tuple[tuple[int, bool, float], ...]]:
    """Distinct rules of boosted trees."""
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    f, rules = np.full(len(x), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, step = grow(x, p - y, np.maximum(p * (1 - p), 1e-6), bins, depth, max(5, len(x) // 500))
        f += rate * step
        for path in paths:
            rules.setdefault(tuple(sorted(set(path))), None)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, l1: float, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Lasso logistic weights by accelerated proximal gradient; the bias is not penalised."""
    n, k = r.shape
    a = np.c_[r, np.ones(n)]
    pace = 4 * n / (np.linalg.norm(a, 2) ** 2)
    w = np.zeros(k + 1)
    ahead, momentum = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -40, 40)))
        new = ahead - pace * (a.T @ (p - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - pace * l1)
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray, l1: float = 5e-4) -> Ensemble:
    """Rules and weights from the statistics (columns as in ``STATISTICS``) and 0/1 labels."""
    if len(y) == 0:
        return Ensemble()
    if y.min() == y.max():
        return Ensemble(bias=math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules = extract(x, y, TREES, DEPTH)
    r = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for j, above, cut in rule:
            r[:, i] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    weights, bias = lasso(r, y, l1)
    kept = np.flatnonzero(weights)
    named = [tuple((STATISTICS[j], above, cut) for j, above, cut in rules[i]) for i in kept]
    return Ensemble(named, weights[kept].tolist(), bias)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, quality: str, learnable: Column, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Ensemble of the learnable labelled rows. Contradicting labels of an id count as their mean, rounded up."""
    known = labels.select(F.col(key).alias("_key"), F.col(quality).alias("_quality"), learnable.alias("_learn")).filter(F.col("_learn"))
    known = known.filter(F.col("_key").isNotNull() & F.col("_quality").isNotNull()).groupBy("_key").agg((F.avg("_quality") >= 0.5).cast("double").alias("_label"))
    picked = known.orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)  # bounded: may be broadcast
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    sample = rows.select("_label", *[c.alias(n) for n, c in statistics(F.col("_text")).items()]).collect()
    table = np.array([list(r) for r in sample], dtype=float).reshape(len(sample), 1 + len(STATISTICS))
    order = np.lexsort(table.T)  # the order in which rows arrive must not matter
    return fit(table[order, 1:], table[order, 0])


def score(df: DataFrame, text: str, ensemble: Ensemble, name: str = "score") -> DataFrame:
    """All columns of ``df`` with the probability of label 1 in ``name``.

    A null text is scored like an empty one. A column called ``name`` is
    replaced; columns named like a statistic stay as they are. Rows are scored
    one by one: repeated rows repeat, an empty table stays empty.
    """
    kept = [c for c in df.columns if c != name]
    measured = df.select(F.struct(*[df[c] for c in kept]).alias("_row"), *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), ensemble.logit()))))
    return measured.select("_row.*", p.alias(name))
