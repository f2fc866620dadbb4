"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic examples (P) and unlabelled text (U) only. With
class prior ``pi`` the risk of a classifier f is

    pi * E_P[l(f, +)] + max(0, E_U[l(f, -)] - pi * E_P[l(f, -)])

whose second term estimates the risk on clean text without a clean example;
kept from going negative, it does not reward memorising P. The classifier is
linear over the distinct words and word beginnings (four letters) of a text
that are significantly more frequent in P than in U, with an L1 step on
their weights: a long clean text does not add up to a toxic one, and a few toxic
words are enough in a long one.

The model is fitted on at most ``positives`` toxic and ``unlabelled`` other
texts, those with the smallest hash of their id; the prior is the share of
toxic rows among all learnable labels unless it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import text_features as features

POSITIVES, UNLABELLED = 2000, 5000
BITS = 20
STEM = 4  # letters of a word beginning
KEPT_FEATURES = 4096
SIGNIFICANT = 10.0  # least log-likelihood ratio of a feature


@dataclass
class Model:
    """Feature ids in ascending order, their weights, and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        hits: list[np.ndarray] = []
        table = np.full(1 << BITS, -1, dtype=np.int32)
        table[self.ids] = np.arange(len(self.ids))
        for codes, row in features.blocks(texts):
            for at, h in hashed(codes):
                slot = table[h]
                hit = slot >= 0
                hits.append(np.unique(row[at[hit]].astype(np.int64) * len(self.ids) + slot[hit]))
        if hits and len(self.ids):
            rows, slots = np.divmod(np.unique(np.concatenate(hits)), len(self.ids))
            logit += np.bincount(rows, weights=self.weights[slots], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def hashed(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and word beginnings of a block: (position, hash)."""
    at, begin = features.char_ngrams(codes, 1 + STEM, BITS)
    first = codes[at] == 0
    return [features.words(codes, BITS), (at[first], begin[first])]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            found = [h for codes, _ in features.blocks([text]) for _, h in hashed(codes)]
            rows.append(np.unique(np.concatenate(found)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(rows, pa.list_(pa.int32()))], names=["positive", "at"])


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features more frequent in P than in U, by falling log-likelihood ratio, as far as it is significant."""
    ids = np.flatnonzero((in_p + in_u >= 3) & (in_p * n_u > in_u * n_p))
    p, u = in_p[ids].astype(float), in_u[ids].astype(float)
    share = (p + u) / (n_p + n_u)
    term = lambda n, expected: n * np.log(np.maximum(n, 1e-300) / np.maximum(expected, 1e-300))
    ratio = term(p, n_p * share) + term(u, n_u * share) + term(n_p - p, n_p * (1 - share)) + term(n_u - u, n_u * (1 - share))
    order = np.argsort(-ratio, kind="stable")
    return ids[order[ratio[order] > SIGNIFICANT]]


def nnpu(p: list[np.ndarray], u: list[np.ndarray], size: int, prior: float, steps: int, rate: float, l1: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch proximal Adam on the non-negative risk with logistic loss."""
    rows, at = p + u, np.concatenate([*p, *u]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    in_p = np.arange(len(rows)) < len(p)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        f = np.bincount(owner, weights=w[at], minlength=len(rows)) + w[size]
        toxic = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # derivative of the loss as clean; minus (1 - toxic) is that as toxic
        loss = np.logaddexp(0, f)
        clean_risk = loss[~in_p].mean() - prior * loss[in_p].mean()
        pull = np.where(in_p, -prior * (1 - toxic) / len(p), 0)
        push = np.where(in_p, -prior * toxic / len(p), toxic / len(u))
        g = pull + push if clean_risk >= 0 else -push
        grad = np.append(np.bincount(at, weights=g[owner], minlength=size), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= pace * m / (1 - 0.9**step)
        w[:size] = np.sign(w[:size]) * np.maximum(0, np.abs(w[:size]) - pace[:size] * l1)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, learnable: Column, *, prior: float | None = None,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED, features_kept: int = KEPT_FEATURES, steps: int = 300, rate: float = 0.05,
          l1: float = 1e-5) -> Model | None:
    """Model of the learnable rows; None without a toxic example. A row labelled both ways counts as toxic."""
    known = labels.select(F.col(key).alias("_key"), F.col(toxic).alias("_toxic"), learnable.alias("_learn")).filter(F.col("_learn"))
    known = known.filter(F.col("_key").isNotNull() & F.col("_toxic").isNotNull()).groupBy("_key").agg(F.max(F.col("_toxic") == 1).alias("positive"))
    if prior is None:
        prior = known.agg(F.avg(F.col("positive").cast("double"))).first()[0]
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), learnable.alias("_learn"))
    p = known.filter("positive").select("_key", F.lit(True).alias("positive"))
    u = given.filter(F.col("_key").isNotNull() & F.col("_learn")).select("_key", F.lit(False).alias("positive")).distinct()
    few = lambda df, n: df.orderBy(F.xxhash64("_key"), "_key").limit(n)
    picked = few(p, positives).unionByName(few(u, unlabelled))  # at most positives + unlabelled rows
    counted = given.join(F.broadcast(picked), "_key").select("positive", "text")
    sample = counted.mapInArrow(_distinct, "positive boolean, at array<int>").collect()
    sample.sort(key=lambda r: (r.positive, r.at))  # the order in which rows arrive must not matter
    sets = {side: [np.array(r.at, dtype=np.int64) for r in sample if r.positive is side] for side in (True, False)}
    if not sets[True] or not sets[False]:
        return None
    prior = min(max(prior, 1e-3), 0.999)
    in_p, in_u = (np.bincount(np.concatenate(sets[s]), minlength=1 << BITS) for s in (True, False))
    ids = telling(in_p, in_u, len(sets[True]), len(sets[False]))
    ids = np.sort(ids[:features_kept])
    slot = np.full(1 << BITS, -1)
    slot[ids] = np.arange(len(ids))
    inside = {side: [s[s >= 0] for s in (slot[r] for r in rows)] for side, rows in sets.items()}
    weights, bias = nnpu(inside[True], inside[False], len(ids), prior, steps, rate, l1)
    return Model(ids[weights != 0], weights[weights != 0], bias)


def score(df: DataFrame, text: str, model: Model | None, name: str = "score") -> DataFrame:
    """All columns of ``df`` with the probability of being toxic in ``name``.

    A null or empty text gets the score of a text without any feature; without
    a model every score is 0. A column called ``name`` is replaced. Rows are
    scored one by one: repeated rows repeat, an empty table stays empty. The
    model has a fixed size (at most ``features_kept`` weights).
    """

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.zeros(len(batch)) if model is None else model.scores(batch.to_pylist()))

    return df.withColumn(name, probability(F.col(text)))
