"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3 letters, with word
borders), hashed; TF is the share of a text's n-grams, so the score of a text
is a sum over its n-grams and whole texts of any length are scored in one pass.
The weights are trained with the follow-the-regularised-leader update and an
elastic-net penalty, which leaves most of them at zero. A temperature fitted
on a part of the sample kept out of training calibrates the probabilities.

The model is fitted on at most ``rows_per_language`` texts of each language,
those with the smallest hash of their id, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import text_features as features

ROWS_PER_LANGUAGE = 1000
BITS = 17
SIZES = (1, 2, 3)
UNKNOWN = "und"
SCALE = 20.0  # of the TF-IDF vectors, whose raw entries are small shares


@dataclass
class Model:
    """``weights`` (feature, language) with IDF multiplied in, ``bias``, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        sums, totals = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for codes, row in features.blocks(texts):
            for n in SIZES:
                at, gram = features.char_ngrams(codes, n, BITS)
                if not len(at):
                    continue
                owner = row[at]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[first]] += np.add.reduceat(self.weights[gram], first, axis=0)
                totals[owner[first]] += np.diff(np.r_[first, len(at)])
        return sums * (SCALE / np.maximum(totals, 1))[:, None] + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float,
         l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate follow-the-regularised-leader; the bias is not penalised."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    weak, strong = np.full(size + 1, l1), np.full(size + 1, l2)
    weak[size] = strong[size] = 0

    def solve(at: np.ndarray | slice) -> np.ndarray:
        zs, edge = z[at], weak[at][:, None]
        step = (beta + np.sqrt(n[at])) / alpha + strong[at][:, None]
        return np.where(np.abs(zs) > edge, -(zs - np.sign(zs) * edge) / step, 0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            at, value = np.append(at, size), np.append(value, 1.0)
            w = solve(at)
            gap = softmax(value @ w)
            gap[labels[i]] -= 1
            g = value[:, None] * gap
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(slice(None))
    return w[:size], w[size]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid of powers."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(docs: DataFrame, key: str, text: str, lang: str, learnable: Column, *, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 4,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 11) -> Model | None:
    """Model of the learnable rows with an id, a text and a language; None if there are none."""
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"), learnable.alias("_learn"))
    known = given.filter(F.col("_learn") & F.col("_key").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    by_hash = Window.partitionBy("lang").orderBy("_hash", "_key")
    picked = (
        known.select("_key", "lang", F.xxhash64("_key").alias("_hash"))
        .withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= rows_per_language).select("_key").distinct()
    )
    counted = known.join(F.broadcast(picked), "_key").select("lang", "text")  # at most rows_per_language ids of each language
    sample = counted.mapInArrow(_counts, "lang string, at array<int>, tf array<double>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["lang"].to_pylist(), b["at"].value_lengths().to_numpy(), b["at"].flatten().to_numpy().copy(), b["tf"].flatten().to_numpy().copy()) for b in batches]
        if any(p[0] for p in parts):
            langs, *arrays = zip(*parts, strict=True)
            parts.clear()
            pa.default_memory_pool().release_unused()
            model = _fitted(list(chain(*langs)), *map(np.concatenate, arrays), epochs, alpha, beta, l1, l2, seed)
            columns = [model.languages], [model.weights.tobytes()], [model.bias.tolist()], [model.temperature]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MODEL.types, strict=True)], schema=_MODEL)

    # in a task, and not on the driver, whose memory would keep the room that the sample took; the driver gets the weights alone
    found = sample.repartition(1).mapInArrow(fit, "languages array<string>, weights binary, bias array<double>, temperature double").toArrow()
    if not found.num_rows:
        return None
    languages, weights, bias, heat = (found[c][0].as_py() for c in _MODEL.names)
    return Model(languages, np.frombuffer(weights, np.float32).reshape(1 << BITS, len(languages)), np.array(bias), heat)


_MODEL = pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("bias", pa.list_(pa.float64())), ("temperature", pa.float64())])


def _fitted(langs: list[str], sizes: np.ndarray, at: np.ndarray, tf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float,
            seed: int) -> Model:
    """Model of a sample that is not empty; ``at`` and ``tf`` hold all rows one after another, ``sizes`` entries each.

    Large flat arrays, as the room of many small ones stays with the worker.
    """
    ends = np.cumsum(sizes)
    part = [slice(e - n, e) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    # the order in which rows arrive must not matter; big-endian bytes of numbers above zero sort as the numbers do
    ranked = []
    begin = lambda i: (langs[i], at[part[i]][:16].astype(">i4").tobytes())
    for _, same in groupby(sorted(range(len(langs)), key=begin), begin):
        ranked += sorted(same, key=lambda i: (at[part[i]].astype(">i4").tobytes(), tf[part[i]].astype(">f8").tobytes()))
    languages = sorted(set(langs))
    labels = np.array([languages.index(langs[i]) for i in ranked])
    idf = np.log((1 + len(ranked)) / (1 + np.bincount(at, minlength=1 << BITS))) + 1
    value = SCALE * tf
    value *= idf[at]
    rows = [(at[part[i]], value[part[i]]) for i in ranked]
    order = np.random.default_rng(seed).permutation(len(rows))
    kept = order[: len(order) // 5]
    used = order[len(order) // 5 :]
    weights, bias = ftrl([rows[i] for i in used], labels[used], len(languages), epochs, alpha, beta, l1, l2, seed)
    logits = np.array([v @ weights[a] + bias for a, v in (rows[i] for i in kept)]).reshape(len(kept), len(languages))
    heat = temperature(logits, labels[kept]) if len(kept) else 1.0
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, heat)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its distinct n-grams and their shares."""
    for batch in batches:
        at, share = [], []
        for text in batch["text"].to_pylist():
            grams = [features.char_ngrams(codes, n, BITS)[1] for codes, _ in features.blocks([text]) for n in SIZES]
            ids, counts = np.unique(np.concatenate(grams), return_counts=True)
            at.append(ids.astype(np.int32))
            share.append(counts / max(1, counts.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch["lang"], pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float64()))], names=["lang", "at", "tf"]
        )


def predict(df: DataFrame, text: str, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``df`` with the predicted language and its calibrated probability.

    A null text, one without a letter, or any text without a model is ``und``
    with score 0. Columns with the two names are replaced. Rows are scored one
    by one: repeated rows repeat, an empty table stays empty. The model has a
    fixed size (2^17 weights per language).
    """

    @F.arrow_udf("struct<lang string, score double>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            ok = [model is not None and features.has_letter(t) for t in texts]
            if not any(ok):
                names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = model.probabilities(texts)
                top = p.argmax(axis=1)
                names = [model.languages[i] if k else UNKNOWN for i, k in zip(top, ok, strict=True)]
                best = np.where(ok, p[np.arange(len(texts)), top], 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best)], names=["lang", "score"])

    kept = [c for c in df.columns if c not in (lang, score)]
    found = df.select(F.struct(*[df[c] for c in kept]).alias("_row"), label(F.col(text)).alias("_found"))
    return found.select("_row.*", F.col("_found.lang").alias(lang), F.col("_found.score").alias(score))
