"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Base patterns find assignments to secret names, access keys and long hexadecimal
runs. Two first-order Markov models over the characters of tokens, one of random
strings and one of ordinary identifiers, are trained from labelled samples. A
token whose log-likelihood ratio outweighs the odds against a secret, as the
samples have them, and a margin, is a span of its own kind. Base spans stay
whatever the models say.

Both are smoothed towards character frequencies: ordinary samples are labelled
by what the patterns do not find, so unknown secrets are among them. The model
of random strings keeps a share for uniform characters, as a secret may be of
another alphabet than the samples. Training counts transitions of all samples: a task hands on
one table of counts per label, and the driver gets their sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # a run of 16 or more is a whole leftmost match of [0-9a-f]+
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "markov")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST_TOKEN = 12
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_TOKEN)
EDGES = "+/_.-"  # punctuation cut off at either end of a token
SIZE = len(LETTERS)
START = SIZE  # what comes before the first character
UNIFORM = 0.25  # share of uniform characters in the model of random strings
PRIOR = 1000.0  # observations by which rare characters are drawn to the frequencies of all, so that a secret among the ordinary samples teaches little
MARGIN = 10.0  # nats by which a token must outweigh the odds
BATCH_TOKENS = 1 << 21  # characters scored at a time

_PLACE = np.zeros(128, np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(SIZE)

SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) by start and kind, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, base: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens outside base spans; what a base span leaves of one counts by itself."""
    for m in TOKEN.finditer(text):
        at, end = m.span()
        for start, _, stop, _ in base:
            if start < end and stop > at:
                yield from _trimmed(text, at, start)
                at = max(at, stop)
        yield from _trimmed(text, at, end)


def _trimmed(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    token = text[at:end]
    at += len(token) - len(token.lstrip(EDGES))
    end -= len(token) - len(token.rstrip(EDGES))
    if end - at >= LEAST_TOKEN:
        yield at, end


def samples(docs: DataFrame, text: str) -> DataFrame:
    """(value, secret): tokens labelled by the base patterns, values of their spans as secret, all other tokens as ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[str] = []
            secret: list[bool] = []
            for body in batch["text"].to_pylist():
                base = base_spans(body or "")
                upto = 0
                for _, _, end, value in base:
                    if end > upto:  # a hexadecimal run inside an assignment is one secret
                        values.append(body[value:end])
                        secret.append(True)
                        upto = end
                plain = [body[a:b] for a, b in other_tokens(body or "", base)]
                values += plain
                secret += [False] * len(plain)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(secret, pa.bool_())], names=["value", "secret"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "value string, secret boolean")


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log-likelihood ratio of each transition, (SIZE + 1) x SIZE
    least: float  # a token's sum from which it is a secret

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each token minus what it must reach."""
        now = _PLACE[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
        before = np.r_[START, now[:-1]]
        begins = np.cumsum([0, *map(len, tokens)])[:-1]
        before[begins] = START
        return np.add.reduceat(self.ratio[before, now], begins) - self.least


def _known(value: str | None) -> str:
    """The characters of a sample that the models know."""
    return "".join(c for c in value or "" if c in LETTERS)


def _smoothed(counts: np.ndarray, prior: float) -> np.ndarray:
    """Transition probabilities; each row is drawn to those of all rows, and these to uniform ones, as by ``prior`` observations."""
    whole = (counts.sum(axis=0) + prior / SIZE) / (counts.sum() + prior)
    return (counts + prior * whole) / (counts.sum(axis=1, keepdims=True) + prior)


def model_of(counts: np.ndarray, tokens: np.ndarray, uniform: float = UNIFORM, margin: float = MARGIN, prior: float = PRIOR) -> Model:
    """The models from transition counts (ordinary, secret) and numbers of sample tokens (ordinary, secret)."""
    ordinary, random = (_smoothed(c.astype(float), prior) for c in counts)
    random = (1 - uniform) * random + uniform / SIZE
    odds = np.log((tokens[0] + 1) / (tokens[1] + 1))
    return Model(np.log(random) - np.log(ordinary), max(float(odds), 0.0) + margin)


def train(labelled: DataFrame, value: str, secret: str, uniform: float = UNIFORM, margin: float = MARGIN, prior: float = PRIOR) -> Model:
    """Both models from all labelled samples; null values and labels teach nothing, other characters are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE + 1, SIZE), np.int64)
        tokens = np.zeros(2, np.int64)
        for batch in batches:
            marks = np.array(batch["secret"].to_pylist(), dtype=bool)
            values = list(map(_known, batch["value"].to_pylist()))
            for label in (0, 1):
                chosen = [v for v, mark in zip(values, marks, strict=True) if mark == label and v]
                if chosen:
                    now = _PLACE[np.frombuffer("".join(chosen).encode("ascii"), np.uint8)]
                    before = np.r_[START, now[:-1]]
                    before[np.cumsum([0, *map(len, chosen)])[:-1]] = START
                    counts[label] += np.bincount(before * SIZE + now, minlength=(SIZE + 1) * SIZE).reshape(SIZE + 1, SIZE)
                    tokens[label] += len(chosen)
        flat = np.concatenate([counts.ravel(), tokens])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["slot", "n"])

    given = labelled.select(F.col(value).cast("string").alias("value"), F.col(secret).cast("boolean").alias("secret")).filter("value is not null and secret is not null")
    sums = given.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    flat = np.zeros(2 * (SIZE + 1) * SIZE + 2, np.int64)
    for slot, n in sums.collect():  # at most as many as the table has places
        flat[slot] = n
    return model_of(flat[:-2].reshape(2, SIZE + 1, SIZE), flat[-2:], uniform, margin, prior)


def scan(docs: DataFrame, text: str, model: Model, name: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and ``name``: the spans (kind, start, end, score) by start, then kind.

    Kinds are ``assign`` (the whole assignment), ``access``, ``hex`` and
    ``markov``; start and end are code points, end exclusive; ``score`` is the
    log-likelihood ratio beyond what is asked, null for base spans. Tokens that
    a base span overlaps are scored by what is left of them. A null or empty
    text has no spans; rows are independent, so ties and repeated rows change
    nothing; a column called ``name`` is replaced. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c != name]
    given = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.col(text).cast("string").alias("_body")) if kept else docs
    row_type = given.schema["_row"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[tuple]] = []
            waiting: list[tuple[int, int, int]] = []
            tokens: list[str] = []
            size = 0

            def settle() -> None:
                if tokens:
                    for (row, at, end), score in zip(waiting, model.scores(tokens).tolist(), strict=True):
                        if score >= 0:
                            spans[row].append((at, 3, end, score))

            for row, body in enumerate(batch["_body"].to_pylist()):
                base = base_spans(body or "")
                spans.append([(at, kind, end, None) for at, kind, end, _ in base])
                for at, end in other_tokens(body or "", base):
                    waiting.append((row, at, end))
                    tokens.append(body[at:end])
                    size += end - at
                if size > BATCH_TOKENS:
                    settle()
                    waiting, tokens, size = [], [], 0
            settle()
            found = [[{"kind": KINDS[kind], "start": at, "end": end, "score": score} for at, kind, end, score in sorted(s, key=lambda x: x[:2])] for s in spans]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(found, span)], names=["_row", "_found"])

    made = given.mapInArrow(run, f"_row {row_type}, _found {SPANS}")
    return made.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_found").alias(name))
