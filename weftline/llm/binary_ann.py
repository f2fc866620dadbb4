"""Approximate nearest neighbours with randomly rotated one-bit codes.

A row is centred, scaled to unit length and rotated by a random orthogonal
matrix; the signs of the result, one bit per dimension, are its code. Three
numbers go with it: the distance to the centre, and the inner product of the
unit vector with its own code (the correction). From the packed bits alone the
inner product of a rotated query with a row is estimated without bias, with an
error bound; only rows whose lower bound on the distance does not exceed the
k-th smallest upper bound are compared exactly on the original vectors.

The centre is fitted on a bounded sample (``fit_rows``); every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import vectors

FIT_ROWS = 4096
FOUND = "query_id bigint, vec_id bigint, score double"
INDEX = "id bigint, vec array<double>, code binary, norm double, fit double"


class Rotation:
    """Centre and random rotation of an index."""

    def __init__(self, center: np.ndarray, seed: int) -> None:
        width = len(center)
        self.center = center
        basis, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
        self.basis = basis * np.sign(np.diag(upper))

    def unit(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit residuals and their lengths before scaling; a row at the centre stays zero."""
        moved = (rows - self.center) @ self.basis
        norm = np.linalg.norm(moved, axis=1)
        return moved / np.where(norm > 0, norm, 1)[:, None], norm


def fit(usable: DataFrame, fit_rows: int, seed: int) -> Rotation | None:
    """Centre of a hash sample of at most ``fit_rows`` rows; None for an empty table."""
    sample = [r.vec for r in usable.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").collect()]
    width = usable.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        return None
    total = np.zeros(width)
    for vec in sample:
        total[: len(vec)] += np.asarray(vec)
    return Rotation(total / max(1, len(sample)), seed)


def encode(usable: DataFrame, rotation: Rotation) -> DataFrame:
    """The index: every row with its packed code and correction scalars."""
    width = len(rotation.center)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, norm = rotation.unit(vectors.matrix(batch["vec"], width))
            bits = unit >= 0
            packed = np.packbits(bits, axis=1)
            fit_ = np.where(bits, unit, -unit).sum(axis=1) / np.sqrt(max(1, width))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vec"], pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(norm), pa.array(fit_)],
                names=["id", "vec", "code", "norm", "fit"],
            )

    return usable.mapInArrow(codes, INDEX)


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int, *, bound: float = 2.5, seed: int = 7, fit_rows: int = FIT_ROWS,
            query_block: int = vectors.QUERY_BLOCK, candidate_block: int = vectors.CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found per query row, by Euclidean distance.

    ``bound`` is the error bound in standard errors of the estimate: higher
    compares more rows exactly. Scores are exact distances in double precision.
    Ties go to the smaller id. Rows with a null id, a null or zero vector, or
    null, NaN or infinite components take no part; shorter vectors count as
    padded with zeros; rows that repeat an id count once, by their smallest
    vector, and never answer their own id. Fewer than k candidates: all of
    them. Other columns are ignored. An empty table gives no row.
    """
    usable = vectors.rows(df, key, vector, zero=False)
    rotation = fit(usable, fit_rows, seed)
    if rotation is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = len(rotation.center)
    index = encode(usable, rotation)
    queries = vectors.rows(df.filter(is_query), key, vector, zero=False)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, rows = right["id"].to_numpy(), vectors.matrix(right["vec"], width)
            order = vectors.one_row_per_id(ids, rows)
            ids, rows = ids[order], rows[order]
            packed = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(right), -1)[order]
            signs = np.unpackbits(packed, axis=1, count=width).astype(np.float32) * 2 - 1
            norm, fit_ = right["norm"].to_numpy()[order], right["fit"].to_numpy()[order]
            fit_ = np.where(fit_ > 0, fit_, 1)
            spread = np.sqrt(np.maximum(0, 1 - fit_**2)) / fit_ * (bound / np.sqrt(max(1, width - 1)))
            names, asks = left["id"].to_numpy(), vectors.matrix(left["vec"], width)
            order = vectors.one_row_per_id(names, asks)
            names, asks = names[order], asks[order]
            unit, length = rotation.unit(asks)
            for begin in range(0, len(names), 64):
                part = slice(begin, begin + 64)
                dots = (unit[part].astype(np.float32) @ signs.T) / (np.sqrt(width) * fit_)
                square = norm**2 + length[part, None] ** 2
                twice = 2 * norm * length[part, None]
                low, high = square - twice * (dots + spread), square - twice * (dots - spread)
                own = ids[None, :] == names[part, None]
                high[own] = np.inf
                for i, name in enumerate(names[part]):
                    limit = np.partition(high[i], k - 1)[k - 1] if len(ids) > k else np.inf
                    near = np.flatnonzero((low[i] <= limit) & ~own[i])
                    gap = rows[near] - asks[begin + i]
                    exact = np.sqrt((gap * gap).sum(axis=1))
                    best = vectors.best_in_order(exact, k)
                    out[0].append(np.full(len(best), name))
                    out[1].append(ids[near[best]])
                    out[2].append(exact[best])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table([join(out[0], np.int64), join(out[1], np.int64), join(out[2], np.float64)], names=["query_id", "vec_id", "score"])

    found = vectors.search_blocks(queries, index, search, FOUND, usable.count(), query_block, candidate_block)
    return vectors.ranked(found, [F.asc("score"), F.asc("vec_id")], k)
