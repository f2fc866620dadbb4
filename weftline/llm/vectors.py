"""What both vector searches share: usable rows, and a grid of bounded blocks.

A search compares Q query rows with N candidate rows. Neither side fits one
task at scale, so both are hashed into blocks of a bounded number of rows and
every pair of blocks is one group: query rows are copied to all candidate
blocks and candidate rows to all query blocks. A group holds at most about
``query_block + candidate_block`` rows, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384


def usable(vector: Column, *, zero: bool = True) -> Column:
    """True for vectors without null, NaN or infinite components (``zero=False``: and not all zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & finite
    if not zero:
        ok = ok & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def rows(df: DataFrame, key: str, vector: str, *, zero: bool = True) -> DataFrame:
    """(id bigint, vec array<double>) of the rows that take part."""
    picked = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return picked.filter(F.col("id").isNotNull() & usable(F.col("vec"), zero=zero))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of an array column as a dense matrix; missing trailing components are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(width if width is not None else lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    inside = np.arange(width)[None, :] < lengths[:, None]
    out[inside] = flat
    return out


def one_row_per_id(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Positions in id order; of rows that repeat an id the smallest vector stays."""
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.r_[True, np.diff(ids[order]) != 0]]
    return order


def best_in_order(keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest keys, ties to the earlier position."""
    if len(keys) > k:
        near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
    else:
        near = np.arange(len(keys))
    return near[np.argsort(keys[near], kind="stable")[:k]]


def search_blocks(
    queries: DataFrame, candidates: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    n_candidates: int, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``search`` over every pair of blocks; both sides have a column ``id``."""
    spark = candidates.sparkSession
    n_queries = queries.count()
    across = max(1, -(-n_queries // query_block))
    down = max(2 * spark.sparkContext.defaultParallelism, -(-n_candidates // candidate_block))
    cells = across * down
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", block(across)).withColumn("_c", spread(down))
    right = candidates.withColumn("_c", block(down)).withColumn("_q", spread(across))
    cell = (F.col("_c") * F.lit(across) + F.col("_q")).alias("cell")
    # twice as many partitions as cells: fixed, so that small groups are not packed into a few tasks
    parts = min(2 * cells, 20_000)
    left, right = (side.select(cell, *kept.columns).repartition(parts, "cell") for side, kept in ((left, queries), (right, candidates)))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, schema)


def ranked(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Merge the blocks' best rows: each query's k best."""
    place = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
