"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

The candidates of a block become postings, one list per component (term):
positions and weights of the rows whose component is not zero. A query row,
read as a sparse row, scatters ``query weight * posting weight`` of each of
its terms into a dense score array of the block; the k best are taken by
partition selection. Spark merges the blocks' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import vectors

FOUND = "query_id bigint, vec_id bigint, score bigint"


def postings(weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term: where it occurs (a slice when everywhere) and its weights there."""
    lists = []
    for column in np.ascontiguousarray(weights.T):
        at = np.flatnonzero(column)
        lists.append((slice(None), column) if len(at) == len(column) else (at, column[at]))
    return lists


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray | slice, np.ndarray]], size: int) -> np.ndarray:
    """Dense scores of one sparse query row against a block."""
    scores = np.zeros(size, dtype=np.int64)
    for term in np.flatnonzero(query[: len(lists)]):
        at, weights = lists[term]
        scores[at] += query[term] * weights
    return scores


def topk_inner_product(df: DataFrame, key: str, vector: str, is_query: Column, k: int, scale: float = 256.0, *,
                       query_block: int = vectors.QUERY_BLOCK, candidate_block: int = vectors.CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest inner product per query row.

    Components are quantised to ``floor(scale * x)`` and scores are 64-bit
    integers (they wrap beyond that, as Spark's bigint does). Ties go to the
    smaller id. Rows with a null id, a null vector, or null, NaN or infinite
    components take no part; shorter vectors count as padded with zeros; rows
    that repeat an id count once, by their smallest vector, and never answer
    their own id. Fewer than k candidates: all of them. Other columns are
    ignored. An empty table gives no row.
    """
    usable = vectors.rows(df, key, vector).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("vec"))
    asked = df.filter(is_query)
    queries = vectors.rows(asked, key, vector).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("vec"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, rows = right["id"].to_numpy(), vectors.matrix(right["vec"]).astype(np.int64)
            order = vectors.one_row_per_id(ids, rows)
            ids, lists = ids[order], postings(rows[order])
            names, asks = left["id"].to_numpy(), vectors.matrix(left["vec"]).astype(np.int64)
            for i in vectors.one_row_per_id(names, asks):
                scores = accumulate(asks[i], lists, len(ids))
                best = vectors.best_in_order(-scores, k + 1)
                best = best[ids[best] != names[i]][:k]
                out[0].append(np.full(len(best), names[i]))
                out[1].append(ids[best])
                out[2].append(scores[best])
        parts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(parts, names=["query_id", "vec_id", "score"])

    found = vectors.search_blocks(queries, usable, search, FOUND, usable.count(), query_block, candidate_block)
    return vectors.ranked(found, [F.desc("score"), F.asc("vec_id")], k)
