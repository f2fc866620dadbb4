"""Vector code compression: product quantisation by active-entry Lloyd rounds.

Components become integers and vectors are cut into equal parts; each part
position has a codebook. Each row keeps, per part, its entry and the exact
squared distance to it. After a codebook has moved, a part whose entry stayed
where it was compares its stored distance with the entries that moved and with
no others, for the unmoved ones are as far as before; a part whose entry moved
rescans the whole codebook. Equal distances go to the lower index either way,
so the codes are those of full rescans.

Rows stay where they are: a round is one pass over the written rows, which
writes them with their new codes, and one pass that sums the parts of each
entry, per task before anything is shuffled. Only codebooks reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.vectors import matrix, usable
from weftline.session import Rounds

PARTS, ENTRIES, LLOYD_ROUNDS, SCALE = 4, 256, 4, 1024.0
LARGEST = 1 << 27  # components are held to this size: beyond it a squared distance no longer fits a bigint
EXACT = 1 << 22  # up to here distances are exact in doubles
CHUNK = 4096  # rows compared at a time
BROADCAST_LABELS = 50_000  # labels broadcast at most, by count; more are joined with salt
SALT = 16

STATE = "id bigint, label {label}, vec array<int>, codes array<int>, distances array<bigint>"


def quantised(df: DataFrame, key: str, vector: str, label: Column, scale: float) -> DataFrame:
    """(id, label, vec): the integer components of the rows that take part."""
    held = df.select(F.col(key).cast("bigint").alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    whole = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e15)), F.lit(-1e15)) * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return held.filter(usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: whole(x).cast("int")))


def squared_distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances as int64, rows x entries."""
    if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) * np.sqrt(rows.shape[1] / 16) <= EXACT:
        r, e = rows.astype(np.float64), entries.astype(np.float64)
        return ((r * r).sum(1)[:, None] - 2.0 * (r @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.zeros((len(rows), len(entries)), np.int64)
    for place in range(rows.shape[1]):
        out += (rows[:, place, None] - entries[:, place]) ** 2
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry, ties to the lower index."""
    index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), CHUNK):
        d = squared_distances(rows[at : at + CHUNK], entries)
        index[at : at + CHUNK] = best = d.argmin(1)
        distance[at : at + CHUNK] = d[np.arange(len(d)), best]
    return index, distance


def reassign(rows: np.ndarray, codes: np.ndarray, distances: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of one part position under a codebook of which ``moved`` entries are new; a code of -1 is none yet."""
    codes, distances = codes.copy(), distances.copy()
    fixed = (codes >= 0) & ~moved[codes]
    again = np.flatnonzero(~fixed)
    if len(again):
        codes[again], distances[again] = nearest(rows[again], entries)
    active, stayed = np.flatnonzero(moved), np.flatnonzero(fixed)
    if len(active) and len(stayed):
        place, distance = nearest(rows[stayed], entries[active])
        found = active[place]
        better = (distance < distances[stayed]) | ((distance == distances[stayed]) & (found < codes[stayed]))
        codes[stayed[better]], distances[stayed[better]] = found[better], distance[better]
    return codes, distances


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray, label_type: str) -> DataFrame:
    """The rows with codes and distances under ``books`` (parts x entries x width)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = matrix(batch["vec"], parts * width).astype(np.int64).reshape(-1, parts, width)
            codes, distances = (matrix(batch[c], parts).astype(np.int64) for c in ("codes", "distances"))
            for p in range(parts):
                codes[:, p], distances[:, p] = reassign(cut[:, p], codes[:, p], distances[:, p], books[p], moved[p])
            made = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), parts).cast(pa.list_(k)) for c, k in ((codes, pa.int32()), (distances, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["vec"], *made], names=["id", "label", "vec", "codes", "distances"])

    return rows.mapInArrow(run, STATE.format(label=label_type))


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            cut = matrix(batch["vec"], parts * width).astype(np.int64).reshape(-1, width)
            slots = (matrix(batch["codes"], parts).astype(np.int64) + np.arange(parts) * entries).ravel()
            order = np.argsort(slots, kind="stable")
            held, first = np.unique(slots[order], return_index=True)
            if len(held):
                totals[held] += np.add.reduceat(cut[order], first)
                counts += np.bincount(slots, minlength=parts * entries)
        used = np.flatnonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(totals[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], names=["slot", "n", "total"])

    held = state.select("vec", "codes").mapInArrow(run, "slot bigint, n bigint, total array<bigint>")
    sums = held.select("slot", "n", F.posexplode("total").alias("place", "total")).groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.reshape(parts * entries, width).copy()
    for slot, place, n, total in sums.collect():  # entries x components of one codebook set, whatever the rows
        out[slot, place] = total // n
    return out.reshape(books.shape)


def compress(
    df: DataFrame, key: str, vector: str, label: str | None = None, *,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = LLOYD_ROUNDS, scale: float = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): rows are (id, label, codes, error); codebooks are parts x entries x width integers.

    Codebooks start as the parts of the ``entries`` smallest ids; equal ids go
    by vector, null ids come last. ``codes`` has an index per part, ``error``
    is the final squared distance summed over parts. Rows with a null vector
    or null, NaN or infinite components are left out; rows with a null id or
    label take part, and repeated rows count as often as they are there.
    Shorter vectors count as padded with zeros to a multiple of ``parts``.
    Components beyond 2^27 after scaling are held to that size. With fewer
    rows than entries the codebooks are as small. Other columns are ignored.
    An empty table gives no row and empty codebooks.
    """
    kept = Rounds(df.sparkSession)
    label_type = df.schema[label].dataType.simpleString() if label else "string"
    given = quantised(df, key, vector, F.col(label) if label else F.lit(None).cast("string"), scale)
    none = lambda kind: F.array_repeat(F.lit(-1).cast(kind), parts)
    state = kept.keep("state", given.select("*", none("int").alias("codes"), none("bigint").alias("distances")))
    widest = state.agg(F.max(F.size("vec"))).first()[0]
    first = state.orderBy(F.asc_nulls_last("id"), "vec").select("vec").limit(entries).collect()
    width = -(-(widest or 0) // parts)
    books = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        books[i, : len(row.vec)] = row.vec
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    if len(first) and width:
        moved = np.ones(books.shape[:2], bool)
        for _ in range(rounds):
            state = kept.keep("state", assigned(state, books, moved, label_type))
            following = moved_books(state, books)
            moved, books = (following != books).any(axis=2), following
            if not moved.any():
                break
        state = kept.keep("state", assigned(state, books, moved, label_type)) if moved.any() else state
    elif len(first):
        state = state.withColumn("codes", F.array_repeat(F.lit(0), parts)).withColumn("distances", F.array_repeat(F.lit(0).cast("bigint"), parts))
    error = reduce(lambda a, b: a + b, [F.get("distances", F.lit(p)) for p in range(parts)])
    return state.select("id", "label", "codes", error.alias("error")), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error) with ``label_error``, the error summed over the rows of the same label; nulls are one label."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        few = sums.select(F.col("label").alias("_l"), "label_error")
        return rows.join(F.broadcast(few), F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
    spread = sums.select(F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "error", "codes"), F.lit(SALT)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s"))).drop("_l", "_s", "_salt")


def code_string(codes: Column) -> Column:
    """Two lowercase hex digits per code."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def listed(books: np.ndarray) -> str:
    """All components as decimal integers by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))
