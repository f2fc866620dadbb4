"""Ordered operations that stay distributed when one key holds most rows.

A window partitioned by a hot key runs in one task. The helpers here number or
scan such groups in bounded pieces: positions are cut into segments, each
segment is scanned alone, and only one summary row per segment crosses over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import durable

SEGMENT_ROWS = 4096
_LOW_BITS = (1 << 33) - 1


def number_rows(
    df: DataFrame, order_by: list[str], within: list[str] | None = None, name: str = "row_no"
) -> DataFrame:
    """1-based ``row_number`` over ``within`` ordered by ``order_by``.

    ``within + order_by`` should identify a row; then even a single group is
    spread over all range partitions. One range shuffle, one count per
    (range, group), one join with those counts.
    """
    within = within or []
    keys = within + order_by
    placed = durable(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per (range, group): the window spans at most as many rows as there are ranges
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_range").alias("_r"),
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)],
    )
    match = F.col("_range") == F.col("_r")
    for i, column in enumerate(within):
        match = match & F.col(column).eqNullSafe(F.col(f"_w{i}"))
    number = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return placed.join(offsets, match).select(*df.columns, number)


def segmented_last(
    df: DataFrame,
    keys: list[str],
    position: str,
    values: dict[str, Column],
    *,
    include_current: bool = True,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Last non-NULL of each value up to a row, per key, in ``position`` order.

    ``include_current=False`` looks at earlier rows only, i.e. a ``lag`` that
    skips NULLs. The window never spans more than ``segment_rows`` positions.
    """
    cut = df.withColumn("_seg", F.floor(F.col(position) / F.lit(segment_rows)))
    cut = cut.withColumns({f"_v_{name}": value for name, value in values.items()})
    inside = Window.partitionBy(*keys, "_seg").orderBy(position)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = cut.withColumns(
        {f"_l_{name}": F.last(f"_v_{name}", ignorenulls=True).over(inside) for name in values}
    )
    # positions per segment are bounded, so the summary is segment_rows times smaller
    summary = cut.groupBy(*keys, "_seg").agg(
        *[
            F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(position))).alias(f"_s_{name}")
            for name in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        "_seg",
        *[F.last(f"_s_{name}", ignorenulls=True).over(before).alias(f"_c_{name}") for name in values],
    )
    # only later segments can receive a carry; most keys have a single segment and drop out here
    carry = carry.filter(F.coalesce(*[F.col(f"_c_{name}").cast("string") for name in values]).isNotNull())
    return local.join(carry, [*keys, "_seg"], "left").select(
        *df.columns,
        *[F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name) for name in values],
    )


def row_count(df: DataFrame) -> Column:
    """Rows of a group; a rolled-up table counts what its rows stand for."""
    if "rows" in df.columns:
        return F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")
    return F.count(F.lit(1))


def roll_up(df: DataFrame, keys: list[str], position: str = "seq") -> DataFrame:
    """Counts and first position per key combination.

    Small enough to be read many times by the reports built on it.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(position).alias(position))


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct non-empty values with their first position and row count."""
    return (
        df.filter(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy(value)
        .agg(F.min(position).alias("first_seq"), F.count(F.lit(1)).alias("n"))
    )


def top_counts(df: DataFrame, value: Column, position: str, limit: int, name: str = "value") -> DataFrame:
    """Most frequent values; ties go to the one seen first."""
    counted = df.groupBy(value.alias(name)).agg(
        row_count(df).alias("n"), F.min(position).alias("first_seq")
    )
    return counted.orderBy(F.desc("n"), "first_seq").limit(limit)
