"""Arrays of structs to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack(df: DataFrame, keep: list[str | Column], array: Column, position: str | None = None,
           item: str | None = None) -> DataFrame:
    """One row per array entry: ``keep``, its position and its fields.

    With ``item`` the entry itself is kept under that name. The outer form is
    used and empty arrays are dropped afterwards: for the plain form the
    optimizer adds a size test below the generator that computes a derived
    array three times over.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_at", "_entry")).filter(F.col("_at").isNotNull())
    kept = rows.columns[: -2]
    place = [F.col("_at").alias(position)] if position else []
    return rows.select(*kept, *place, F.col("_entry").alias(item) if item else "_entry.*")
