"""Glossary CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.coerce import strip
from weftline.operators.glossary import COLUMNS


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a glossary CSV with ``seq`` in file order.

    Header names and values are trimmed, a byte order mark is dropped, and a
    missing column is an error.
    """
    raw = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    names = [n.lstrip("﻿").strip().strip('"') for n in raw.columns]
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ValueError(f"glossary CSV missing columns {missing}: {path}")
    # a CSV read with multiLine is one task per file, so ids follow the rows
    rows = raw.toDF(*names).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("seq", *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])
