"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import activity_queries, chunk_queries, element_queries, news_queries, patch_queries, render_queries, source_queries, state_queries

FAMILIES = (activity_queries, news_queries, element_queries, patch_queries, chunk_queries, render_queries, source_queries, state_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    merged: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        merged.update(family.Q)
    return merged


def oracle_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for family in FAMILIES:
        merged.update(family.SQL)
    return merged
