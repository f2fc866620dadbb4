"""Array idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda over an array re-evaluates every captured expression per entry;
    a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def positions(array: Column) -> Column:
    """0-based positions of an array, empty for an empty array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(none)
