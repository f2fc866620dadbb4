"""Secret masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.matching import replace_terms

# Secret shapes and what replaces them.
SECRET_PATTERNS = (
    (r"sk-[A-Za-z0-9_\-]{8,}", "***"),
    (r"(?iU)(authorization:\s*bearer\s+)\S+", "$1***"),
    (r"(?iU)(x-api-key:\s*)\S+", "$1***"),
)
KNOWN_SECRET_MARK = "[REDACTED]"


def mask_secrets(col: Column) -> Column:
    """Mask API keys and credential headers; header names stay readable."""
    return reduce(lambda text, rule: F.regexp_replace(text, rule[0], rule[1]), SECRET_PATTERNS, col.cast("string"))


def mask_string_fields(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mask every top-level STRING column of an event table."""
    masked = {name: mask_secrets(F.col(name)) for name, dtype in df.dtypes if dtype == "string" and name not in keep}
    return df.withColumns(masked) if masked else df


def redact_known(col: Column, *secrets: str) -> Column:
    """Replace literal secrets known to the caller."""
    return reduce(
        lambda text, secret: F.replace(text, F.lit(secret), F.lit(KNOWN_SECRET_MARK)),
        [s for s in secrets if s],
        col.cast("string"),
    )


def redact_table(df: DataFrame, text: str, secrets: DataFrame, secret: str, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with the literal secrets of a table replaced in ``text``, longest first; ``keys`` identify a row.

    The result is that of replacing one secret after another over the whole
    table of them (see :func:`weftline.operators.matching.replace_terms`), and
    marks already put in are never searched. Equal lengths go in code point
    order. Null and empty secrets replace nothing. Texts stay where they are,
    so ``keys`` are not needed to find a row again.
    """
    return replace_terms(df, secrets, text, secret, KNOWN_SECRET_MARK).select(*df.columns)
