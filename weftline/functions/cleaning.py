"""Text cleanup that leaves URLs alone, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.coerce import strip

# The URL shape and the noise runs with what they shrink to.
URL_PATTERN = r"https?://[^\s)>\"]+"
_URL = '(?U)' + URL_PATTERN
DOT_RUN = (r"\.{4,}", "...")
MIDDLE_DOT_RUN = (r"・{4,}", "・・・")
DASH_RUN = (r"[‐‑‒–—―-]{4,}", "---")
RULE_RUN = (r"([_=~*])\1{5,}", "$1$1$1")
# a single space is its own result and needs no replacement
BLANK_RUN = (r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")
NEWLINE_RUN = (r"\n{3,}", "\n\n")

CLEANUP_RULES = (DOT_RUN, MIDDLE_DOT_RUN, DASH_RUN, RULE_RUN, BLANK_RUN, NEWLINE_RUN)
NORMALIZE_RULES = (DOT_RUN, DASH_RUN, RULE_RUN, BLANK_RUN, NEWLINE_RUN)


def _shrink(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _shrink_outside_urls(col: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Split at URLs, shrink the gaps, put the URLs back in their places.

    Texts without a URL, nearly all of them, skip the splitting.
    """
    gaps = F.split(col, _URL, -1)
    urls = F.regexp_extract_all(col, F.lit(_URL), F.lit(0))
    tails = F.concat(urls, F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, tails, lambda gap, url: F.concat(_shrink(gap, rules), url)), "")
    return F.when(F.contains(col, F.lit("://")), joined).otherwise(_shrink(col, rules))


def clean_text(col: Column) -> Column:
    """Shrink runs of dots, dashes, rules and blanks; URLs stay as they are."""
    return _shrink_outside_urls(col, CLEANUP_RULES)


def normalize_text(col: Column) -> Column:
    """Like :func:`clean_text` without the middle-dot rule, then trimmed."""
    return strip(_shrink_outside_urls(col, NORMALIZE_RULES))


def is_symbol_only(col: Column) -> Column:
    """Cell made of dots, ellipses and dashes only."""
    return strip(col).rlike(r"^[.…‐‑‒–—―-]+$")


def blank_symbol_cell(col: Column) -> Column:
    return F.when(is_symbol_only(col), F.lit("")).otherwise(col)


def repair_hyphenation(col: Column) -> Column:
    """Join a word broken by a hyphen at a line end (lower case on both sides)."""
    return F.regexp_replace(col, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
