import pathlib
import sys

import pytest
from pyspark.sql import types as T

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent), str(pathlib.Path(__file__).resolve().parents[1])]

from llm_inputs import CLASHING, LONG  # noqa: E402


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "en", None),
        (5, LONG, "la", "b"), (6, "The quick brown fox jumps over the lazy dog again and again today", "en", ""), (None, "no id here at all", "en", "a"),
        (7, "12345 !!! ###", "en", "c"), (8, "Ünïcödé 中文 🦖 text\nwith lines\n\nand one more", None, "c"), (9, "repeated row of text", "en", "c"), (9, "repeated row of text", "en", "c"),
    ]
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], T.StructField("n_chars", T.LongType())]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASHING])
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in texts], schema)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)
