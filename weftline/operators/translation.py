"""Translation work sets, lookup, validation and routing.

The model itself is outside: results come from a translation memory, from a
table of attempts, or from a function the caller plugs in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.coerce import lines_of, strip
from weftline.functions.elements import (
    fence_count, is_code, is_heading, looks_protected,
)
from weftline.operators.rows import unpack

# Unit states and limits.
FINISHED = ("success", "skipped", "fallback_source")
MAX_ATTEMPTS = 10
ERROR_CHARS = 500
CHUNK_KEYS = ("doc_id", "chunk_id")
BATCH_BYTES = 4 << 20


def split_work(chunks: DataFrame, units: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = CHUNK_KEYS) -> tuple[DataFrame, DataFrame]:
    """Chunks to process, and finished output rows to reuse.

    Reuse needs a finished state and an output row; both sides are joins on
    the chunk key.
    """
    finished = units.filter(F.col("status").isin(*FINISHED)).select(*keys)
    reuse = outputs.join(finished, list(keys), "left_semi").join(chunks.select(*keys), list(keys), "left_semi")
    return chunks.join(reuse.select(*keys), list(keys), "left_anti"), reuse


def is_skipped(chunks: DataFrame) -> Column:
    return ~F.coalesce("translatable", F.lit(True)) | (F.coalesce("kind", F.lit("")) == "code")


def skipped_rows(chunks: DataFrame) -> DataFrame:
    """Chunks passed through untranslated: code and untranslatable ones."""
    return chunks.filter(is_skipped(chunks)).withColumns(
        {"translated_text": F.coalesce("source_text", F.lit("")), "status": F.lit("skipped"), "error": F.lit(None).cast("string")}
    )


def memory_lookup(chunks: DataFrame, memory: DataFrame) -> DataFrame:
    """Join known translations on the hash of the source text.

    Only hashes that chunks ask for are looked up: they are reduced to distinct
    ones, inside each task first, and meet the memory on even keys. The short
    list of hits then meets the chunks, where AQE splits a hot hash.
    """
    keyed = chunks.withColumn("source_sha256", F.sha2("source_text", 256))
    asked = keyed.select("source_sha256").distinct()
    known = memory.join(asked, "source_sha256", "left_semi").groupBy("source_sha256").agg(F.max_by("translated_text", "updated_at").alias("translated_text"))
    return keyed.join(known, "source_sha256", "left")


def plug_translate(chunks: DataFrame, translate: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Translate each distinct source text once with the caller's function.

    ``translate`` maps a batch of texts to a batch of results. A batch holds
    about ``BATCH_BYTES`` of text, whatever the number of rows Spark sends.
    """
    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Runs of rows with about ``BATCH_BYTES`` of text each; a longer text is a run of its own."""
        sizes = pc.fill_null(pc.binary_length(batch["source_text"]), 0).to_numpy(zero_copy_only=False).astype("int64")
        run = sizes.cumsum() // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for start, stop in zip(edges, edges[1:]):
            yield batch.slice(start, stop - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                made = pa.array(translate(piece["source_text"].to_pandas()), pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([piece["source_sha256"], made], names=["source_sha256", "translated_text"])

    texts = chunks.select(F.sha2("source_text", 256).alias("source_sha256"), "source_text").dropDuplicates(["source_sha256"])
    done = texts.mapInArrow(run, "source_sha256 string, translated_text string")
    return chunks.withColumn("source_sha256", F.sha2("source_text", 256)).join(done, "source_sha256", "left")


def _table_rows(text: Column) -> Column:
    return F.filter(lines_of(text), lambda s: F.startswith(strip(s), F.lit("|")))


def _pipes(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.size(F.split(r, r"\|", -1)) - 1)


def translation_error(source: Column, translated: Column, kind: Column) -> Column:
    """What is wrong with a translation; NULL when nothing is."""
    ours, theirs = _pipes(_table_rows(source)), _pipes(_table_rows(translated))
    return (
        F.when(strip(F.coalesce(translated, F.lit(""))) == "", "translated text is empty")
        .when(fence_count(source) != fence_count(translated), "code fence count changed")
        .when((kind == "table") & (F.size(ours) != F.size(theirs)), "markdown table row count changed")
        .when((kind == "table") & (ours != theirs), "markdown table column count changed")
    )


def settle_attempts(chunks: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = CHUNK_KEYS, max_attempts: int = MAX_ATTEMPTS,
                    error_chars: int = ERROR_CHARS) -> DataFrame:
    """First valid attempt per chunk, else the source text as fallback.

    Attempts carry ``attempt``, ``text`` and ``error``. The result has the
    translation columns plus the number of attempts used. Attempts numbered
    beyond ``max_attempts`` are not looked at (:func:`late_attempts` has them);
    errors are cut at ``error_chars``.
    """
    work = chunks.filter(~is_skipped(chunks))
    tried = attempts.filter(F.col("attempt") <= max_attempts).join(work.select(*keys, "source_text", "kind"), list(keys))
    wrong = F.coalesce(F.nullif(F.col("error"), F.lit("")), translation_error(F.col("source_text"), F.col("text"), F.col("kind")))
    judged = tried.withColumn("_wrong", F.substring(wrong, 1, error_chars))
    good = F.col("_wrong").isNull()
    best = judged.groupBy(*keys).agg(
        F.min(F.when(good, F.struct("attempt", "text"))).alias("_hit"),
        F.max_by("_wrong", "attempt").alias("_last_error"), F.max("attempt").alias("_last"),
    )
    hit = F.col("_hit").isNotNull()
    settled = work.join(best, list(keys), "left").select(
        *chunks.columns,
        F.when(hit, F.col("_hit.text")).otherwise(F.col("source_text")).alias("translated_text"),
        F.when(hit, "success").otherwise("fallback_source").alias("status"),
        F.when(~hit, F.coalesce("_last_error", F.lit("no attempt left"))).alias("error"),
        F.coalesce(F.col("_hit.attempt"), F.col("_last"), F.lit(0)).cast("int").alias("attempts"),
    )
    return settled.unionByName(skipped_rows(chunks).withColumn("attempts", F.lit(0)))


def late_attempts(attempts: DataFrame, keys: tuple[str, ...] = CHUNK_KEYS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(keys, late): how many attempts of a chunk come after the last one allowed."""
    return attempts.filter(F.col("attempt") > max_attempts).groupBy(*keys).agg(F.count(F.lit(1)).alias("late"))


def id_mismatches(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Ids that are missing, unknown, duplicated or whose source was changed."""
    digest = F.sha2("source_text", 256).alias("h")  # texts stay where they are
    ours = requested.select("request_id", "item_id", digest, F.lit(1).alias("q"), F.lit(0).alias("r"))
    theirs = returned.select("request_id", "item_id", digest, F.lit(0).alias("q"), F.lit(1).alias("r"))
    tally = ours.unionByName(theirs).groupBy("request_id", "item_id").agg(
        F.sum("q").alias("q"), F.sum("r").alias("r"),
        F.min("h").alias("low"), F.max("h").alias("high"),
    )
    problem = (
        F.when(F.col("q") == 0, "unknown id").when(F.col("r") == 0, "missing id")
        .when((F.col("q") > 1) | (F.col("r") > 1), "duplicate id").when(F.col("low") != F.col("high"), "source text changed")
    )
    return tally.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("request_id", "item_id", "problem")


# What a translation must carry over.
KEPT_SHAPES = {
    "url": r"https?://[^\s)>\"]+",
    "number": r"\d+(?:[.,]\d+)*",
    "unit": r"\d+(?:[.,]\d+)*\s?(?:%|ms|s|kg|g|km|m|cm|mm|GB|MB|KB|TB|GHz|MHz)\b",
    "code": r"`[^`]+`",
    "placeholder": r"\{[A-Za-z_][A-Za-z0-9_]*\}",
}


def lost_tokens(pairs: DataFrame, keys: tuple[str, ...] = CHUNK_KEYS) -> DataFrame:
    """(keys, token_kind, token, missing): URLs, numbers, units, code and placeholders the translation has less often than the source.

    Bags, not sets: one of two equal numbers may not vanish. A null
    translation has lost everything. Texts whose bags agree drop out in their
    row; only the tokens of the others are counted.
    """
    def tokens(text: str, shape: str) -> Column:
        return F.array_sort(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(shape), F.lit(0)))

    def signed(found: Column, name: str, sign: int) -> Column:
        return F.transform(found, lambda t: F.struct(F.lit(name).alias("token_kind"), t.alias("token"), F.lit(sign).cast("bigint").alias("n")))

    def both(name: str, shape: str) -> Column:
        pair = F.struct(tokens("source_text", shape).alias("a"), tokens("translated_text", shape).alias("b"))
        return let(pair, lambda p: F.when(p["a"] != p["b"], F.concat(signed(p["a"], name, 1), signed(p["b"], name, -1))).otherwise(
            F.array().cast("array<struct<token_kind:string,token:string,n:bigint>>")))

    rows = unpack(pairs, list(keys), F.concat(*[both(n, s) for n, s in KEPT_SHAPES.items()]))
    return rows.groupBy(*keys, "token_kind", "token").agg(F.sum("n").alias("missing")).filter("missing > 0")


def element_route(elements: DataFrame) -> DataFrame:
    """How each text element is rendered: code, heading or body."""
    code = is_code(F.col("label"), F.col("raw_text"))
    kind = F.when(strip(F.col("raw_text")) == "", "empty").when(code, "code").when(is_heading(F.col("label")), "heading")
    return elements.filter(F.col("grp") == "texts").withColumn("route", kind.otherwise("body"))


def routed_text(route: Column, source: Column, translated: Column) -> Column:
    """Code stays, headings become ``source / translation``, body is replaced."""
    both = F.concat(source, F.lit(" / "), F.coalesce(translated, F.lit("")))
    return F.when(route.isin("heading", "caption"), both).when(route == "body", F.coalesce(translated, F.lit(""))).otherwise(source)


def translate_elements(elements: DataFrame, memory: DataFrame) -> DataFrame:
    """Text elements with ``render_text`` from the translation memory."""
    routed = element_route(elements).withColumn("source_text", strip(F.col("raw_text")))
    looked = memory_lookup(routed.filter(F.col("route").isin("heading", "body")), memory)
    done = looked.drop("source_sha256")
    kept = routed.filter(~F.col("route").isin("heading", "body")).withColumn("translated_text", F.lit(None).cast("string"))
    both = done.unionByName(kept)
    return both.withColumn("render_text", routed_text(F.col("route"), F.col("source_text"), F.col("translated_text")))


def cell_route(cells: DataFrame) -> DataFrame:
    """Cells that stay as they are and cells to translate."""
    source = strip(F.coalesce("text", F.lit("")))
    route = F.when(source == "", "empty").when(looks_protected(source), "protected").otherwise("body")
    return cells.withColumn("source_text", source).withColumn("route", route)


def translate_cells(cells: DataFrame, memory: DataFrame) -> DataFrame:
    routed = cell_route(cells)
    body = memory_lookup(routed.filter(F.col("route") == "body"), memory).drop("source_sha256")
    kept = routed.filter(F.col("route") != "body").withColumn("translated_text", F.lit(None).cast("string"))
    both = body.unionByName(kept)
    return both.withColumn("render_text", routed_text(F.col("route"), F.col("source_text"), F.col("translated_text")))
