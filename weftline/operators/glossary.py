"""Glossary normalisation and matching."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.coerce import strip
from weftline.operators.matching import BLOCK_CHARS, TermIndex, term_hits
from weftline.operators.rows import unpack

# Glossary columns and prompt texts.
COLUMNS = ("english", "japanese", "genre", "description")
NO_TERMS = "なし"
MATCH_LIMIT = 80
SYSTEM_PROMPT = (
    "あなたは軍事・政策文書に強い日英翻訳者です。"
    "原文の意味を保持し、Markdown 構造を壊さず、日本語へ翻訳してください。"
    "原文にない説明、要約、事実追加は禁止です。"
)
USER_PROMPT_HEAD = """次の Markdown 断片を日本語へ翻訳してください。

厳守事項:
- 見出し記号、箇条書き、表、リンク、画像参照、コード fence を維持する。
- コード、URL、環境変数、ファイルパス、コマンドは翻訳しない。
- 表の列数、区切り行、セル数を維持する。
- 辞書は訳語統一のためだけに使い、原文にない語を追加しない。
- 出力は翻訳済み Markdown 本文だけにする。

用語辞書:
"""
USER_PROMPT_MIDDLE = "\n\n原文:\n"


def trimmed_entries(raw: DataFrame) -> DataFrame:
    """Trimmed rows; rows that are blank throughout are left out."""
    cols = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS}
    trimmed = raw.withColumns(cols)
    return trimmed.filter(F.concat(*COLUMNS) != "")


def entry_problems(raw: DataFrame) -> DataFrame:
    """Entries without a term or without its translation."""
    return trimmed_entries(raw).filter((F.col("english") == "") | (F.col("japanese") == ""))


def effective_entries(raw: DataFrame) -> DataFrame:
    """One entry per term: the last one given wins.

    Entries without a term or a translation are left out; ``entry_problems``
    reports them.
    """
    usable = trimmed_entries(raw).filter((F.col("english") != "") & (F.col("japanese") != ""))
    best = usable.groupBy("english").agg(
        F.max_by(F.struct("japanese", "genre", "description"), "seq").alias("e")
    )
    return best.select("english", "e.*")


def entry_counts(raw: DataFrame) -> DataFrame:
    """Raw and effective entry counts. One shuffle on the term."""
    per_term = trimmed_entries(raw).groupBy("english").agg(F.count(F.lit(1)).alias("n"))
    return per_term.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_count"), F.count(F.lit(1)).alias("effective_count")
    )


def matches(chunks: DataFrame, entries: DataFrame, text: str = "source_text",
            keys: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """Entries whose term occurs in a chunk, ignoring case.

    ``keys`` identify a chunk; see :func:`weftline.operators.matching.term_hits`.
    """
    lowered = chunks.select(*keys, F.lower(text).alias("_lowered"))
    terms = entries.select("english", F.lower("english").alias("_t"))
    hits = term_hits(lowered, terms, "_lowered", "_t", keys)
    # terms that differ by case only are several entries with one lower-case form
    small = (terms.agg(F.sum(F.length("english") + F.length("_t"))).first()[0] or 0) <= 2 * BLOCK_CHARS
    return hits.join(F.broadcast(terms) if small else terms, "_t").select(*keys, "english")


FIELDS = ("english", *COLUMNS[1:])
_ENTRIES = f"array<struct<{','.join(f'{c}:string' for c in FIELDS)}>>"


def _entries_in(lowered: Column, block: DataFrame, limit: int) -> Column:
    """The first ``limit`` entries of a block, by term, whose lower-case term occurs in a text."""
    rows = [tuple(r) for r in block.collect()]  # a block is bounded
    made: list[tuple[TermIndex, dict[str, list[tuple]]]] = []

    @F.arrow_udf(_ENTRIES)
    def found(values: pa.Array) -> pa.Array:
        if not made:
            by_term: dict[str, list[tuple]] = {}
            for term, *entry in rows:
                by_term.setdefault(term, []).append(tuple(entry))
            made.append((TermIndex(list(by_term)), by_term))
        index, by_term = made[0]
        hits = (sorted((e for t in index.hits(v or "") for e in by_term[t]), key=lambda e: [(p is not None, p or "") for p in e])[:limit] for v in values.to_pylist())
        kind = pa.list_(pa.struct([(c, pa.string()) for c in FIELDS]))
        return pa.array([[dict(zip(FIELDS, e, strict=True)) for e in found] for found in hits], kind)

    return found(lowered)


def entry_arrays(chunks: DataFrame, entries: DataFrame, limit: int = MATCH_LIMIT, text: str = "source_text",
                 keys: tuple[str, ...] = ("doc_id", "chunk_no"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``chunks`` with the selected entries of each (see :func:`select_entries`) in an array ``_entries``, in order.

    The entries travel to the tasks, so their characters are counted first. Up
    to ``block_chars`` everything happens inside the chunk's own row; a longer
    glossary goes block by block, and the first ``limit`` matches of a chunk in
    each block meet under its keys.
    """
    known = entries.select(F.lower("english").alias("_t"), *[F.col(c).cast("string").alias(c) for c in FIELDS]).filter("_t <> ''")
    chars = known.agg(F.sum(F.length(F.concat_ws("", "_t", *FIELDS)))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    none, lowered = F.array().cast(_ENTRIES), F.lower(text)
    if blocks == 1:
        matched = chunks.withColumn("_hits", _entries_in(lowered, known, limit))
    else:
        parts = [known.filter(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == b) for b in range(blocks)]
        hits = reduce(DataFrame.unionByName, [chunks.select(*keys, _entries_in(lowered, p, limit).alias("_hits")) for p in parts])
        first = hits.filter(F.size("_hits") > 0).groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_hits"))), 1, limit).alias("_hits"))
        matched = chunks.join(first, list(keys), "left").withColumn("_hits", F.coalesce("_hits", none))
    head = known.select(*FIELDS).orderBy("english").limit(2 * limit).collect()
    pool = F.array(*[F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in FIELDS]) for r in head]) if head else none
    taken = F.transform("_hits", lambda h: h["english"])
    room = F.lit(limit) - F.size("_hits")
    filler = F.when(room > 0, F.slice(F.filter(pool, lambda e: ~F.array_contains(taken, e["english"])), F.lit(1), F.greatest(room, F.lit(0)))).otherwise(none)

    def numbered(found: Column, matched: bool, before: Column) -> Column:
        return F.transform(found, lambda e, i: F.struct(
            *[e[c].alias(c) for c in FIELDS], (before + i + 1).cast("int").alias("rank"), F.lit(matched).alias("matched")))

    return matched.withColumn("_entries", F.concat(numbered(F.col("_hits"), True, F.lit(0)), numbered(filler, False, F.size("_hits")))).drop("_hits")


def select_entries(chunks: DataFrame, entries: DataFrame, limit: int = MATCH_LIMIT, text: str = "source_text",
                   keys: tuple[str, ...] = ("doc_id", "chunk_no"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per chunk, matching entries first, filled with others up to ``limit``.

    The filler of any chunk lies among the first ``2 * limit`` entries overall,
    which travel as a literal array; it is picked inside the chunk's own row.
    """
    return unpack(entry_arrays(chunks, entries, limit, text, keys, block_chars), list(keys), F.col("_entries"))


def entry_line(entry: Column | None = None) -> Column:
    """``- term => translation / genre / description``; empty parts drop out."""
    part = lambda c: F.col(c) if entry is None else entry[c]
    detail = [F.when(part(c) != "", F.concat(F.lit(" / "), part(c))).otherwise("") for c in ("genre", "description")]
    return F.concat(F.lit("- "), part("english"), F.lit(" => "), part("japanese"), *detail)


def prompt_terms(selected: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """Glossary text per chunk; at most the selection limit of lines each."""
    lines = F.array_sort(F.collect_list(F.struct("rank", entry_line().alias("line"))))
    return selected.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("glossary_text"))


def with_prompt_terms(chunks: DataFrame, entries: DataFrame, limit: int = MATCH_LIMIT, text: str = "source_text",
                      keys: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """``chunks`` with the glossary text of each, NULL without entries: ``prompt_terms`` of ``select_entries``, made inside the row."""
    lines = F.transform("_entries", lambda e: entry_line(e))
    made = entry_arrays(chunks, entries, limit, text, keys)
    return made.withColumn("glossary_text", F.when(F.size("_entries") > 0, F.array_join(lines, "\n"))).drop("_entries")


def translation_messages(chunks: DataFrame, terms: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """System and user message per chunk; without ``terms`` the chunks have their ``glossary_text``."""
    user = F.concat(
        F.lit(USER_PROMPT_HEAD), F.coalesce("glossary_text", F.lit(NO_TERMS)),
        F.lit(USER_PROMPT_MIDDLE), F.col("source_text"), F.lit("\n"),
    )
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    told = chunks.join(terms, list(keys), "left") if terms is not None else chunks
    return told.select(*keys, messages.alias("messages"))
