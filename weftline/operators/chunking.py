"""Size-bounded chunks with heading paths.

Packing is sequential inside a document. A document held in one row is packed
and assembled in that row. A document spread over an element table is packed by
segments of at most ``segment_rows`` consecutive elements: each segment first
reports, for every state it could be entered in, the state it leaves behind;
those short reports are chained per document, and then all segments are packed
at once from their entry states. Both ways give the same chunks.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.elements import (
    chunk_kind, fence_count, fenced, heading_level, heading_markdown, is_code_label, is_heading, table_markdown,
)
from weftline.functions.coerce import strip
from weftline.operators.elements import matrix_of
from weftline.operators.ordering import segmented_last
from weftline.operators.rows import unpack

SEGMENT_ROWS = 4096
MIN_CHARS, MAX_CHARS = 1000, 2000
MAX_LEVEL = 6
# Block codes: body text, heading, stands alone (table, code, html, image), body text that looks like a heading.
BODY, HEADING, ALONE, LOOKALIKE = 0, 1, 2, 3
HEADING_LOOK = r"^#{1,6}\s"


def render_block(element: Column) -> Column:
    """Markdown of an element as chunk input; empty means it is left out."""
    label, text = element["label"], element["text"]
    prose = (
        F.when(text == "", "").when(is_heading(label), heading_markdown(heading_level(element["level"], label), text))
        .when(is_code_label(label), fenced(text)).otherwise(text)
    )
    table = F.coalesce(table_markdown(matrix_of(F.coalesce(element["grid"], element["cells"]))), text)
    return F.when(element["grp"] == "tables", table).otherwise(prose)


def _block(element: Column) -> Column:
    kind = chunk_kind(element["grp"], element["label"])
    code = lambda md: (
        F.when(kind != "text", ALONE).when(is_heading(element["label"]), HEADING).when(md.rlike(HEADING_LOOK), LOOKALIKE).otherwise(BODY)
    )
    return let(render_block(element), lambda md: F.struct(
        md.alias("md"), kind.alias("kind"), code(md).cast("tinyint").alias("code"),
        heading_level(element["level"], element["label"]).alias("level"),
        element["ref"].alias("ref"), element["pages"].alias("pages"), element["assets"].alias("assets"),
    ))


def _blocks(elements: str | Column) -> Column:
    return F.filter(F.transform(elements, _block), lambda b: b["md"] != "")


def block_segments(arrays: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Element arrays as rendered blocks, cut into segments. No shuffle."""
    def cut(blocks: Column) -> Column:
        last = F.greatest(F.ceil(F.size(blocks) / segment_rows).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda s: F.struct(s.alias("seg"), F.slice(blocks, s * segment_rows + 1, F.lit(segment_rows)).alias("blocks")),
        )

    return unpack(arrays, ["doc_id"], let(_blocks("elements"), cut))


def gather_segments(elements: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments from an element table (``pos`` in reading order).

    Groups by (document, segment), so no group outgrows a segment.
    """
    fields = ["grp", "idx", "ref", "label", "text", "level", "pages", "assets", "cells", "grid"]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("e"))))
    grouped = elements.groupBy("doc_id", F.floor(F.col("pos") / segment_rows).cast("int").alias("seg")).agg(
        rows.alias("_rows")
    )
    return grouped.select("doc_id", "seg", F.filter(F.transform("_rows", lambda r: _block(r["e"])), lambda b: b["md"] != "").alias("blocks"))


def _cut(codes: list, sizes: list, levels: list, heads: list, pending: int, opened: int, path: list,
         low: int, high: int) -> list[dict]:
    """Chunk pieces of one segment: block range, chunk number, path at closing.

    ``pending`` characters of chunk number ``opened`` may be carried in; that
    chunk then has a piece here, even an empty one, as this is where it closes.
    The path moves to a heading before that heading closes the chunk ahead. A
    block that looks like a heading never closes its chunk, however long.
    """
    pieces: list[dict] = []
    path, number, first = list(path or []), opened, 0 if pending else None

    def emit(start: int, stop: int) -> None:
        pieces.append({"first": start, "blocks": stop - start, "chunk_no": number, "path": path})

    for at, (code, size) in enumerate(zip(codes, sizes)):
        if code == HEADING:
            path = path[: levels[at] - 1] + [heads[at]]
        closes = code == ALONE or (code == HEADING and pending >= low)
        if first is not None and closes:
            emit(first, at)
            first, pending = None, 0
        if first is None:
            number, first = number + 1, at
        pending += size
        if code == ALONE or (code == BODY and pending >= high):
            emit(first, at + 1)
            first, pending = None, 0
    if first is not None:
        emit(first, len(codes))
    return pieces


def _leave_states(codes: list, sizes: list, low: int, high: int) -> tuple[list, list, list]:
    """Pending size left and chunks opened, for every pending size on entry.

    Given as runs of entry sizes: first size, size left, chunks opened.

    Sizes beyond the larger bound behave alike, so there are finitely many
    entry states; states that fall together are followed as one.
    """
    top = max(low, high)
    where, states = np.arange(top + 1), np.stack([np.arange(top + 1), np.zeros(top + 1, dtype=np.int64)])
    for code, size in zip(codes, sizes):
        pending, opened = states
        if code == ALONE:
            states = np.stack([np.zeros_like(pending), opened + 1])
        else:
            if code == HEADING:
                pending = np.where(pending >= low, 0, pending)
            opened = opened + (pending == 0)
            pending = np.minimum(pending + size, top)
            states = np.stack([np.where(pending >= high, 0, pending) if code == BODY else pending, opened])
        if states.shape[1] > 1:
            _, kept, inverse = np.unique(states[0] + states[1] * (top + 1), return_index=True, return_inverse=True)
            if kept.size < states.shape[1]:
                states, where = states[:, kept], inverse[where]
    # runs of entry sizes with one outcome; a segment of usual length has one run
    first = np.flatnonzero(np.diff(where, prepend=-1))
    return first.tolist(), states[0][where[first]].tolist(), states[1][where[first]].tolist()


def _leave_paths(codes: list, levels: list, heads: list) -> tuple[list, list]:
    """Entries kept and headings added, for every path length on entry."""
    states = [(length, []) for length in range(MAX_LEVEL + 1)]
    for code, level, head in zip(codes, levels, heads):
        if code == HEADING:
            states = [(min(kept, level - 1), added[: max(0, level - 1 - kept)] + [head]) for kept, added in states]
    return [kept for kept, _ in states], [added for _, added in states]


def _cut_udf(low: int, high: int):
    @F.arrow_udf(_PIECE_LIST)
    def cut(codes: pa.Array, sizes: pa.Array, levels: pa.Array, heads: pa.Array,
            pending: pa.Array, opened: pa.Array, path: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (codes, sizes, levels, heads, pending, opened, path)))
        return pa.array([_cut(*row, low, high) for row in rows], type=_PIECES)
    return cut


def _report_udf(low: int, high: int):
    @F.arrow_udf(_REPORT_SCHEMA)
    def report(codes: pa.Array, sizes: pa.Array, levels: pa.Array, heads: pa.Array) -> pa.Array:
        out = []
        for c, s, l, h in zip(*(col.to_pylist() for col in (codes, sizes, levels, heads))):
            first, left, opened = _leave_states(c, s, low, high)
            kept, added = _leave_paths(c, l, h)
            out.append({"first": first, "left": left, "opened": opened, "kept": kept, "added": added})
        return pa.array(out, type=_REPORT)
    return report


_PIECE_LIST = "array<struct<first:int,blocks:int,chunk_no:bigint,path:array<string>>>"
_PIECES = pa.list_(pa.struct([
    ("first", pa.int32()), ("blocks", pa.int32()), ("chunk_no", pa.int64()), ("path", pa.list_(pa.string())),
]))
_REPORT_SCHEMA = "struct<first:array<int>,left:array<int>,opened:array<bigint>,kept:array<int>,added:array<array<string>>>"
_REPORT = pa.struct([
    ("first", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("opened", pa.list_(pa.int64())),
    ("kept", pa.list_(pa.int32())), ("added", pa.list_(pa.list_(pa.string()))),
])


def _chain(reports: pd.DataFrame) -> pd.DataFrame:
    """Entry state of every segment of one document, from the reports."""
    pending, opened, path, rows = 0, 0, [], []
    for doc_id, seg, r in reports.sort_values("seg")[["doc_id", "seg", "report"]].itertuples(index=False):
        rows.append((doc_id, seg, pending, opened, path))
        run = np.searchsorted(r["first"], pending, side="right") - 1
        pending, opened = int(r["left"][run]), opened + int(r["opened"][run])
        path = list(path[: r["kept"][len(path)]]) + list(r["added"][len(path)])
    return pd.DataFrame(rows, columns=["doc_id", "seg", "pending", "opened", "path"])


def _packing_columns() -> list[Column]:
    """What the packer needs of the blocks: no body text leaves the JVM."""
    heads = F.transform("blocks", lambda b: F.when(b["code"] == HEADING, b["md"]))
    return [
        F.transform("blocks", lambda b: b["code"]), F.transform("blocks", lambda b: F.length(b["md"])),
        F.transform("blocks", lambda b: b["level"]), heads,
    ]


def _piece_rows(packed: DataFrame) -> DataFrame:
    """Pieces with their texts, refs, pages and assets, taken inside the row."""
    def piece(blocks: Column, p: Column) -> Column:
        return let(
            F.slice(blocks, p["first"] + 1, p["blocks"]),
            lambda mine: F.struct(
                p["chunk_no"].alias("chunk_no"), p["path"].alias("header_path"),
                F.get(mine, F.lit(0))["kind"].alias("kind"),
                F.transform(mine, lambda b: b["md"]).alias("texts"),
                F.transform(mine, lambda b: b["ref"]).alias("refs"),
                F.flatten(F.transform(mine, lambda b: b["pages"])).alias("pages"),
                F.flatten(F.transform(mine, lambda b: b["assets"])).alias("assets"),
            ),
        )

    built = let(F.col("blocks"), lambda blocks: F.transform("pieces", lambda p: piece(blocks, p)))
    return unpack(packed, ["doc_id", "seg"], built)


def _finish(pieces: DataFrame) -> DataFrame:
    """Chunk rows from complete piece lists."""
    text = strip(F.array_join("texts", "\n\n"))
    return pieces.select(
        "doc_id", "chunk_no", F.format_string("chunk-%04d", "chunk_no").alias("chunk_id"), "kind", "header_path",
        text.alias("source_text"), (F.col("kind") != "code").alias("translatable"),
        F.length(text).alias("char_count"), F.col("refs").alias("source_node_refs"),
        F.array_sort(F.array_distinct("pages")).alias("page_numbers"), F.array_distinct("assets").alias("assets"),
    )


def pack_whole(documents: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunk table of documents held in one row each (``doc_id``, ``blocks``)."""
    start = [F.lit(0), F.lit(0).cast("bigint"), F.array().cast("array<string>")]
    cut = _cut_udf(min_chars, max_chars)
    rows = documents.select("doc_id", F.lit(0).alias("seg"), "blocks", cut(*_packing_columns(), *start).alias("pieces"))
    return _finish(_piece_rows(rows))


def pack_segments(segments: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunk table of documents cut into segments (``doc_id``, ``seg``, ``blocks``)."""
    long = segments.select("doc_id", "seg", "blocks")
    cut = _cut_udf(min_chars, max_chars)
    # documents of one segment start from nothing and need no reports
    several = long.filter(F.col("seg") > 0).select("doc_id").distinct()
    reports = long.join(several, "doc_id", "left_semi").select("doc_id", "seg", _report_udf(min_chars, max_chars)(*_packing_columns()).alias("report"))
    entry = reports.groupBy("doc_id").applyInPandas(
        _chain,
        f"doc_id {dict(segments.dtypes)['doc_id']}, seg int, pending int, opened bigint, path array<string>",
    )
    state = [F.coalesce("pending", F.lit(0)), F.coalesce("opened", F.lit(0).cast("bigint")), F.coalesce("path", F.array().cast("array<string>"))]
    packed = long.join(entry, ["doc_id", "seg"], "left").withColumn("pieces", cut(*_packing_columns(), *state))
    # only a chunk that crosses a segment edge has several pieces
    pieces = _piece_rows(packed).groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("seg", "kind", "texts", "refs", "pages", "assets", "header_path"))).alias("p")
    )

    def joined(field: str) -> Column:
        return F.flatten(F.transform("p", lambda x: x[field])).alias(field)

    merged = pieces.select(
        "doc_id", "chunk_no", F.element_at("p", -1)["header_path"].alias("header_path"),
        F.get("p", F.lit(0))["kind"].alias("kind"),
        *[joined(field) for field in ("texts", "refs", "pages", "assets")],
    )
    return _finish(merged)


def build_chunks(arrays: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS,
                 segment_rows: int | None = None) -> DataFrame:
    """Chunks of documents held as element arrays.

    Such a document is in one task already, so by default it is packed there:
    one read and no shuffle. With ``segment_rows`` it is cut up and spread.
    """
    if segment_rows is None:
        return pack_whole(arrays.select("doc_id", _blocks("elements").alias("blocks")), min_chars, max_chars)
    return pack_segments(block_segments(arrays, segment_rows), min_chars, max_chars)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """Broken chunk constraints, one row each."""
    twice = chunks.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    broken = F.filter(
        F.array(
            F.when(F.col("translatable") & (strip(F.col("source_text")) == ""), "empty translatable chunk"),
            F.when(F.size("source_node_refs") == 0, "empty source_node_refs"),
            F.when(fence_count(F.col("source_text")) % 2 == 1, "unclosed code fence"),
        ),
        lambda reason: reason.isNotNull(),
    )
    rows = unpack(chunks, ["doc_id", "chunk_id"], broken, item="violation")
    return rows.unionByName(twice.select("doc_id", "chunk_id", F.lit("duplicate chunk_id").alias("violation")))


def heading_tails(chunks: DataFrame) -> DataFrame:
    """Chunks that end with a heading although another chunk follows.

    Every chunk also reports its kind to the chunk before it; grouping by
    position brings both together with one shuffle and one read.
    """
    tail = F.col("source_text").rlike(r"(^|\n)#{1,6} [^\n]*\z")
    notes = F.array(
        F.struct(F.col("chunk_no").alias("no"), F.when(tail, F.col("chunk_id")).alias("chunk_id"), F.lit(None).cast("string").alias("next_kind")),
        F.struct((F.col("chunk_no") - 1).alias("no"), F.lit(None).cast("string").alias("chunk_id"), F.col("kind").alias("next_kind")),
    )
    told = unpack(chunks, ["doc_id"], notes).groupBy("doc_id", F.col("no").alias("chunk_no")).agg(
        F.max("chunk_id").alias("chunk_id"), F.max("next_kind").alias("next_kind")
    )
    return told.filter(F.col("chunk_id").isNotNull() & F.col("next_kind").isNotNull())


def section_items(elements: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Elements with the section they belong to, for translation by section.

    The heading is carried forward in bounded segments; every item keeps its
    id. Rows that share (doc_id, section_pos) form one request.
    """
    head = F.when(is_heading(F.col("label")), F.struct(F.col("pos").alias("p"), F.col("text").alias("t")))
    marked = segmented_last(elements, ["doc_id"], "pos", {"_head": head}, segment_rows=segment_rows)
    return marked.filter((F.col("text") != "") & ~is_heading(F.col("label"))).select(
        "doc_id", F.coalesce("_head.p", F.lit(-1)).alias("section_pos"),
        F.coalesce("_head.t", F.lit("")).alias("section_title"), "pos", F.col("ref").alias("item_id"), "text",
    )


# Fixed value: characters of a translation request; what one prompt holds.
REQUEST_CHARS = 4000


def _packed(sizes: list[int], limit: int, filled: int) -> tuple[list[int], int]:
    """Next-fit: how many requests were begun before each item's own, and the fill after the last; an empty request is never closed."""
    opened, numbers = 0, []
    for size in sizes:
        if filled and filled + size > limit:
            opened, filled = opened + 1, 0
        filled += size
        numbers.append(opened)
    return numbers, filled


def _breaks(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """For every item at which a segment may first break: the characters up to it, and the requests begun and the fill from there to the end."""
    n = len(sizes)
    upto = [0, *itertools.accumulate(sizes)]
    opened, filled = [1] * n, [0] * n
    for i in range(n - 1, -1, -1):
        # the first item that no longer fits after item i; sizes may be zero, so the sums need not grow
        j = max(bisect.bisect_right(upto, upto[i] + limit) - 1, i + 1)
        opened[i] = 1 if j >= n else 1 + opened[j]
        filled[i] = upto[n] - upto[i] if j >= n else filled[j]
    return upto[1:], opened, filled


def _carried(segments: list, limit: int) -> list[tuple[int, int]]:
    """(fill, requests begun) with which each segment of a section is entered."""
    filled = number = 0
    out = []
    for upto, opened, ends in segments:
        out.append((filled, number))
        at = 0 if filled and upto and filled + upto[0] > limit else bisect.bisect_right(upto, limit - filled)
        if not filled and upto and upto[0] > limit:  # an item over the limit fills an empty request by itself
            at = 1
        if at < len(upto):
            filled, number = ends[at], number + opened[at]
        else:
            filled += upto[-1]
    return out


def translation_requests(elements: DataFrame, limit: int = REQUEST_CHARS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Bounded translation requests: (doc_id, section_pos, request_no, document_title, section_title, chars, items).

    The items of a section (see :func:`section_items`) are packed in order,
    each into the open request if it still fits ``limit`` characters, else
    into a new one; an item over the limit is a request of its own. ``items``
    holds ids and texts, so every id stays with its text; the document title is
    the first element labelled ``title``. A section is packed in segments of
    ``segment_rows`` positions: each reports, for every item at which it may
    first break, the requests and the fill it ends with, and the segments of a
    section are entered accordingly. Requests do not depend on the segments.
    """
    items = section_items(elements, segment_rows).withColumns({c: F.col(c).cast("bigint") for c in ("section_pos", "pos")})
    sized = items.select("doc_id", "section_pos", F.floor(F.col("pos") / segment_rows).alias("seg"), "pos", F.length("text").alias("size"))
    segment = sized.groupBy("doc_id", "section_pos", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("rows"))
    segment = segment.select("doc_id", "section_pos", "seg", F.transform("rows", lambda r: r["pos"]).alias("at"), F.transform("rows", lambda r: r["size"]).alias("sizes"))
    doc_type = elements.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_breaks(sizes, limit) for sizes in batch["sizes"].to_pylist()]
            lists = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["section_pos"], batch["seg"], *lists], names=["doc_id", "section_pos", "seg", "upto", "opened", "ends"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_carried([(s["upto"], s["opened"], s["ends"]) for s in parts], limit) for parts in batch["parts"].to_pylist()]
            entered = [[{"seg": s["seg"], "fill": f, "number": n} for s, (f, n) in zip(parts, e, strict=True)] for parts, e in zip(batch["parts"].to_pylist(), found, strict=True)]
            kind = pa.list_(pa.struct([("seg", pa.int64()), ("fill", pa.int64()), ("number", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["section_pos"], pa.array(entered, kind)], names=["doc_id", "section_pos", "entered"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled, before = (batch[c].to_pylist() for c in ("fill", "number"))
            made = [[n + b for n in _packed(sizes, limit, f)[0]] for sizes, f, b in zip(batch["sizes"].to_pylist(), filled, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["at"], pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "at", "numbers"])

    # only sections of several segments have anything to carry
    several = segment.groupBy("doc_id", "section_pos").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    reports = segment.join(several, ["doc_id", "section_pos"], "left_semi").select("doc_id", "section_pos", "seg", "sizes").mapInArrow(
        report, f"doc_id {doc_type}, section_pos bigint, seg bigint, upto array<bigint>, opened array<bigint>, ends array<bigint>")
    parts = reports.groupBy("doc_id", "section_pos").agg(F.array_sort(F.collect_list(F.struct("seg", "upto", "opened", "ends"))).alias("parts"))
    entered = parts.mapInArrow(carry, f"doc_id {doc_type}, section_pos bigint, entered array<struct<seg:bigint,fill:bigint,number:bigint>>")
    entered = unpack(entered, ["doc_id", "section_pos"], F.col("entered"))
    known = segment.join(entered, ["doc_id", "section_pos", "seg"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("fill", "number")})
    numbers = known.select("doc_id", "at", "sizes", "fill", "number").mapInArrow(number, f"doc_id {doc_type}, at array<bigint>, numbers array<bigint>")
    numbered = unpack(numbers, ["doc_id"], F.arrays_zip("at", "numbers")).select("doc_id", F.col("at").alias("pos"), F.col("numbers").alias("request_no"))
    requests = items.join(numbered, ["doc_id", "pos"]).groupBy("doc_id", "section_pos", "request_no").agg(
        F.first("section_title").alias("section_title"), F.sum(F.length("text")).alias("chars"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("item_id").alias("id"), "text"))).alias("_items"))
    titles = elements.filter("label = 'title'").groupBy("doc_id").agg(F.min_by("text", "pos").alias("document_title"))
    return requests.join(titles, "doc_id", "left").select(
        "doc_id", "section_pos", "request_no", F.coalesce("document_title", F.lit("")).alias("document_title"), "section_title", "chars",
        F.transform("_items", lambda i: F.struct(i["id"].alias("id"), i["text"].alias("text"))).alias("items"))
