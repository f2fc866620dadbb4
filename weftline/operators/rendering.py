"""Tables, pictures, documents and chunks to Markdown, and Markdown checks.

A rendered document is a sequence of parts in order; parts are put together
into volumes of bounded size, so one long document never lands in one task.
Most documents are one volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.coerce import first_truthy, lines_of, strip
from weftline.functions.elements import (
    fence_count, is_code, picture_markdown, table_row_markdown, text_markdown,
)
from weftline.operators.elements import rendered_cells
from weftline.operators.ordering import SEGMENT_ROWS, segmented_last
from weftline.operators.rows import unpack
from weftline.operators.translation import element_route, memory_lookup, routed_text, translate_cells

# A heading that older chunk files misspell, and its spelling.
CHUNK_TITLE = ("Chunks(JS)", "Chunks(JA)")
OPEN_FENCE = "fenced code block is not closed"


def table_grid(cells: DataFrame) -> DataFrame:
    """Every place of each table with its text; gaps are blank, the last cell wins."""
    last = cells.groupBy("doc_id", "table_ref", "row", "col").agg(F.max_by("text", "seq").alias("text"))
    extent = cells.groupBy("doc_id", "table_ref").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    places = extent.select("doc_id", "table_ref", "cols", F.explode(F.sequence(F.lit(0), "rows")).alias("row")).select(
        "doc_id", "table_ref", "row", F.explode(F.sequence(F.lit(0), "cols")).alias("col")
    )
    return places.join(last, ["doc_id", "table_ref", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def table_lines(grid: DataFrame, escape: bool = False) -> DataFrame:
    """One Markdown line per table row, plus the rule under the first one.

    Groups hold one table row each.
    """
    per_row = grid.groupBy("doc_id", "table_ref", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", strip(F.col("text")).alias("t")))).alias("c")
    )
    texts = F.transform("c", lambda x: x["t"])
    rule = table_row_markdown(F.array_repeat(F.lit("---"), F.size(texts)))
    line = table_row_markdown(texts, escape)
    with_rule = F.when(F.col("row") == 0, F.array(line, rule)).otherwise(F.array(line))
    # line 0 is the header, line 1 the rule, row r follows as line r + 1
    return per_row.select("doc_id", "table_ref", "row", F.posexplode(with_rule).alias("_k", "line")).select(
        "doc_id", "table_ref", (F.when(F.col("row") == 0, F.col("_k")).otherwise(F.col("row") + 1)).cast("bigint").alias("part_no"), "line"
    )


def volumes(parts: DataFrame, keys: list[str], position: str, text: str, glue: str, out: str = "markdown",
            volume_parts: int | None = None, ending: str = "") -> DataFrame:
    """Join the parts of a key in order: one row, or volumes of at most ``volume_parts`` positions.

    Volumes are pieces of the one text: joined with nothing between them they
    equal the single row, byte by byte. Later volumes therefore begin with the
    glue, and only the last one has the ``ending``.
    """
    size = F.lit(volume_parts) if volume_parts else F.lit(None)
    numbered = parts.withColumn("volume", F.coalesce(F.floor(F.col(position) / size).cast("int"), F.lit(0)))
    if volume_parts:
        ends = parts.groupBy(*keys).agg(F.floor(F.min(position) / size).cast("int").alias("_first"), F.floor(F.max(position) / size).cast("int").alias("_last"))
        numbered = numbered.join(ends, keys)
    else:
        numbered = numbered.withColumns({"_first": F.lit(0), "_last": F.lit(0)})
    # sorting by place needs no comparison function per pair
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    joined = F.array_join(ordered["t"], glue)
    lead = F.when(F.col("volume") > F.col("_first"), glue).otherwise("")
    final = F.when(F.col("volume") == F.col("_last"), ending).otherwise("")
    gathered = numbered.groupBy(*keys, "volume", "_first", "_last").agg(joined.alias("_text"))
    return gathered.select(*keys, "volume", F.concat(lead, "_text", final).alias(out))


def tables_markdown(cells: DataFrame, escape: bool = False) -> DataFrame:
    return volumes(table_lines(table_grid(cells), escape), ["doc_id", "table_ref"], "part_no", "line", "\n")


def squeezed(text: Column) -> Column:
    """No more than one blank line at a time; most texts have no such run and skip the pattern."""
    return strip(F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text))


def _prose(label: Column, level: Column, text: Column, code: Column) -> Column:
    """Part of a text element; a code-looking heading is code here, unlike in chunk input."""
    return F.when(text == "", "").when(code, text_markdown(F.lit(""), level, text, F.lit(True))).otherwise(
        text_markdown(label, level, text, F.lit(False))
    )


def document_parts(elements: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Rendered elements in reading order; blank ones drop out.

    ``elements`` may carry ``render_text``; ``tables`` holds table Markdown
    by ``table_ref``.
    """
    shown = first_truthy(*[F.col(c) for c in ("render_text", "raw_text") if c in elements.columns], default="")
    text = strip(shown)
    code = is_code(F.col("label"), F.col("raw_text"))
    prose = _prose(F.col("label"), F.col("level"), text, code)
    picture = picture_markdown(F.get("assets", F.lit(0)), F.col("caption"), F.col("raw_text"))
    if tables is not None:
        rendered = tables.select(
            "doc_id", F.col("table_ref").alias("ref"), F.col("markdown").alias("_table")
        )
        rows = elements.join(rendered, ["doc_id", "ref"], "left")
    else:
        rows = elements.withColumn("_table", F.lit(None).cast("string"))
    title = F.when(F.col("caption") != "", F.concat(F.lit("**"), F.col("caption"), F.lit("**\n\n"))).otherwise("")
    table = F.when(F.col("_table").isNotNull(), F.concat(title, F.col("_table"))).otherwise(F.col("raw_text"))
    part = F.when(F.col("grp") == "tables", table).when(F.col("grp") == "pictures", picture).otherwise(prose)
    return rows.select("doc_id", "pos", squeezed(part).alias("part")).filter(F.col("part") != "")


def render_documents(elements: DataFrame, tables: DataFrame | None = None, volume_parts: int | None = None) -> DataFrame:
    """Markdown per document, ending with a line break; in volumes if asked."""
    return volumes(document_parts(elements, tables), ["doc_id"], "pos", "part", "\n\n", volume_parts=volume_parts, ending="\n")


def with_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """One cell table: rendered cells with the text of the edit at their place.

    A table may come with a grid and with a list of cells. The grid is what is
    rendered and the list is what is edited; ``edits`` (doc_id, table_ref, row,
    col, seq, text) of the list reach the grid here, the last one of a place wins.
    """
    place = ["doc_id", "table_ref", "row", "col"]
    last = edits.groupBy(*place).agg(F.max_by("text", "seq").alias("_edit"))
    return cells.join(last, place, "left").withColumn("text", F.coalesce("_edit", "text")).select(*cells.columns)


def render_translated(elements: DataFrame, memory: DataFrame, edits: DataFrame | None = None, volume_parts: int | None = None) -> DataFrame:
    """Markdown per document from elements and a translation memory.

    Body texts and cells are replaced, headings and table captions become
    ``source / translation``, code and protected cells stay; what the memory
    does not hold stays as it is. ``edits`` are changed cells, see
    :func:`with_edits`. Texts, captions and cells are looked up apart; each
    lookup is one join on the hash of the source, and of a text only its
    trimmed source goes through it.
    """
    def shown() -> Column:
        return F.when(F.col("translated_text").isNull(), F.col("source_text")).otherwise(
            routed_text(F.col("route"), F.col("source_text"), F.col("translated_text")))

    routed = element_route(elements.filter(strip(F.col("raw_text")) != "")).select(
        "doc_id", "pos", "label", "level", "route", strip(F.col("raw_text")).alias("source_text"))
    # code is looked up along with the others and stays as it is by its route
    looked = memory_lookup(routed, memory)
    text = strip(first_truthy(shown(), F.col("source_text"), default=""))
    told = looked.select("doc_id", "pos", "label", "level", "route", text.alias("_text")).filter(F.col("_text") != "")
    prose = told.select("doc_id", "pos", _prose(F.col("label"), F.col("level"), F.col("_text"), F.col("route") == "code").alias("part"))
    named = elements.filter((F.col("grp") == "tables") & (F.col("caption") != "")).select("doc_id", "ref", F.col("caption").alias("source_text"))
    captions = memory_lookup(named, memory).filter(F.col("translated_text").isNotNull()).select(
        "doc_id", "ref", routed_text(F.lit("caption"), F.col("source_text"), F.col("translated_text")).alias("_caption"))
    others = elements.filter(F.col("grp") != "texts").join(captions, ["doc_id", "ref"], "left")
    others = others.withColumn("caption", F.coalesce("_caption", "caption")).select(*elements.columns)
    cells = rendered_cells(elements)
    done = translate_cells(with_edits(cells, edits) if edits is not None else cells, memory)
    tables = tables_markdown(done.withColumn("text", shown()), escape=True)
    parts = prose.withColumn("part", squeezed(F.col("part"))).unionByName(document_parts(others, tables))
    return volumes(parts, ["doc_id"], "pos", "part", "\n\n", volume_parts=volume_parts, ending="\n")


def concat_parts(chunks: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Chunk texts in order without blanks and without adjacent repeats."""
    text = strip(first_truthy(F.col("translated_text"), F.col("source_text"), default=""))
    shown = chunks.select("doc_id", "chunk_no", F.replace(text, *map(F.lit, CHUNK_TITLE)).alias("part"))
    filled = shown.filter(F.col("part") != "")
    seen = segmented_last(filled, ["doc_id"], "chunk_no", {"_before": F.col("part")}, include_current=False, segment_rows=segment_rows)
    return seen.filter(F.col("_before").isNull() | (F.col("_before") != F.col("part"))).select("doc_id", "chunk_no", "part")


def concat_chunks(chunks: DataFrame, volume_parts: int | None = None) -> DataFrame:
    """Chunks of each document as Markdown, ending with a line break; in volumes if asked."""
    parts = concat_parts(chunks).withColumn("part", squeezed(F.col("part")))
    return volumes(parts, ["doc_id"], "chunk_no", "part", "\n\n", volume_parts=volume_parts, ending="\n")


def lint_markdown(texts: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Warnings: an open code fence, and table rows that differ in columns.

    Lines are checked inside the row; ``line_no`` is 0 for the whole text.
    """
    def warn(line_no: Column, warning: str) -> Column:
        return F.struct(line_no.cast("int").alias("line_no"), F.lit(warning).alias("warning"))

    def is_row(line: Column) -> Column:
        return F.startswith(line, F.lit("|"))

    def pipes(line: Column) -> Column:
        return F.size(F.split(F.replace(line, F.lit("\\|"), F.lit("")), r"\|", -1))

    lines = F.transform(lines_of(F.col(text)), lambda s, i: F.struct((i + 1).alias("n"), s.alias("s")))
    before = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))), lines)
    pairs = F.zip_with(lines, before, lambda a, b: F.struct(a["n"].alias("n"), a["s"].alias("s"), b["s"].alias("p")))
    uneven = F.filter(pairs, lambda x: is_row(x["s"]) & is_row(x["p"]) & (pipes(x["s"]) != pipes(x["p"])))
    fence = F.when(fence_count(F.col(text)) % 2 == 1, F.array(warn(F.lit(0), OPEN_FENCE)))
    rows = F.transform(uneven, lambda x: warn(x["n"], "table column count differs from the row above"))
    none = F.array().cast("array<struct<line_no:int,warning:string>>")
    return unpack(texts, keys, F.concat(F.coalesce(fence, none), rows))


def fallback_counts(rows: DataFrame) -> DataFrame:
    """Chunks and fallbacks per document."""
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("status") == "fallback_source").alias("fallback_source")
    )


def paragraphs(texts: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Paragraph rows (style, text) of Markdown; an empty text gives one blank row."""
    shape = r"(?U)^(#{1,6})\s+(.+)$"

    def paragraph(line: Column) -> Column:
        marks = F.regexp_extract(line, shape, 1)
        heading = marks != ""
        return F.struct(
            F.when(heading, F.concat(F.lit("Heading"), F.length(marks).cast("string"))).alias("style"),
            F.when(heading, strip(F.regexp_extract(line, shape, 2))).otherwise(line).alias("paragraph"),
        )

    filled = F.filter(F.transform(lines_of(F.col(text)), strip), lambda s: s != "")
    rows = F.transform(filled, paragraph)
    blank = F.array(F.struct(F.lit(None).cast("string").alias("style"), F.lit("").alias("paragraph")))
    return unpack(texts, keys, F.when(F.size(filled) > 0, rows).otherwise(blank), "para_no")


def count_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Documents whose source and target chunk counts differ."""
    ours = source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("source_chunks"))
    theirs = target.groupBy("doc_id").agg(F.count(F.lit(1)).alias("target_chunks"))
    joined = ours.join(theirs, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("source_chunks", F.lit(0)).alias("source_chunks"),
        F.coalesce("target_chunks", F.lit(0)).alias("target_chunks"),
    )
    return joined.filter(F.col("source_chunks") != F.col("target_chunks"))


def link_captions(elements: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Pictures with the caption nearest before or after them on their page."""
    is_caption = (F.col("label") == "caption") & (F.col("text") != "")
    caption = F.when(is_caption, F.struct(F.col("pos").alias("p"), F.col("text").alias("t"), F.get("pages", F.lit(0)).alias("page")))
    # only captions and pictures take part, in one shuffle each way
    elements = elements.filter(is_caption | (F.col("grp") == "pictures"))
    low = segmented_last(elements, ["doc_id"], "pos", {"_above": caption}, segment_rows=segment_rows)
    # positions mirrored: the last caption before a row of the mirror follows the picture
    high = segmented_last(low.withColumn("_back", -F.col("pos")), ["doc_id"], "_back", {"_below": caption}, segment_rows=segment_rows)
    page = F.get("pages", F.lit(0))
    above = F.when(F.col("_above.page") == page, F.col("pos") - F.col("_above.p"))
    below = F.when(F.col("_below.page") == page, F.col("_below.p") - F.col("pos"))
    nearest = F.when(above.isNotNull() & (below.isNull() | (above < below)), F.col("_above.t")).when(below.isNotNull(), F.col("_below.t"))
    return high.filter(F.col("grp") == "pictures").select("doc_id", "ref", nearest.alias("caption"))
