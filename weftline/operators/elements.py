"""Document JSON to element and cell tables, cleaning and change logs.

A document is one row; its elements are ordered inside the row and then
exploded, so extraction needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.cleaning import clean_text, normalize_text
from weftline.functions.coerce import first_truthy, lines_of, strip
from weftline.functions.elements import (
    element_label, first_page, is_cleanable, is_code, page_list,
)
from weftline.operators.rows import unpack

_ITEM = (
    "struct<self_ref:string,label:string,type:string,text:string,orig:string,content:string,"
    "level:int,heading_level:int,content_layer:string,formatting:string,"
    "prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>,"
    "caption:string,title:string,image:struct<uri:string>,"
    "data:struct<grid:array<array<variant>>,table_cells:array<variant>,cells:array<variant>>>"
)
DOCUMENT_SCHEMA = f"struct<texts:array<{_ITEM}>,tables:array<{_ITEM}>,pictures:array<{_ITEM}>>"
GROUPS = ("texts", "tables", "pictures")
SAMPLE_CHARS = 120
_CELLS = "array<struct<row:int,col:int,seq:int,text:string,path:string>>"
_BOXES = "array<struct<page:int,l:double,t:double,r:double,b:double>>"


def first_filled(*cols: Column) -> Column:
    """First value with visible characters, trimmed; else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def _first_given(*cols: Column) -> Column:
    """First value present at all, kept as it is; else empty."""
    return F.coalesce(*cols, F.lit(""))


def _cell_text(cell: Column) -> Column:
    """Text of a table cell as it is, given as an object or as a bare value."""
    inner = first_truthy(
        F.try_variant_get(cell, "$.text", "string"), F.try_variant_get(cell, "$.content", "string"), default=""
    )
    return F.when(_is_object(cell), inner).otherwise(F.coalesce(F.try_variant_get(cell, "$", "string"), F.lit("")))


def _is_object(cell: Column) -> Column:
    return F.startswith(F.schema_of_variant(cell), F.lit("OBJECT"))


def _cell_at(cell: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(cell, f"$.{n}", "int") for n in names], F.lit(0))


def _listed_cells(data: Column) -> Column:
    """Objects of the cell list with their place; bare values in the list are no cells."""
    listed = F.coalesce(
        F.when(F.size(data["table_cells"]) > 0, data["table_cells"]), F.when(F.size(data["cells"]) > 0, data["cells"])
    )
    numbered = F.filter(F.transform(listed, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.coalesce(_is_object(x["c"]), F.lit(False)))
    return F.transform(
        numbered,
        lambda x: F.struct(
            _cell_at(x["c"], "start_row_offset_idx", "row", "row_idx").alias("row"),
            _cell_at(x["c"], "start_col_offset_idx", "col", "col_idx").alias("col"),
            x["i"].alias("seq"), _cell_text(x["c"]).alias("text"),
            F.concat(F.lit("/data/table_cells/"), x["i"].cast("string")).alias("path"),
        ),
    )


def _grid_cells(data: Column) -> Column:
    """Cells of the grid with their place."""
    return F.flatten(
        F.transform(
            data["grid"],
            lambda r, y: F.transform(
                r,
                lambda c, x: F.struct(
                    y.alias("row"), x.alias("col"), x.alias("seq"), _cell_text(c).alias("text"),
                    F.concat(F.lit("/data/grid/"), y.cast("string"), F.lit("/"), x.cast("string")).alias("path"),
                ),
            ),
        )
    )


def matrix_of(entries: Column) -> Column:
    """Rows of trimmed cell texts; gaps are blank, the last cell on a place wins."""
    def grid(cells: Column) -> Column:
        top = F.array_max(F.transform(cells, lambda e: e["row"]))
        side = F.array_max(F.transform(cells, lambda e: e["col"]))
        return let(side, lambda width: F.transform(F.sequence(F.lit(0), top), lambda r: row(cells, r, width)))

    def row(cells: Column, r: Column, width: Column) -> Column:
        return let(
            F.filter(cells, lambda e: e["row"] == r),
            lambda mine: F.transform(
                F.sequence(F.lit(0), width),
                lambda c: F.coalesce(
                    strip(F.try_element_at(F.filter(mine, lambda e: e["col"] == c), F.lit(-1))["text"]), F.lit("")
                ),
            ),
        )

    return F.when(F.size(entries) > 0, let(entries, grid))


def boxes_of(prov: Column) -> Column:
    """(page, l, t, r, b) per place of an element; t and b grow downwards whatever the origin, and are null without a box."""
    def box(p: Column) -> Column:
        down = F.when(p["bbox"]["coord_origin"] == "BOTTOMLEFT", -1.0).otherwise(1.0)
        return F.struct(
            p["page_no"].alias("page"), p["bbox"]["l"].alias("l"), (p["bbox"]["t"] * down).alias("t"), p["bbox"]["r"].alias("r"), (p["bbox"]["b"] * down).alias("b"))

    return F.transform(F.filter(prov, lambda p: p["page_no"].isNotNull()), box)


def _item(entry: Column, grp: str, idx: Column) -> Column:
    pages = page_list(entry["prov"])
    grid = _grid_cells(entry["data"]) if grp == "tables" else F.lit(None)
    cells = F.coalesce(_listed_cells(entry["data"]), grid) if grp == "tables" else F.lit(None)
    uri = entry["image"]["uri"]
    return F.struct(
        F.lit(grp).alias("grp"),
        idx.alias("idx"),
        F.coalesce(F.nullif(entry["self_ref"], F.lit("")), F.concat(F.lit(f"#/{grp}/"), idx.cast("string"))).alias("ref"),
        element_label(entry["label"], entry["type"]).alias("label"),
        first_filled(entry["text"], entry["orig"], entry["content"]).alias("text"),
        _first_given(entry["text"], entry["orig"], entry["content"]).alias("raw_text"),
        entry["text"].alias("own_text"),
        F.coalesce(F.nullif(entry["level"], F.lit(0)), entry["heading_level"]).alias("level"),
        pages.alias("pages"),
        entry["content_layer"].alias("layer"),
        # a picture's title is no caption
        strip(first_truthy(entry["caption"], *([] if grp == "pictures" else [entry["title"]]), default="")).alias("caption"),
        F.when(uri.isNotNull(), F.array(uri)).otherwise(F.array().cast("array<string>")).alias("assets"),
        cells.cast(_CELLS).alias("cells"), grid.cast(_CELLS).alias("grid"),
        boxes_of(entry["prov"]).cast(_BOXES).alias("boxes"), entry["formatting"].alias("style"),
    )


def element_arrays(docs: DataFrame, payload: str = "payload", order: str = "group") -> DataFrame:
    """One row per document with its elements in reading order.

    ``order="group"`` sorts by (first page, group, index), ``order="index"``
    by (first page, index, group).
    """
    rank = {"group": ("group_no", "idx"), "index": ("idx", "group_no")}[order]
    parsed = docs.withColumn("_d", F.from_json(payload, DOCUMENT_SCHEMA))
    empty = F.array().cast(f"array<{_ITEM}>")

    def items_of(grp: str) -> Column:
        return F.transform(F.coalesce(F.col(f"_d.{grp}"), empty), lambda e, i: _item(e, grp, i))

    gathered = F.concat(*[items_of(g) for g in GROUPS])
    group_no = {g: n for n, g in enumerate(GROUPS)}

    def sort_key(e: Column, i: Column) -> Column:
        number = F.when(e["grp"] == "texts", group_no["texts"]).when(e["grp"] == "tables", group_no["tables"])
        values = {"group_no": number.otherwise(group_no["pictures"]), "idx": e["idx"]}
        return F.struct(first_page(e["pages"]).alias("p"), values[rank[0]].alias("a"), values[rank[1]].alias("b"), i.alias("i"))

    ordered = let(
        gathered,
        lambda e: F.transform(F.sort_array(F.transform(e, sort_key)), lambda k: F.get(e, k["i"])),
    )
    kept = [c for c in docs.columns if c != payload]
    return parsed.select(*kept, ordered.alias("elements"))


def element_table(arrays: DataFrame) -> DataFrame:
    """One row per element; ``pos`` is its place in reading order."""
    kept = [c for c in arrays.columns if c != "elements"]
    return unpack(arrays, kept, F.col("elements"), "pos")


def cell_table(elements: DataFrame) -> DataFrame:
    """One row per table cell as it is edited: the cell list, else the grid."""
    return _cells_of(elements, F.col("cells"))


def rendered_cells(elements: DataFrame) -> DataFrame:
    """One row per table cell as it is rendered: the grid, else the cell list."""
    return _cells_of(elements, F.coalesce("grid", "cells"))


def _cells_of(elements: DataFrame, cells: Column) -> DataFrame:
    return unpack(
        elements.filter(F.col("grp") == "tables"), ["doc_id", F.col("ref").alias("table_ref"), F.col("pages").alias("page_numbers")], cells
    ).select(
        "doc_id", "table_ref", "row", "col", "seq", "text",
        F.concat("table_ref", "path").alias("cell_ref"), "page_numbers",
    )


def line_elements(docs: DataFrame, text: str = "text", heading_chars: int = 0) -> DataFrame:
    """Plain text documents as element arrays, one text element per line.

    The first line is a title; a line shorter than ``heading_chars`` counts as
    a section header whose level follows its length; lines that look like an
    assignment or definition are code. Pages hold 50 lines.
    """
    def label_of(line: Column, i: Column) -> Column:
        return (
            F.when(i == 0, "title").when(is_code(F.lit(""), line), "code")
            .when(F.length(line) < heading_chars, "section_header").otherwise("paragraph")
        )

    def item(line: Column, i: Column, label: Column) -> Column:
        level = F.when(label == "section_header", F.length(line) % 4 + 1)
        return F.struct(
            F.lit("texts").alias("grp"), i.alias("idx"), F.concat(F.lit("#/texts/"), i.cast("string")).alias("ref"),
            label.alias("label"), strip(line).alias("text"), line.alias("raw_text"), line.alias("own_text"), level.cast("int").alias("level"),
            F.array(F.floor(i / 50).cast("int") + 1).alias("pages"), F.lit("body").alias("layer"),
            F.lit("").alias("caption"), F.array().cast("array<string>").alias("assets"),
            no_cells.alias("cells"), no_cells.alias("grid"),
            F.lit(None).cast(_BOXES).alias("boxes"), F.lit(None).cast("string").alias("style"),
        )

    no_cells = F.lit(None).cast(_CELLS)
    lines = lines_of(F.col(text))
    made = F.transform(lines, lambda line, i: let(label_of(line, i), lambda label: item(line, i, label)))
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, made.alias("elements"))


def clean_elements(elements: DataFrame) -> DataFrame:
    """Add ``cleaned``: the element's own text after cleanup where the element allows it.

    Only the ``text`` field is cleaned, untrimmed; an element whose text comes
    from another field has nothing to clean.
    """
    allowed = is_cleanable(F.col("label"), F.col("layer")) & F.col("own_text").isNotNull()
    return elements.withColumn("cleaned", F.when(allowed, clean_text(F.col("own_text"))).otherwise(F.col("own_text")))


def change_log(cleaned: DataFrame, before: str = "own_text", after: str = "cleaned", ref: str = "ref", pages: str = "pages",
               sample_chars: int | None = SAMPLE_CHARS) -> DataFrame:
    """Audit rows of the texts that cleanup changed; ``sample_chars`` cuts the samples (None: whole texts)."""
    sample = lambda c: F.col(c) if sample_chars is None else F.substring(c, 1, sample_chars)
    return cleaned.filter(F.col(before) != F.col(after)).select(
        "doc_id", F.lit("conservative_text_cleanup").alias("rule"), F.col(ref).alias("node_ref"),
        F.col(pages).alias("page_numbers"),
        F.length(before).alias("before_chars"), F.length(after).alias("after_chars"),
        sample(before).alias("before_sample"), sample(after).alias("after_sample"),
    )


def clean_cells(cells: DataFrame) -> DataFrame:
    """Add ``cleaned`` to table cells; a cell carries no label, so every cell is cleaned."""
    return cells.withColumn("cleaned", clean_text(F.col("text")))


def cell_change_log(cells: DataFrame, sample_chars: int | None = SAMPLE_CHARS) -> DataFrame:
    """Audit rows of the table cells that cleanup changed."""
    return change_log(clean_cells(cells), "text", "cleaned", "cell_ref", "page_numbers", sample_chars)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("change_count"))


def normalize_elements(elements: DataFrame) -> DataFrame:
    """Normalised text elements; code is tagged and left alone."""
    code = is_code(F.col("label"), F.col("raw_text"))
    texts = elements.filter(F.col("grp") == "texts")
    return texts.withColumn("kind", F.when(code, "code")).withColumn("normalized", _normalized(code, F.col("raw_text")))


def _normalized(code: Column, text: Column) -> Column:
    return F.when(code | (text == ""), text).otherwise(normalize_text(text))


def normalization_patches(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Patch rows for every text and cell that normalisation changes."""
    def changed(rows: DataFrame, op: str, ref: str, reason: str, before: str, after: Column) -> DataFrame:
        # both texts are made once per row; a filter on them would normalise a second time
        pair = F.struct(F.col(before).alias("before"), after.alias("after"))
        return unpack(rows, ["doc_id", F.lit(op).alias("op"), F.col(ref).alias("ref"), F.lit(reason).alias("reason")],
                      let(pair, lambda p: F.when(p["before"] != p["after"], F.array(p))))

    after = _normalized(is_code(F.col("label"), F.col("raw_text")), F.col("raw_text"))
    own = changed(texts.filter(F.col("grp") == "texts"), "set_text", "ref", "normalize text noise", "raw_text", after)
    return own.unionByName(changed(cells, "set_table_cell_text", "cell_ref", "normalize table cell", "text", normalize_text(F.col("text"))))
