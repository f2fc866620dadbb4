"""Expressions over document elements: labels, pages, headings, code, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.cleaning import _URL
from weftline.functions.coerce import first_truthy, strip

# Label sets and shapes that decide how an element is treated.
HEADING_LABELS = ("title", "section_header", "heading", "header")
CODE_LABELS = ("code", "program_listing")
HTML_LABELS = ("html",)
UNCLEANED_LABELS = ("code", "formula", "table_cell", "page_header", "page_footer")
CODE_SHAPE = r"(?U)(^|\n)\s*(def |class |import |from |```|Traceback|[A-Za-z_][\w-]*\s*=)"
PROTECTED_SHAPE = r"(?U)(^|\n)\s*(Traceback|[A-Za-z_][\w-]*\s*=|def |class |import )"
TOKEN_SHAPE = r"(?U)^[\w./:\-\\]+\z"
LAST_PAGE = 10**9
FENCE = "```"


def element_label(label: Column, kind: Column) -> Column:
    return F.lower(first_truthy(label, kind, default=""))


def page_list(prov: Column) -> Column:
    """Distinct page numbers, ascending, of a provenance array."""
    pages = F.filter(F.transform(prov, lambda p: p["page_no"]), lambda n: n.isNotNull())
    return F.coalesce(F.sort_array(F.array_distinct(pages)), F.array().cast("array<int>"))


def first_page(pages: Column) -> Column:
    return F.coalesce(F.get(pages, F.lit(0)), F.lit(LAST_PAGE))


def page_ranges(pages: Column) -> Column:
    """``[1,2,3,5]`` as ``1-3,5``; nothing known is ``unknown``.

    Run starts and run ends pair up one to one, so no fold is needed.
    """
    def runs(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1) != p - 1))
        ends = F.filter(ordered, lambda p, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1) != p + 1))
        spans = F.zip_with(
            starts, ends,
            lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))),
        )
        return F.when(F.size(ordered) > 0, F.array_join(spans, ",")).otherwise("unknown")

    return let(F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull()))), runs)


def is_heading(label: Column) -> Column:
    return label.isin(*HEADING_LABELS)


def heading_level(level: Column, label: Column) -> Column:
    """Level clamped to 1..6; without one, 1 for a title and 2 otherwise."""
    fallback = F.when(label == "title", 1).otherwise(2)
    return F.when(level > 0, F.least(level, F.lit(6))).otherwise(fallback).cast("int")


def is_code_label(label: Column) -> Column:
    return label.isin(*CODE_LABELS)


def is_code(label: Column, text: Column) -> Column:
    """Code by label or by the look of a line."""
    return is_code_label(label) | text.rlike(CODE_SHAPE)


def is_cleanable(label: Column, layer: Column) -> Column:
    excluded = F.coalesce(label, F.lit("")).rlike("|".join(UNCLEANED_LABELS))
    return ~excluded & (F.coalesce(layer, F.lit("")) != "furniture")


def chunk_kind(grp: Column, label: Column) -> Column:
    return (
        F.when(grp == "tables", "table").when(grp == "pictures", "image")
        .when(is_code_label(label), "code").when(label.isin(*HTML_LABELS), "html").otherwise("text")
    )


def looks_protected(text: Column) -> Column:
    """Text not to be translated: holds a URL, is a single token, or is code-like."""
    value = strip(text)
    return value.rlike(_URL) | value.rlike(TOKEN_SHAPE) | value.rlike(PROTECTED_SHAPE)


def fenced(text: Column) -> Column:
    return F.concat(F.lit(FENCE + "\n"), text, F.lit("\n" + FENCE))


def fence_count(text: Column) -> Column:
    return (F.size(F.split(text, FENCE, -1)) - 1).cast("int")


def heading_markdown(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)


def text_markdown(label: Column, level: Column, text: Column, code: Column) -> Column:
    """Heading, fenced code or plain text; ``code`` is tested after headings."""
    return (
        F.when(text == "", "").when(is_heading(label), heading_markdown(heading_level(level, label), text))
        .when(code, fenced(text)).otherwise(text)
    )


def table_row_markdown(cells: Column, escape: bool = False) -> Column:
    flat = F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    if escape:
        flat = F.transform(flat, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(flat, " | "), F.lit(" |"))


def table_markdown(rows: Column, escape: bool = False, caption: Column | None = None) -> Column:
    """Markdown of an in-row matrix; ragged rows are padded, the first row heads."""
    def lines(matrix: Column, width: Column) -> Column:
        def line(r: Column) -> Column:
            return table_row_markdown(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), escape)

        head = F.transform(F.slice(matrix, 1, 1), line)
        rule = F.array(table_row_markdown(F.array_repeat(F.lit("---"), width)))
        rest = F.transform(F.slice(matrix, F.lit(2), F.size(matrix)), line)
        return F.array_join(F.concat(head, rule, rest), "\n")

    body = let(rows, lambda m: let(F.array_max(F.transform(m, lambda r: F.size(r))), lambda w: lines(m, w)))
    if caption is not None:
        title = F.coalesce(caption, F.lit(""))
        body = F.concat(F.when(title == "", "").otherwise(F.concat(F.lit("**"), title, F.lit("**\n\n"))), body)
    return F.when(F.size(rows) > 0, body)


def picture_markdown(uri: Column, caption: Column, text: Column) -> Column:
    label = strip(first_truthy(caption, text, default="image"))
    return F.when(uri.isNotNull(), F.concat(F.lit("!["), label, F.lit("]("), uri, F.lit(")"))).otherwise("")
