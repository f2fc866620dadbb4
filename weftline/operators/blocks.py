"""Grouping of consecutive lines and fragments.

A document text is one row, so runs of lines are found inside the row with
index-aware array expressions and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.arrays import let, positions
from weftline.functions.coerce import lines_of, rstrip
from weftline.functions.elements import is_heading
from weftline.operators.ordering import segmented_last
from weftline.operators.rows import unpack

# Line shapes of the block detectors.
LOG_LINE = r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
TRACE_START = r"^Traceback \(most recent call last\):"
TRACE_FRAME = r"^\s+\S"
REPORT_LINE = r"^\s*\S[^:]*\S?\s*:\s+\S"
SENTENCE_END = r"[.!?。！？:：;；]$"
# Points between fragments, and by which columns may overlap.
MAX_VERTICAL_GAP, COLUMN_TOLERANCE = 12.0, 8.0
SPANNING_SHARE = 0.6  # of the width of a page's text: wider boxes lie in no column


def _line_rows(docs: DataFrame, text: str) -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, lines_of(F.col(text)).alias("_lines"))


def _runs(flags: Column, joined: Callable[[Column], Column] | None = None) -> Column:
    """First and last positions of the runs of true flags.

    ``joined(i)`` tells whether line ``i`` continues the run of line ``i-1``.
    """
    def spans(on: Column) -> Column:
        def is_on(i: Column) -> Column:
            return F.coalesce(F.get(on, i), F.lit(False))

        def continues(i: Column) -> Column:
            return (is_on(i) & is_on(i - 1) & joined(i)) if joined else (is_on(i) & is_on(i - 1))

        starts = F.filter(positions(on), lambda i: is_on(i) & ~continues(i))
        ends = F.filter(positions(on), lambda i: is_on(i) & ~continues(i + 1))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(a.alias("first_line"), b.alias("last_line"))
        )

    return let(flags, spans)


def _emit(rows: DataFrame, spans: Column, min_lines: int, block: str) -> DataFrame:
    """One row per span of at least ``min_lines`` lines, with its text."""
    kept = [c for c in rows.columns if not c.startswith("_")]
    blocks = let(
        F.col("_lines"),
        lambda lines: F.transform(
            F.filter(spans, lambda r: r["last_line"] - r["first_line"] + 1 >= min_lines),
            lambda r: F.struct(
                r["first_line"].alias("first_line"), r["last_line"].alias("last_line"),
                F.array_join(
                    F.slice(lines, r["first_line"] + 1, r["last_line"] - r["first_line"] + 1), "\n"
                ).alias("block_text"),
            ),
        ),
    )
    return unpack(rows, [*kept, F.lit(block).alias("block")], blocks)


def log_blocks(docs: DataFrame, text: str = "text", min_lines: int = 2) -> DataFrame:
    """Runs of lines that begin with a timestamp."""
    rows = _line_rows(docs, text)
    flags = F.transform("_lines", lambda s: s.rlike(LOG_LINE))
    return _emit(rows, _runs(flags), min_lines, "log")


def stack_traces(docs: DataFrame, text: str = "text") -> DataFrame:
    """A trace header, its indented frames and the exception line after them.

    Cut the text at unindented lines: a header then runs to the next such
    line, which is its exception line unless it opens another trace.
    """
    rows = _line_rows(docs, text)

    def spans(lines: Column) -> Column:
        edges = F.filter(positions(lines), lambda i: ~F.get(lines, i).rlike(TRACE_FRAME))
        last = F.size(lines) - 1

        def span(edge_list: Column, at: Column, k: Column) -> Column:
            after = F.get(edge_list, k + 1)
            reopened = F.coalesce(F.get(lines, after).rlike(TRACE_START), F.lit(False))
            end = F.when(after.isNull(), last).when(reopened, after - 1).otherwise(after)
            return F.struct(at.alias("first_line"), end.alias("last_line"))

        every = let(edges, lambda e: F.transform(e, lambda at, k: span(e, at, k)))
        return F.filter(every, lambda s: F.get(lines, s["first_line"]).rlike(TRACE_START))

    return _emit(rows, let(F.col("_lines"), spans), 1, "stack_trace")


def report_blocks(docs: DataFrame, text: str = "text", min_lines: int = 2) -> DataFrame:
    """Runs of ``key : value`` lines."""
    rows = _line_rows(docs, text)
    flags = F.transform("_lines", lambda s: s.rlike(REPORT_LINE) & ~s.rlike(LOG_LINE))
    return _emit(rows, _runs(flags), min_lines, "report")


def ascii_tables(docs: DataFrame, text: str = "text", min_lines: int = 2) -> DataFrame:
    """Runs of lines with two or more columns that start at the same offsets."""
    rows = _line_rows(docs, text)

    def spans(starts: Column) -> Column:
        flags = F.transform(starts, lambda s: F.size(s) >= 2)
        return _runs(flags, lambda i: F.get(starts, i) == F.get(starts, i - 1))

    return _emit(rows, let(F.transform("_lines", _offsets), spans), min_lines, "ascii_table")


def _offsets(line: Column) -> Column:
    """Offsets where a column starts: the line start, then every visible
    character after two blanks. Columns are aligned when the offsets agree."""
    def starts(chars: Column) -> Column:
        def blank(i: Column) -> Column:
            return F.get(chars, i) == " "

        return F.filter(positions(chars), lambda i: ~blank(i) & ((i == 0) | ((i > 1) & blank(i - 1) & blank(i - 2))))

    return F.when(F.contains(line, F.lit("  ")), let(F.split(line, ""), starts)).otherwise(F.array(F.lit(0)))


def page_columns(places: DataFrame, tolerance: float = COLUMN_TOLERANCE, spanning: float = SPANNING_SHARE) -> DataFrame:
    """Add ``column`` to boxes (doc_id, page, l, r, ...): the text column of the page a box lies in.

    A sweep over the left edges: a box that begins further right than all
    boxes before it end, give or take ``tolerance`` points, opens a column.
    Boxes wider than ``spanning`` of the page's text do not take part, as a
    title over two columns would join them; they are column -1 where the page
    has several columns. Without a box the column is null. A page is a group.
    """
    page = Window.partitionBy("doc_id", "page")
    sweep = page.orderBy(F.asc_nulls_last("l"), "r", "pos")
    narrow = F.col("r") - F.col("l") <= (F.max("r").over(page) - F.min("l").over(page)) * spanning
    placed = places.withColumn("_narrow", narrow)
    reached = F.max(F.when(F.col("_narrow"), F.col("r"))).over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_narrow") & (reached.isNull() | (F.col("l") > reached - tolerance))
    placed = placed.withColumn("_opens", opens).withColumn("_no", F.sum(F.coalesce(F.col("_opens").cast("int"), F.lit(0))).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    several = F.max("_no").over(page) > 1
    column = F.when(F.col("_narrow").isNotNull(), F.when(~several, 0).when(F.col("_narrow"), F.col("_no")).otherwise(-1))
    return placed.withColumn("column", column).drop("_narrow", "_opens", "_no")


def merge_fragments(
    elements: DataFrame, threshold: int = 3, *, max_gap: float = MAX_VERTICAL_GAP, tolerance: float = COLUMN_TOLERANCE, spanning: float = SPANNING_SHARE,
) -> DataFrame:
    """Join a text with the fragments that continue it.

    Required: the element before ends on the page this one begins on, neither
    is a heading or code, and both have the same style where both have one.
    Where both have boxes there, they must lie in the same column of the page
    and at most ``max_gap`` points apart vertically. Points: same label, no
    sentence end before, lower-case start; ``threshold`` of them join the two.

    An element is compared page by page, so no group is larger than a page;
    the beginnings of runs are carried forward in segments, and a run becomes
    one row.
    """
    texts = elements.filter(F.col("grp") == "texts")
    first, last = F.get("pages", F.lit(0)), F.try_element_at("pages", F.lit(-1))
    nowhere = F.array(F.struct(first.alias("page"), *[F.lit(None).cast("double").alias(c) for c in "ltrb"]))
    stands = F.when(F.size("boxes") > 0, F.col("boxes")).otherwise(nowhere)
    places = texts.select(
        "doc_id", "pos", "ref", "label", "text", "style", first.alias("_first"), last.alias("_last"),
        rstrip(F.col("text")).rlike(SENTENCE_END).alias("_ends"), (is_heading(F.col("label")) | (F.col("label") == "code")).alias("_apart"), stands.alias("_stands"),
    )
    # an element begins at its first place on its first page and ends at the last one on its last page
    on = F.transform("_stands", lambda s: s["page"])
    begins, ends = F.array_position(on, F.col("_first")), F.size("_stands") + 1 - F.array_position(F.reverse(on), F.col("_last"))
    marked = places.withColumns({"_in": F.greatest(begins, F.lit(1)) - 1, "_out": F.least(ends, F.size("_stands")) - 1})
    places = unpack(marked, [c for c in marked.columns if c != "_stands"], F.col("_stands"), "_k")
    columned = page_columns(places, tolerance, spanning)
    order = Window.partitionBy("doc_id", "page").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, -1)
    facts = F.struct("pos", "label", "style", "_ends", "_apart", "column", "b")
    seen = columned.withColumn("_p", F.last(F.when(F.col("_k") == F.col("_out"), facts), ignorenulls=True).over(order)).filter(F.col("_k") == F.col("_in"))
    points = (
        (F.col("label") == F.col("_p.label")).cast("int") + (~F.col("_p._ends")).cast("int") + F.col("text").rlike(r"^\p{Ll}").cast("int")
    )
    gap = F.col("t") - F.col("_p.b")
    near = F.coalesce((F.col("column") == F.col("_p.column")) & (F.abs(gap) <= max_gap), F.lit(True))
    alike = F.coalesce(F.col("style") == F.col("_p.style"), F.lit(True))
    follows = F.col("page").isNotNull() & (F.col("_p.pos") == F.col("pos") - 1) & ~F.col("_apart") & ~F.col("_p._apart")
    glued = F.coalesce(follows & near & alike & (points >= threshold), F.lit(False))
    flagged = seen.select("doc_id", "pos", "ref", "label", "text", glued.alias("_glued"))
    headed = segmented_last(flagged, ["doc_id"], "pos", {"_head": F.when(~F.col("_glued"), F.col("pos"))})
    runs = headed.groupBy("doc_id", "_head").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "text", "label"))).alias("run"))
    return runs.select(
        "doc_id", F.col("_head").alias("pos"), F.get("run", F.lit(0))["label"].alias("label"),
        F.array_join(F.transform("run", lambda r: r["text"]), " ").alias("text"),
        F.transform("run", lambda r: r["ref"]).alias("refs"),
    )
