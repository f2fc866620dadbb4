"""Registered queries of the rendering family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.coerce import lines_of
from weftline.functions.elements import picture_markdown
from weftline.operators import elements, rendering
from weftline.plans import inputs
from weftline.plans.element_queries import document_payloads, line_table
from weftline.plans.inputs import CODE_SQL, ELEMENTS_SQL, LINES_SQL, STRIP_SQL, table
from weftline.session import Rounds

#: The columns of an element that rendering reads.
_RENDERED = ("doc_id", "pos", "grp", "ref", "label", "level", "pages", "raw_text", "caption", "assets", "cells", "grid")

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    """A table per customer: orders fall on seven rows, later ones win a place;
    column 1 stays empty and column 2 is given for every second order."""
    o = table(spark, d, "orders")
    place = [F.col("o_custkey").alias("doc_id"), F.lit("#/tables/0").alias("table_ref"), (F.col("o_orderkey") % 7).cast("int").alias("row")]
    first = o.select(*place, F.lit(0).alias("col"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"))
    third = o.filter(F.col("o_orderkey") % 2 == 0).select(
        *place, F.lit(2).alias("col"), F.col("o_orderkey").alias("seq"), F.concat(F.lit(" a|b\n"), "o_orderstatus", F.lit(" ")).alias("text")
    )
    return first.unionByName(third)


_GRID = """cells as (select o_custkey as doc_id, cast(o_orderkey % 7 as integer) as row, 0 as col, o_orderkey as seq, o_orderpriority as text from orders
union all select o_custkey, cast(o_orderkey % 7 as integer), 2, o_orderkey, ' a|b' || chr(10) || o_orderstatus || ' ' from orders where o_orderkey % 2 = 0),
ext as (select doc_id, max(row) as rows, max(col) as cols from cells group by 1), last as (select doc_id, row, col, max_by(text, seq) as text from cells group by 1, 2, 3),
places as (select doc_id, cast(r as integer) as row, cast(c as integer) as col from (select doc_id, cols, unnest(range(0, rows + 1)) as r from ext), lateral (select unnest(range(0, cols + 1)) as c)),
grid as (select p.doc_id, p.row, p.col, coalesce(l.text, '') as text from places p left join last l on l.doc_id = p.doc_id and l.row = p.row and l.col = p.col)"""


@query("table_grid", f"with {_GRID} select doc_id, row, col, text from grid")
def table_grid(spark, d):
    return rendering.table_grid(order_cells(spark, d)).select("doc_id", "row", "col", "text")


def _table_sql(escape: bool) -> str:
    cell = f"replace({STRIP_SQL.format('text')}, chr(10), ' ')"
    cell = f"replace({cell}, '|', '\\|')" if escape else cell
    return f"""with {_GRID}, l as (select doc_id, row, '| ' || string_agg({cell}, ' | ' order by col) || ' |' as line, '| ' || string_agg('---', ' | ' order by col) || ' |' as rule from grid group by 1, 2)
select doc_id, 0 as volume, string_agg(case when row = 0 then line || chr(10) || rule else line end, chr(10) order by row) as markdown from l group by 1"""


@query("table_markdown", _table_sql(False))
def table_markdown(spark, d):
    return rendering.tables_markdown(order_cells(spark, d)).drop("table_ref")


@query("table_markdown_escaped", _table_sql(True))
def table_markdown_escaped(spark, d):
    return rendering.tables_markdown(order_cells(spark, d), escape=True).drop("table_ref")


@query("picture_markdown", r"""
select page_id, case when page_id % 3 = 0 then '' else '![' || case when page_id % 3 = 1 then coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'image') else 'image' end || '](' || url || ')' end as markdown from pages""")
def picture_markdown_query(spark, d):
    p = table(spark, d, "pages")
    kind = F.col("page_id") % 3
    caption = F.when(kind == 1, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", picture_markdown(F.when(kind != 0, F.col("url")), F.lit(""), caption).alias("markdown"))


_CODE_LINE = f"(label = 'code' or regexp_matches(raw_text, '{CODE_SQL}'))"
_PART = f"case when {_CODE_LINE} then '```' || chr(10) || text || chr(10) || '```' when label in ('title', 'section_header') then repeat('#', case when level > 0 then least(level, 6) when label = 'title' then 1 else 2 end) || ' ' || text else text end"


@query("document_render", f"with e as ({ELEMENTS_SQL}) select doc_id, 0 as volume, string_agg({_PART}, chr(10) || chr(10) order by idx) || chr(10) as markdown from e where text <> '' group by 1")
def document_render(spark, d):
    return rendering.render_documents(line_table(spark, d))


@query("document_render_volumes", f"with e as ({ELEMENTS_SQL}) select doc_id, string_agg({_PART}, chr(10) || chr(10) order by idx) || chr(10) as markdown from e where text <> '' group by 1")
def document_render_volumes(spark, d):
    """Volumes of 8 elements, put together again: the text is that of one piece."""
    cut = rendering.render_documents(line_table(spark, d), volume_parts=8)
    pieces = F.array_sort(F.collect_list(F.struct("volume", "markdown")))
    return cut.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda v: v["markdown"]), "").alias("markdown"))


@query("document_render_tables", f"""
with w as (select doc_id, string_split(string_split(text, chr(10))[1], ' ') as w from documents),
t as (select doc_id, '**Words**' || chr(10) || chr(10) || '| ' || coalesce(replace(w[1], '|', '\\|'), '') || ' | ' || coalesce(replace(w[2], '|', '\\|'), '') || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(replace(w[3], '|', '\\|'), '') || ' |  |' as md from w),
p as (select doc_id, '![image](img/' || doc_id || '.png)' as md from documents) select doc_id, t.md as table_part, p.md as picture_part from t join p using (doc_id)""")
def document_render_tables(spark, d):
    flat = elements.element_table(elements.element_arrays(document_payloads(spark, d), order="index"))
    # read several times below; the documents are parsed once
    flat = Rounds(spark).keep("elements", flat.filter(F.col("grp") != "texts").select(*_RENDERED))
    tables = rendering.tables_markdown(elements.rendered_cells(flat), escape=True)
    parts = rendering.document_parts(flat, tables)
    return parts.groupBy("doc_id").agg(
        F.max(F.when(F.col("part").startswith("**"), F.col("part"))).alias("table_part"),
        F.max(F.when(F.col("part").startswith("!["), F.col("part"))).alias("picture_part"),
    )


def edited_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Lines under a title, and a table that has a grid and, newer, a list with one of its cells."""
    def item(line, i):
        page = F.array(F.struct((F.floor(i / 50) + 1).cast("int").alias("page_no")))
        return F.struct(F.when(i == 0, "title").otherwise("paragraph").alias("label"), line.alias("text"), page.alias("prov"))

    number = F.col("doc_id").cast("string")
    grid = F.array(F.array(F.lit("old cell"), F.lit("A-1")), F.array(F.concat(F.lit("row | of "), number), F.lit("")))
    cell = F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.concat(F.lit("edited cell "), number).alias("text"))
    table_item = F.struct(
        F.lit("table").alias("label"), F.lit("Words").alias("caption"), F.array(F.struct(F.lit(1).alias("page_no"))).alias("prov"),
        F.struct(grid.alias("grid"), F.array(cell).alias("table_cells")).alias("data"))
    body = F.struct(F.transform(lines_of(F.col("text")), item).alias("texts"), F.array(table_item).alias("tables"))
    return inputs.documents(spark, d).select("doc_id", F.to_json(body).alias("payload"))


@query("document_translated", f"""
with l as (select doc_id, idx, line, {STRIP_SQL.format('line')} as text from ({LINES_SQL})),
p as (select doc_id, idx // 50 + 1 as page, idx, 0 as grp, case when regexp_matches(line, '{CODE_SQL}') then '```' || chr(10) || text || chr(10) || '```'
 when idx = 0 then '# ' || text || ' / 訳:' || text else '訳:' || text end as part from l where text <> ''
 union all select doc_id, 1, 0, 1, '**Words / 訳:Words**' || chr(10) || chr(10) || '| 訳:edited cell ' || doc_id || ' | A-1 |' || chr(10) || '| --- | --- |' || chr(10)
  || '| 訳:row \\| of ' || doc_id || ' |  |' from documents)
select doc_id, 0 as volume, string_agg(part, chr(10) || chr(10) order by page, idx, grp) || chr(10) as markdown from p group by doc_id""")
def document_translated(spark, d):
    """From elements and a memory to Markdown: texts, captions and the edited cells, of all documents."""
    flat = elements.element_table(elements.element_arrays(edited_payloads(spark, d), order="index"))
    # read several times below; the documents are parsed once
    kept = Rounds(spark)
    flat = kept.keep("elements", flat.select(*_RENDERED, "text"))
    edits = elements.cell_table(flat)
    sources = flat.select(F.explode(F.array("text", "caption")).alias("s")).unionByName(edits.select(F.col("text").alias("s"))).unionByName(
        elements.rendered_cells(flat).select(F.col("text").alias("s")))
    memory = sources.filter("s <> ''").distinct().select(F.sha2("s", 256).alias("source_sha256"), F.concat(F.lit("訳:"), "s").alias("translated_text"), F.lit(0).alias("updated_at"))
    return rendering.render_translated(flat, kept.keep("memory", memory), edits)


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks: each third is translated, some repeat the line before."""
    lines = line_table(spark, d)
    shown = F.when(F.col("idx") % 3 == 1, F.concat(F.lit("# Chunks(JS) "), F.col("doc_id").cast("string"))).when(F.col("idx") % 3 == 2, " ")
    return lines.select(
        "doc_id", F.col("idx").cast("bigint").alias("chunk_no"), F.col("raw_text").alias("source_text"),
        F.when(F.col("idx") % 6 >= 4, F.concat(F.lit("# Chunks(JS) "), F.col("doc_id").cast("string"))).otherwise(F.when(F.col("idx") % 6 == 1, "").otherwise(shown)).alias("translated_text"),
    )


_LINE_CHUNKS = f"""lc as (select doc_id, idx, case when idx % 6 >= 4 then '# Chunks(JA) ' || doc_id when idx % 6 = 2 then '' else replace({STRIP_SQL.format('line')}, 'Chunks(JS)', 'Chunks(JA)') end as part from ({LINES_SQL})),
kept as (select *, lag(part) over (partition by doc_id order by idx) as before from lc where part <> ''), parts as (select doc_id, idx, part from kept where before is null or before <> part)"""


@query("concat_parts", f"with {_LINE_CHUNKS} select doc_id, idx as chunk_no, part from parts")
def concat_parts(spark, d):
    return rendering.concat_parts(line_chunks(spark, d), segment_rows=8)


@query("concat_chunks", f"with {_LINE_CHUNKS} select doc_id, 0 as volume, string_agg(part, chr(10) || chr(10) order by idx) || chr(10) as markdown from parts group by 1")
def concat_chunks(spark, d):
    return rendering.concat_chunks(line_chunks(spark, d))


@query("markdown_lint", """
select doc_id, 0 as line_no, 'fenced code block is not closed' as warning from documents where doc_id % 2 = 0
union all select doc_id, 3, 'table column count differs from the row above' from documents where doc_id % 3 = 0""")
def markdown_lint(spark, d):
    start = F.when(F.col("doc_id") % 3 == 0, "| a | b |\n| --- | --- |\n| x |\n").otherwise("| a | b |\n| --- | --- |\n| x | y\\|z |\n")
    fence = F.when(F.col("doc_id") % 2 == 0, "```\n").otherwise("```\n```\n")
    texts = inputs.documents(spark, d).select("doc_id", F.concat(start, fence, F.col("text")).alias("markdown"))
    return rendering.lint_markdown(texts, ["doc_id"])


@query("fallback_counts", "select user_id as doc_id, count(*) as chunks, count(*) filter (where event_type = 'error') as fallback_source from events group by 1")
def fallback_counts(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "fallback_source").otherwise("success")
    return rendering.fallback_counts(e.select(F.col("user_id").alias("doc_id"), status.alias("status")))


@query("markdown_paragraphs", rf"""
with t as (select doc_id, '## ' || text as text from documents), l as (select doc_id, generate_subscripts(l, 1) as k, {STRIP_SQL.format('unnest(l)')} as s from (select doc_id, string_split(text, chr(10)) as l from t)),
f as (select doc_id, row_number() over (partition by doc_id order by k) - 1 as para_no, s from l where s <> '')
select doc_id, para_no, case when regexp_matches(s, '^#{{1,6}}\s+.+$') then 'Heading' || length(regexp_extract(s, '^(#+)', 1)) end as style,
case when regexp_matches(s, '^#{{1,6}}\s+.+$') then {STRIP_SQL.format("regexp_extract(s, '^#+(.*)$', 1)")} else s end as paragraph from f""")
def markdown_paragraphs(spark, d):
    texts = inputs.documents(spark, d).select("doc_id", F.concat(F.lit("## "), F.col("text")).alias("markdown"))
    rows = rendering.paragraphs(texts, ["doc_id"])
    return rows.withColumn("para_no", F.col("para_no").cast("bigint"))


@query("chunk_count_mismatches", """
with s as (select o_custkey as doc_id, count(*) as n from orders group by 1), t as (select o_custkey as doc_id, count(*) as n from orders where o_orderstatus <> 'P' group by 1)
select coalesce(s.doc_id, t.doc_id) as doc_id, coalesce(s.n, 0) as source_chunks, coalesce(t.n, 0) as target_chunks from s full outer join t on s.doc_id = t.doc_id where coalesce(s.n, 0) <> coalesce(t.n, 0)""")
def chunk_count_mismatches(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "doc_id")
    return rendering.count_mismatches(o, o.filter(F.col("o_orderstatus") != "P"))


@query("caption_links", f"""
with e as ({ELEMENTS_SQL}), k as (select *, case when idx % 5 = 3 then 'pictures' else 'texts' end as grp, idx % 7 = 1 and text <> '' as cap from e),
c as (select p.doc_id, p.ref, q.text, q.idx, p.idx - q.idx as gap, row_number() over (partition by p.doc_id, p.idx order by abs(p.idx - q.idx), q.idx desc) as rn
 from k p left join k q on q.doc_id = p.doc_id and q.cap and q.page = p.page
  and q.idx in ((select max(idx) from k a where a.doc_id = p.doc_id and a.cap and a.idx <= p.idx), (select min(idx) from k b where b.doc_id = p.doc_id and b.cap and b.idx >= p.idx)) where p.grp = 'pictures')
select doc_id, ref, text as caption from c where rn = 1""")
def caption_links(spark, d):
    lines = line_table(spark, d)
    mixed = lines.withColumn("grp", F.when(F.col("idx") % 5 == 3, "pictures").otherwise("texts")).withColumn(
        "label", F.when(F.col("idx") % 7 == 1, "caption").otherwise(F.col("label"))
    )
    return rendering.link_captions(mixed, segment_rows=16)
