"""Registered queries of the element, cleaning and block families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.cleaning import blank_symbol_cell, clean_text, is_symbol_only, normalize_text, repair_hyphenation
from weftline.functions.coerce import lines_of
from weftline.functions.elements import (
    chunk_kind, heading_level, is_code, is_heading, looks_protected, page_ranges,
)
from weftline.operators import blocks, elements
from weftline.plans import inputs
from weftline.plans.inputs import CODE_SQL, ELEMENTS_SQL, LINES_SQL, NOISY_SQL, STRIP_SQL, table
from weftline.session import Rounds

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def document_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON with texts, one table and one picture each."""
    def item(line, i):
        return F.struct(
            F.when(i % 2 == 0, "TEXT").alias("label"), F.when(i % 2 == 1, "Paragraph").alias("type"),
            F.when(i % 3 == 0, line).when(i % 3 == 1, "  ").alias("text"), F.when(i % 3 == 1, line).alias("orig"),
            F.when(i % 3 == 2, line).alias("content"),
            F.array(F.struct((F.floor(i / 5) + 1).cast("int").alias("page_no")), F.struct((F.floor(i / 5) + 2).cast("int").alias("page_no"))).alias("prov"),
        )

    def body(lines):
        return let(F.split(F.get(lines, F.lit(0)), " "), lambda words: parts(lines, words))

    def parts(lines, words):
        cells = F.array(
            *[
                F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias("text"))
                for k, (r, c) in enumerate([(0, 0), (0, 1), (1, 0)])
            ]
        )
        table_item = F.struct(
            F.lit("#/tables/0").alias("self_ref"), F.lit("table").alias("label"), F.lit("Words").alias("caption"),
            F.array(F.struct(F.lit(1).alias("page_no"))).alias("prov"), F.struct(cells.alias("table_cells")).alias("data"),
        )
        picture = F.struct(F.struct(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("uri")).alias("image"))
        return F.struct(F.transform(lines, item).alias("texts"), F.array(table_item).alias("tables"), F.array(picture).alias("pictures"))

    return inputs.documents(spark, d).select("doc_id", F.to_json(let(lines_of(F.col("text")), body)).alias("payload"))


_BASE = f"""lines as ({LINES_SQL}), base as (
select doc_id, 'texts' as grp, idx, '#/texts/' || idx as ref, case when idx % 2 = 0 then 'text' else 'paragraph' end as label, {STRIP_SQL.format('line')} as text,
case when idx % 3 = 1 then case when {STRIP_SQL.format('line')} = '' then '  ' else '  ' end else line end as raw_text, idx // 5 + 1 as page, (idx // 5 + 1) || '-' || (idx // 5 + 2) as pages from lines
union all select doc_id, 'tables', 0, '#/tables/0', 'table', '', '', 1, '1' from documents
union all select doc_id, 'pictures', 0, '#/pictures/0', '', '', '', 1000000000, 'unknown' from documents)"""


def _element_view(spark, d, order):
    flat = elements.element_table(elements.element_arrays(document_payloads(spark, d), order=order))
    return flat.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "grp", F.col("idx").cast("bigint").alias("idx"), "ref", "label", "text", "raw_text",
        page_ranges(F.col("pages")).alias("pages"),
    )


def _order_sql(order: str) -> str:
    return f"""with {_BASE} select doc_id, row_number() over (partition by doc_id order by {order}) - 1 as pos, grp, idx, ref, label, text, raw_text, pages from base"""


_GROUP_NO = "case grp when 'texts' then 0 when 'tables' then 1 else 2 end"


@query("document_elements", _order_sql(f"page, {_GROUP_NO}, idx"))
def document_elements(spark, d):
    return _element_view(spark, d, "group")


@query("document_elements_by_index", _order_sql(f"page, idx, {_GROUP_NO}"))
def document_elements_by_index(spark, d):
    return _element_view(spark, d, "index")


@query("document_cells", """
select doc_id, '#/tables/0' as table_ref, "row", col, coalesce(w[k], '') as text, '#/tables/0/data/table_cells/' || (k - 1) as cell_ref from
(select doc_id, string_split(string_split(text, chr(10))[1], ' ') as w from documents), (values (1, 0, 0), (2, 0, 1), (3, 1, 0)) v(k, "row", col)""")
def document_cells(spark, d):
    flat = elements.element_table(elements.element_arrays(document_payloads(spark, d)))
    return elements.cell_table(flat).select("doc_id", "table_ref", "row", "col", "text", "cell_ref")


@query("page_ranges", """
with p as (select distinct l_orderkey as k, l_linenumber as n from lineitem),
g as (select k, n, n - row_number() over (partition by k order by n) as isle from p),
r as (select k, min(n) as a, max(n) as b from g group by k, isle)
select k as order_key, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as pages from r group by 1""")
def page_ranges_query(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_set("l_linenumber").alias("p"))
    return pages.select("order_key", page_ranges(F.col("p")).alias("pages"))


def line_table(spark: SparkSession, d: str) -> DataFrame:
    return elements.element_table(inputs.document_arrays(spark, d))


def kept_lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The line table written once, with these columns (all without), for queries that read it several times."""
    lines = line_table(spark, d)
    return Rounds(spark).keep("lines", lines.select(*columns) if columns else lines)


@query("heading_levels", f"""
with e as ({ELEMENTS_SQL}) select doc_id, idx, label in ('title', 'section_header') as heading,
case when level > 0 then least(level, 6) when label = 'title' then 1 else 2 end as level from e""")
def heading_levels(spark, d):
    return line_table(spark, d).select(
        "doc_id", "idx", is_heading(F.col("label")).alias("heading"), heading_level(F.col("level"), F.col("label")).alias("level")
    )


@query("code_flags", f"select doc_id, idx, regexp_matches(line, '{CODE_SQL}') as code from ({LINES_SQL})")
def code_flags(spark, d):
    return line_table(spark, d).select("doc_id", F.col("idx").cast("bigint").alias("idx"), is_code(F.lit(""), F.col("raw_text")).alias("code"))


@query("element_kinds", f"with e as ({ELEMENTS_SQL}) select label, case when label = 'code' then 'code' else 'text' end as kind, count(*) as n from e group by 1, 2")
def element_kinds(spark, d):
    return line_table(spark, d).groupBy("label", chunk_kind(F.col("grp"), F.col("label")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_URL = "https?://[^\\s)>\"]+"


def _clean_sql(x: str, middle_dots: bool) -> str:
    rules = [(r"\.{4,}", "...")] + ([("・{4,}", "・・・")] if middle_dots else []) + [("[‐‑‒–—―-]{4,}", "---")]
    rules += [(c + "{6,}", t * 3) for c, t in (("_", "_"), ("=", "="), ("~", "~"), (r"\*", "*"))]
    rules += [("[ \\t\\f\\v]+", " "), ("\\n{3,}", "\n\n")]
    for pattern, to in rules:
        to_sql = "chr(10) || chr(10)" if to == "\n\n" else f"'{to}'"
        x = f"regexp_replace({x}, '{pattern}', {to_sql}, 'g')"
    return x


def _outside_urls(x: str, middle_dots: bool = True) -> str:
    gaps = f"list_zip(regexp_split_to_array({x}, '{_URL}'), list_append(regexp_extract_all({x}, '{_URL}'), ''))"
    return f"array_to_string(list_transform({gaps}, lambda z: {_clean_sql('z[1]', middle_dots)} || z[2]), '')"


@query("clean_text", f"select doc_id, {_outside_urls('text')} as cleaned from ({NOISY_SQL})")
def clean_text_query(spark, d):
    return inputs.noisy_documents(spark, d).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("normalize_text", f"select doc_id, {STRIP_SQL.format(_outside_urls('text', False))} as cleaned from ({NOISY_SQL})")
def normalize_text_query(spark, d):
    return inputs.noisy_documents(spark, d).select("doc_id", normalize_text(F.col("text")).alias("cleaned"))


def noisy_elements(spark: SparkSession, d: str) -> DataFrame:
    """Noisy documents as one element each, labels by document number; some padded, some with their text in another field."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("paragraph", "code", "page_header", "text", "list_item")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return inputs.noisy_documents(spark, d).select(
        "doc_id", F.lit("texts").alias("grp"), F.lit(0).alias("idx"), F.lit("#/texts/0").alias("ref"), label.alias("label"), "text",
        F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("  "), "text", F.lit(" "))).when(F.col("doc_id") % 4 < 2, F.col("text")).alias("own_text"),
        F.array(F.lit(1)).alias("pages"), F.when(F.col("doc_id") % 7 == 0, "furniture").otherwise("body").alias("layer"),
    )


_NOISY_LABEL = "case doc_id % 5 when 0 then 'paragraph' when 1 then 'code' when 2 then 'page_header' when 3 then 'text' else 'list_item' end"
_CHANGES = f"""own as (select doc_id, case when doc_id % 4 = 2 then '  ' || text || ' ' when doc_id % 4 < 2 then text end as text from ({NOISY_SQL})),
n as (select doc_id, text, case when doc_id % 5 in (1, 2) or doc_id % 7 = 0 then text else {_outside_urls('text')} end as cleaned from own)"""


@query("clean_changes", f"""
with {_CHANGES} select doc_id, 'conservative_text_cleanup' as rule, '#/texts/0' as node_ref, cast(length(text) as integer) as before_chars,
cast(length(cleaned) as integer) as after_chars, left(text, 120) as before_sample, left(cleaned, 120) as after_sample, [1] as page_numbers from n where text <> cleaned""")
def clean_changes(spark, d):
    return elements.change_log(elements.clean_elements(noisy_elements(spark, d)))


def noisy_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the noisy documents as a padded table cell."""
    lines = inputs.noisy_documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.select(
        "doc_id", F.concat(F.lit("#/tables/0/data/table_cells/"), F.col("k").cast("string")).alias("cell_ref"),
        F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), F.array(F.lit(2)).alias("page_numbers"),
    )


_CELLS = f"""cells as (select doc_id, '#/tables/0/data/table_cells/' || (k - 1) as ref, ' ' || w || ' ' as before from
(select doc_id, unnest(l) as w, generate_subscripts(l, 1) as k from (select doc_id, string_split(text, chr(10)) as l from ({NOISY_SQL}))))"""


@query("clean_cell_changes", f"""
with {_CELLS}, n as (select *, {_outside_urls('before')} as after from cells)
select doc_id, 'conservative_text_cleanup' as rule, ref as node_ref, [2] as page_numbers, cast(length(before) as integer) as before_chars,
cast(length(after) as integer) as after_chars, left(before, 120) as before_sample, left(after, 120) as after_sample from n where before <> after""")
def clean_cell_changes(spark, d):
    return elements.cell_change_log(noisy_cells(spark, d))


@query("clean_change_counts", f"with {_CHANGES} select doc_id, count(*) as change_count from n where text <> cleaned group by 1")
def clean_change_counts(spark, d):
    return elements.change_counts(elements.change_log(elements.clean_elements(noisy_elements(spark, d))))


_CODE_NOISY = f"({_NOISY_LABEL} = 'code' or regexp_matches(text, '{CODE_SQL}'))"


@query("normalize_patches", f"""
with n as (select doc_id, text as before, case when {_CODE_NOISY} then text else {STRIP_SQL.format(_outside_urls('text', False))} end as after from ({NOISY_SQL})), {_CELLS}
select doc_id, 'set_text' as op, '#/texts/0' as ref, 'normalize text noise' as reason, before, after from n where before <> after
union all select doc_id, 'set_table_cell_text', ref, 'normalize table cell', before, {STRIP_SQL.format(_outside_urls('before', False))} from cells
where before <> {STRIP_SQL.format(_outside_urls('before', False))}""")
def normalize_patches(spark, d):
    return elements.normalization_patches(noisy_elements(spark, d), noisy_cells(spark, d))


_WORDS = f"select doc_id, generate_subscripts(l, 1) - 1 as k, unnest(l) as w from (select doc_id, regexp_split_to_array(text, '[ \\n]') as l from ({NOISY_SQL}))"


@query("symbol_cells", f"""
select doc_id, k, case when regexp_matches(w, '^[.…‐‑‒–—―-]+$') then '' else w end as cell, regexp_matches(w, '^[.…‐‑‒–—―-]+$') as symbol_only from ({_WORDS})""")
def symbol_cells(spark, d):
    words = inputs.noisy_documents(spark, d).select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("k", "w"))
    return words.select("doc_id", F.col("k").cast("bigint").alias("k"), blank_symbol_cell(F.col("w")).alias("cell"), is_symbol_only(F.col("w")).alias("symbol_only"))


@query("protected_cells", rf"""
select doc_id, k, regexp_matches(w, 'https?://[^\s)>"]+') or regexp_matches(w, '^[\pL\pN_./:\\-]+$') or regexp_matches(w, '^(Traceback|[A-Za-z_][\pL\pN_-]*\s*=|def |class |import )') as is_protected from ({_WORDS})""")
def protected_cells(spark, d):
    words = inputs.noisy_documents(spark, d).select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("k", "w"))
    return words.select("doc_id", F.col("k").cast("bigint").alias("k"), looks_protected(F.col("w")).alias("is_protected"))


@query("hyphenation", rf"select doc_id, regexp_replace(text, '(\p{{Ll}})-\n(\p{{Ll}})', '\1\2', 'g') as text from ({NOISY_SQL})")
def hyphenation(spark, d):
    return inputs.noisy_documents(spark, d).select("doc_id", repair_hyphenation(F.col("text")).alias("text"))


TRACE = 'Traceback (most recent call last):\n  File "app.py", line 10, in run\n    start()\nRuntimeError: failed\n'
ASCII = "NAME       PID   CPU\npython     1234  10%\npostgres   2234  5%\nx  y\n"


def block_documents(spark: SparkSession, d: str) -> DataFrame:
    """Noisy documents with a stack trace and a column table in the text."""
    return inputs.noisy_documents(spark, d).select(
        "doc_id", F.concat(F.col("text"), F.lit("\n" + TRACE), F.when(F.col("doc_id") % 2 == 0, ASCII).otherwise("plain\n"), F.col("text")).alias("text")
    )


def _sql_text(value: str) -> str:
    return inputs._sql_text(value)


_BLOCK_DOCS = f"select doc_id, text || {_sql_text(chr(10) + TRACE)} || case when doc_id % 2 = 0 then {_sql_text(ASCII)} else {_sql_text('plain' + chr(10))} end || text as text from ({NOISY_SQL})"
_BLOCK_LINES = LINES_SQL.replace("from documents", f"from ({_BLOCK_DOCS})")


def _isles_sql(test: str, extra: str, block: str, min_lines: int = 2) -> str:
    return rf"""
with l as materialized ({_BLOCK_LINES}), f as (select *, {test} as is_on, {extra} as mark from l),
b as (select *, case when is_on and lag(is_on) over w and mark = lag(mark) over w then 0 else 1 end as fresh from f window w as (partition by doc_id order by idx)),
g as (select *, sum(fresh) over (partition by doc_id order by idx) as isle from b)
select doc_id, '{block}' as block, cast(min(idx) as integer) as first_line, cast(max(idx) as integer) as last_line, string_agg(line, chr(10) order by idx) as block_text
from g where is_on group by doc_id, isle having count(*) >= {min_lines}"""


@query("log_blocks", _isles_sql(r"regexp_matches(line, '^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}')", "''", "log"))
def log_blocks(spark, d):
    return blocks.log_blocks(block_documents(spark, d))


@query("report_blocks", _isles_sql(r"regexp_matches(line, '^\s*\S[^:]*\S?\s*:\s+\S') and not regexp_matches(line, '^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}')", "''", "report"))
def report_blocks(spark, d):
    return blocks.report_blocks(block_documents(spark, d))


@query("ascii_tables", _isles_sql(
    "list_count(list_filter(range(2, length(line)), lambda i: line[i+1] <> ' ' and line[i] = ' ' and line[i-1] = ' ')) + (case when line[1] <> ' ' and line <> '' then 1 else 0 end) >= 2",
    "array_to_string(list_filter(range(2, length(line)), lambda i: line[i+1] <> ' ' and line[i] = ' ' and line[i-1] = ' '), ',') || '/' || (line[1] <> ' ')", "ascii_table"))
def ascii_tables(spark, d):
    return blocks.ascii_tables(block_documents(spark, d))


@query("stack_traces", rf"""
with l as materialized ({_BLOCK_LINES}), last as (select doc_id, max(idx) as m from l group by 1),
e as (select doc_id, idx, line, lead(idx) over w as nxt, lead(line) over w as nxt_line from l where not regexp_matches(line, '^\s+\S') window w as (partition by doc_id order by idx)),
t as (select e.doc_id, idx as a, case when nxt is null then m when nxt_line like 'Traceback (most recent call last):%' then nxt - 1 else nxt end as b from e join last using (doc_id) where line like 'Traceback (most recent call last):%')
select t.doc_id, 'stack_trace' as block, cast(a as integer) as first_line, cast(b as integer) as last_line, string_agg(line, chr(10) order by idx) as block_text
from t join l on l.doc_id = t.doc_id and l.idx between a and b group by 1, 2, 3, 4""")
def stack_traces(spark, d):
    return blocks.stack_traces(block_documents(spark, d))


@query("fragment_merge", rf"""
with e as ({ELEMENTS_SQL}), p as (select *, lag(label) over w as pl, lag(text) over w as pt, lag(page) over w as pp from e window w as (partition by doc_id order by idx)),
g as (select *, coalesce(page = pp and label not in ('title', 'section_header', 'code') and pl not in ('title', 'section_header', 'code') and
 (label = pl)::int + (not regexp_matches(pt, '[.!?。！？:：;；]$'))::int + regexp_matches(text, '^\p{{Ll}}')::int >= 2, false) as glued from p),
r as (select *, max(case when not glued then idx end) over (partition by doc_id order by idx) as head from g)
select doc_id, head as pos, min_by(label, idx) as label, string_agg(text, ' ' order by idx) as text, string_agg(ref, ',' order by idx) as refs from r group by 1, 2""")
def fragment_merge(spark, d):
    merged = blocks.merge_fragments(line_table(spark, d), threshold=2)
    return merged.select("doc_id", "pos", "label", "text", F.array_join("refs", ",").alias("refs"))


_BOX_SQL = """
x as (select *, case when idx % 50 = 0 then 50.0 when idx % 50 <= 24 then 50.0 + idx % 5 else 310.0 + idx % 3 end as l,
 100.0 + 20 * (idx % 50 % 25) + case when idx % 6 = 0 then 15 else 0 end as t from e),
y as (select *, case when idx % 50 = 0 then 500.0 else 60.0 + least(length(line), 180) end as width, 9.0 + 2 * (idx % 4) as height from x)"""


def boxed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Lines on pages of two columns under a title; the last line of the left column goes on in the right one."""
    def item(line, i):
        slot = i % 50
        left = F.when(slot == 0, 50.0).when(slot <= 24, 50.0 + i % 5).otherwise(310.0 + i % 3)
        top = 100.0 + 20 * (slot % 25) + F.when(i % 6 == 0, 15).otherwise(0)
        width = F.when(slot == 0, 500.0).otherwise(60.0 + F.least(F.length(line), F.lit(180)))
        page = (F.floor(i / 50) + 1).cast("int").alias("page_no")
        box = F.struct(left.alias("l"), (-top).alias("t"), (left + width).alias("r"), (-(top + 9.0 + 2 * (i % 4))).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
        over = F.struct(F.lit(310.0).alias("l"), F.lit(-85.0).alias("t"), F.lit(400.0).alias("r"), F.lit(-93.0).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
        here = F.struct(page, box.alias("bbox"))
        return F.struct(
            F.when(slot == 0, "title").otherwise("text").alias("label"), line.alias("text"),
            F.when(slot == 24, F.array(here, F.struct(page, over.alias("bbox")))).otherwise(F.array(here)).alias("prov"),
            F.when(i % 11 == 0, F.struct(F.lit(True).alias("bold"))).alias("formatting"),
        )

    return inputs.documents(spark, d).select("doc_id", F.to_json(F.struct(F.transform(lines_of(F.col("text")), item).alias("texts"))).alias("payload"))


@query("fragment_merge_columns", rf"""
with e as (select doc_id, idx, line, {STRIP_SQL.format('line')} as text, case when idx % 50 = 0 then 'title' else 'text' end as label, idx // 50 as page from ({LINES_SQL})), {_BOX_SQL},
b as (select doc_id, idx, 0 as k, page, l, t, l + width as r, t + height as b from y union all
 select doc_id, idx, 1, page, 310.0, 85.0, 400.0, 93.0 from y where idx % 50 = 24),
n as (select *, r - l <= (max(r) over (partition by doc_id, page) - min(l) over (partition by doc_id, page)) * 0.6 as narrow from b),
o as (select *, narrow and l > coalesce(max(case when narrow then r end) over (partition by doc_id, page order by l, r, idx rows between unbounded preceding and 1 preceding), -1e9) - 8 as opens from n),
c as (select *, sum(opens::int) over (partition by doc_id, page order by l, r, idx rows between unbounded preceding and current row) as no from o),
s as (select *, case when max(no) over (partition by doc_id, page) <= 1 then 0 when narrow then no else -1 end as col from c),
f as (select e.*, i.col as col_in, i.t as t_in, q.col as col_out, q.b as b_out from e
 join s i on i.doc_id = e.doc_id and i.idx = e.idx and i.k = 0 join s q on q.doc_id = e.doc_id and q.idx = e.idx and q.k = (e.idx % 50 = 24)::int),
p as (select *, lag(label) over w as pl, lag(text) over w as pt, lag(page) over w as pp, lag(col_out) over w as pc, lag(b_out) over w as pb from f window w as (partition by doc_id order by idx)),
g as (select *, coalesce(page = pp and label = 'text' and pl = 'text' and col_in = pc and abs(t_in - pb) <= 12
 and (label = pl)::int + (not regexp_matches(pt, '[.!?。！？:：;；]$'))::int + regexp_matches(text, '^\p{{Ll}}')::int >= 1, false) as glued from p),
r as (select *, max(case when not glued then idx end) over (partition by doc_id order by idx) as head from g)
select doc_id, head as pos, min_by(label, idx) as label, string_agg(text, ' ' order by idx) as text, string_agg('#/texts/' || idx, ',' order by idx) as refs from r group by 1, 2""")
def fragment_merge_columns(spark, d):
    flat = elements.element_table(elements.element_arrays(boxed_payloads(spark, d), order="index"))
    # fragments are read twice, for their runs and for what one segment hands to the next
    flat = Rounds(spark).keep("elements", flat.select("doc_id", "pos", "grp", "ref", "label", "text", "style", "pages", "boxes"))
    merged = blocks.merge_fragments(flat, threshold=1)
    return merged.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "label", "text", F.array_join("refs", ",").alias("refs"))
