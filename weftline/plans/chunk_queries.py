"""Registered queries of the chunking, glossary and translation families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking, glossary, translation
from weftline.plans import inputs
from weftline.plans.element_queries import kept_lines, line_table
from weftline.plans.inputs import ELEMENTS_SQL, GLOSSARY_SQL, SHORT_TERMS_SQL, table

Q: dict = {}
SQL: dict = {}
KEYS = ("doc_id",)


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def chunks(spark: SparkSession, d: str, segment_rows: int | None = None) -> DataFrame:
    return chunking.build_chunks(inputs.document_arrays(spark, d), segment_rows=segment_rows)


_FENCE = "'```' || chr(10) || text || chr(10) || '```'"
_LEVEL = "case when level > 0 then least(level, 6) when label = 'title' then 1 else 2 end"


def chunk_sql(low: int = 1000, high: int = 2000) -> str:
    """Chunk packing as a recursion over the lines of all documents at once."""
    return f"""
e as ({ELEMENTS_SQL}), b as (select doc_id, row_number() over (partition by doc_id order by idx) as k, ref, page,
 case when label = 'code' then 2 when label in ('title', 'section_header') then 1 else 0 end as code, {_LEVEL} as level,
 case when label in ('title', 'section_header') then repeat('#', {_LEVEL}) || ' ' || text when label = 'code' then {_FENCE} else text end as md
 from e where text <> ''),
r as (
 select doc_id, 0 as k, cast(0 as bigint) as chunk_no, cast(0 as bigint) as pending, cast([] as varchar[]) as path, cast([] as varchar[]) as closed_path, false as closes from (select distinct doc_id from b)
 union all
 select r.doc_id, r.k + 1,
  case when b.code = 2 or r.pending = 0 or (b.code = 1 and r.pending >= {low}) then r.chunk_no + 1 else r.chunk_no end,
  case when b.code = 2 then 0
       when b.code = 0 and r.pending + length(b.md) >= {high} then 0
       when b.code = 1 and r.pending >= {low} then length(b.md)
       else r.pending + length(b.md) end,
  case when b.code = 1 then list_append(r.path[1:b.level - 1], b.md) else r.path end, r.path, r.pending > 0 and b.code = 1 and r.pending >= {low}
 from r join b on b.doc_id = r.doc_id and b.k = r.k + 1),
m as (select b.*, r.chunk_no, r.path from b join r on r.doc_id = b.doc_id and r.k = b.k),
shut as (select r.doc_id, p.chunk_no, r.path from r join r p on p.doc_id = r.doc_id and p.k = r.k - 1 where r.closes),
chunks as (select m.doc_id, m.chunk_no, 'chunk-' || lpad(cast(m.chunk_no as varchar), 4, '0') as chunk_id, case when max(m.code) = 2 then 'code' else 'text' end as kind,
 array_to_string(coalesce(any_value(shut.path), max_by(m.path, m.k)), '|') as header_path,
 string_agg(md, chr(10) || chr(10) order by m.k) as source_text, string_agg(ref, ',' order by m.k) as refs, string_agg(distinct cast(page as varchar), ',' order by cast(page as varchar)) as pages
 from m left join shut on shut.doc_id = m.doc_id and shut.chunk_no = m.chunk_no group by 1, 2)"""


_CHUNKS = "with recursive " + chunk_sql()


def _chunk_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "chunk_no", "chunk_id", "kind", F.array_join("header_path", "|").alias("header_path"), "source_text",
        F.array_join("source_node_refs", ",").alias("refs"), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"),
    )


@query("chunk_pack", _CHUNKS + " select * from chunks")
def chunk_pack(spark, d):
    return _chunk_view(chunks(spark, d))


@query("chunk_pack_segmented", _CHUNKS + " select * from chunks")
def chunk_pack_segmented(spark, d):
    """The same chunks with documents cut into short segments."""
    return _chunk_view(chunks(spark, d, segment_rows=64))


@query("chunk_pack_gathered", "with recursive " + chunk_sql(200, 500) + " select * from chunks")
def chunk_pack_gathered(spark, d):
    """Chunks from the element table, gathered by segment, with other bounds."""
    segments = chunking.gather_segments(line_table(spark, d), segment_rows=64)
    return _chunk_view(chunking.pack_segments(segments, 200, 500))


@query("chunk_violations", """
select doc_id, chunk_id, violation from (
select doc_id, 'chunk-0001' as chunk_id, case doc_id % 5 when 1 then 'empty translatable chunk' when 2 then 'unclosed code fence' when 3 then 'empty source_node_refs' end as violation from documents
union all select doc_id, 'chunk-0001', 'duplicate chunk_id' from documents where doc_id % 5 = 4) where violation is not null""")
def chunk_violations(spark, d):
    kind = F.col("doc_id") % 5
    docs = inputs.documents(spark, d)
    broken = docs.select(
        "doc_id", F.lit("chunk-0001").alias("chunk_id"), F.lit(True).alias("translatable"),
        F.when(kind == 1, " \n").when(kind == 2, F.concat(F.lit("```\n"), "text")).otherwise(F.col("text")).alias("source_text"),
        F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("#/texts/0"))).alias("source_node_refs"),
    )
    again = broken.filter(F.col("doc_id") % 5 == 4)
    return chunking.chunk_violations(broken.unionByName(again))


@query("heading_tails", _CHUNKS + r""", n as (select doc_id, chunk_no, chunk_id, source_text, lead(kind) over (partition by doc_id order by chunk_no) as next_kind from chunks)
select doc_id, chunk_no, chunk_id, next_kind from n where next_kind is not null and regexp_matches(source_text, '(^|\n)#{1,6} [^\n]*$')""")
def heading_tails(spark, d):
    return chunking.heading_tails(chunks(spark, d))


@query("section_items", f"""
with e as ({ELEMENTS_SQL}), h as (select *, max(case when label in ('title', 'section_header') then idx end) over (partition by doc_id order by idx) as hp from e)
select h.doc_id, coalesce(hp, -1) as section_pos, coalesce(t.text, '') as section_title, h.idx as pos, h.ref as item_id, h.text
from h left join e t on t.doc_id = h.doc_id and t.idx = hp where h.text <> '' and h.label not in ('title', 'section_header')""")
def section_items(spark, d):
    return chunking.section_items(line_table(spark, d), segment_rows=32)


@query("translation_requests", f"""
with recursive e as ({ELEMENTS_SQL}), h as (select *, max(case when label in ('title', 'section_header') then idx end) over (partition by doc_id order by idx) as hp from e),
i as (select h.doc_id, coalesce(hp, -1) as section_pos, coalesce(t.text, '') as section_title, h.idx, h.ref, h.text, row_number() over (partition by h.doc_id, hp order by h.idx) as k
 from h left join e t on t.doc_id = h.doc_id and t.idx = hp where h.text <> '' and h.label not in ('title', 'section_header')),
r(doc_id, section_pos, k, filled, request_no) as (
 select doc_id, section_pos, k, length(text), 0 from i where k = 1 union all
 select i.doc_id, i.section_pos, i.k, case when r.filled + length(i.text) > 900 then length(i.text) else r.filled + length(i.text) end,
  r.request_no + (r.filled + length(i.text) > 900)::int from r join i on i.doc_id = r.doc_id and i.section_pos = r.section_pos and i.k = r.k + 1)
select doc_id, section_pos, request_no, coalesce(any_value(d.text), '') as document_title, any_value(i.section_title) as section_title, cast(sum(length(i.text)) as bigint) as chars,
 string_agg(i.ref, ',' order by idx) as ids, sha256(string_agg(i.text, chr(10) order by idx)) as texts
from i join r using (doc_id, section_pos, k) left join (select doc_id, text from e where idx = 0) d using (doc_id) group by doc_id, section_pos, request_no""")
def translation_requests(spark, d):
    lines = kept_lines(spark, d, "doc_id", "pos", "ref", "label", "text")
    made = chunking.translation_requests(lines, limit=900, segment_rows=16)
    part = lambda c: F.transform("items", lambda i: i[c])
    return made.select(
        "doc_id", "section_pos", "request_no", "document_title", "section_title", "chars", F.array_join(part("id"), ",").alias("ids"),
        F.sha2(F.array_join(part("text"), "\n").cast("binary"), 256).alias("texts"))


_LAST = f"g as ({GLOSSARY_SQL}), last as (select english, max_by(japanese, seq) as japanese, max_by(genre, seq) as genre, max_by(description, seq) as description from g group by 1)"


@query("glossary_last_wins", f"with {_LAST} select * from last")
def glossary_last_wins(spark, d):
    return glossary.effective_entries(inputs.glossary(spark, d))


@query("glossary_counts", f"with g as ({GLOSSARY_SQL}) select count(*) as raw_count, count(distinct english) as effective_count from g")
def glossary_counts(spark, d):
    return glossary.entry_counts(inputs.glossary(spark, d))


@query("glossary_problems", f"with g as ({GLOSSARY_SQL}) select seq, english from g where seq % 11 = 0")
def glossary_problems(spark, d):
    """Entries without a translation; rows blank throughout are no entries."""
    raw = inputs.glossary(spark, d)
    blank = F.col("seq") % 13 == 0
    worse = raw.withColumn("japanese", F.when(F.col("seq") % 11 == 0, "  ").otherwise(F.col("japanese")))
    empty = raw.filter(blank).select(F.col("seq") + 1000000000, *[F.lit(" ").alias(c) for c in glossary.COLUMNS]).toDF("seq", *glossary.COLUMNS)
    return glossary.entry_problems(worse.unionByName(empty)).select("seq", "english")


_TERMS = f"t as ({SHORT_TERMS_SQL}), terms as (select english, max_by(japanese, seq) as japanese from t group by 1)"


@query("glossary_match", f"with {_TERMS} select doc_id, english from documents, terms where contains(lower(text), english)")
def glossary_match(spark, d):
    terms = glossary.effective_entries(inputs.short_terms(spark, d))
    return glossary.matches(inputs.documents(spark, d), terms, "text", KEYS)


@query("glossary_search", f"with {_TERMS} select cast(conv_id * 1000 + turn as bigint) as doc_id, english from conversations, terms where contains(lower(text), english)")
def glossary_search(spark, d):
    """The same search over conversation turns."""
    texts = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    terms = glossary.effective_entries(inputs.short_terms(spark, d))
    return glossary.matches(texts, terms, "text", KEYS)


_FILL = f"""{_TERMS}, hit as (select doc_id, english, true as matched from documents, terms where contains(lower(text), english)),
pool as (select d.doc_id, t.english, t.japanese, h.matched is not null as matched from documents d cross join terms t left join hit h on h.doc_id = d.doc_id and h.english = t.english),
picked as (select *, row_number() over (partition by doc_id order by matched desc, english) as rank from pool)"""


@query("glossary_fill", f"with {_FILL} select doc_id, english, japanese, matched, cast(rank as integer) as rank from picked where rank <= 80")
def glossary_fill(spark, d):
    terms = glossary.effective_entries(inputs.short_terms(spark, d))
    return glossary.select_entries(inputs.documents(spark, d), terms, text="text", keys=KEYS).select("doc_id", "english", "japanese", "matched", "rank")


@query("glossary_prompt", f"with {_FILL} select doc_id, string_agg('- ' || english || ' => ' || japanese, chr(10) order by rank) as glossary_text from picked where rank <= 80 group by 1")
def glossary_prompt(spark, d):
    terms = glossary.effective_entries(inputs.short_terms(spark, d))
    told = glossary.with_prompt_terms(inputs.documents(spark, d), terms, text="text", keys=KEYS)
    return told.filter("glossary_text IS NOT NULL").select("doc_id", "glossary_text")


@query("glossary_lines", f"""
with {_LAST} select '- ' || english || ' => ' || japanese || case when genre <> '' then ' / ' || genre else '' end || case when description <> '' then ' / ' || description else '' end as line from last""")
def glossary_lines(spark, d):
    return glossary.effective_entries(inputs.glossary(spark, d)).select(glossary.entry_line().alias("line"))


@query("translation_messages", f"""
with {_FILL}, lines as (select doc_id, string_agg('- ' || english || ' => ' || japanese, chr(10) order by rank) as g from picked where rank <= 80 group by 1)
select d.doc_id, 'system,user' as roles, {inputs._sql_text(glossary.USER_PROMPT_HEAD)} || g || {inputs._sql_text(glossary.USER_PROMPT_MIDDLE)} || text || chr(10) as user_message from documents d join lines using (doc_id)""")
def translation_messages(spark, d):
    terms = glossary.effective_entries(inputs.short_terms(spark, d))
    docs = inputs.documents(spark, d).withColumnRenamed("text", "source_text")
    asked = glossary.translation_messages(glossary.with_prompt_terms(docs, terms, keys=KEYS), keys=KEYS)
    return asked.select(
        "doc_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.get("messages", F.lit(1))["content"].alias("user_message"),
    )


def units(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as units of an earlier run in mixed states."""
    state = F.element_at(F.array(*[F.lit(s) for s in ("success", "running", "skipped", "failed", "fallback_source")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "labels").select("doc_id", F.lit("chunk-0001").alias("chunk_id"), state.alias("status"))


def one_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk."""
    return table(spark, d, "documents").select(
        "doc_id", F.lit("chunk-0001").alias("chunk_id"), F.when(F.col("lang") == "es", "code").otherwise("text").alias("kind"),
        (F.col("lang") != "fr").alias("translatable"), F.col("text").alias("source_text"),
    )


def _outputs(spark, d):
    """Output rows exist for documents of good quality only."""
    done = table(spark, d, "labels").filter(F.col("quality") == 1).select("doc_id")
    return one_chunk(spark, d).join(done, "doc_id", "left_semi").withColumn("translated_text", F.concat(F.lit("訳:"), "source_text"))


_REUSED = "reused as (select doc_id from labels where quality = 1 and doc_id % 5 in (0, 2, 4))"


@query("resume_todo", f"with {_REUSED} select doc_id, 'chunk-0001' as chunk_id from documents where doc_id not in (select doc_id from reused)")
def resume_todo(spark, d):
    todo, _ = translation.split_work(one_chunk(spark, d), units(spark, d), _outputs(spark, d))
    return todo.select("doc_id", "chunk_id")


@query("resume_reuse", f"with {_REUSED} select doc_id, '訳:' || text as translated_text from documents where doc_id in (select doc_id from reused)")
def resume_reuse(spark, d):
    _, reuse = translation.split_work(one_chunk(spark, d), units(spark, d), _outputs(spark, d))
    return reuse.select("doc_id", "translated_text")


@query("skipped_chunks", "select doc_id, text as translated_text, 'skipped' as status from documents where lang in ('fr', 'es')")
def skipped_chunks(spark, d):
    return translation.skipped_rows(one_chunk(spark, d)).select("doc_id", "translated_text", "status")


@query("memory_lookup", """
with m as (select text, max_by('訳 ' || doc_id, doc_id) as t from documents where lang in ('en', 'de') group by 1)
select d.doc_id, sha256(d.text) as source_sha256, m.t as translated_text from documents d left join m using (text)""")
def memory_lookup(spark, d):
    docs = table(spark, d, "documents")
    memory = docs.filter(F.col("lang").isin("en", "de")).select(
        F.sha2("text", 256).alias("source_sha256"), F.concat(F.lit("訳 "), F.col("doc_id").cast("string")).alias("translated_text"), F.col("doc_id").alias("updated_at"),
    )
    return translation.memory_lookup(docs.select("doc_id", F.col("text").alias("source_text")), memory).drop("source_text")


@query("plugged_translation", "select doc_id, '訳:' || text as translated_text from documents")
def plugged_translation(spark, d):
    docs = inputs.documents(spark, d).withColumnRenamed("text", "source_text")
    return translation.plug_translate(docs, lambda texts: "訳:" + texts).select("doc_id", "translated_text")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Up to twelve attempts per document; which of them succeed varies."""
    tries = F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 13).cast("int")))
    docs = inputs.documents(spark, d).filter(F.col("doc_id") % 13 > 0)
    rows = docs.select("doc_id", F.lit("chunk-0001").alias("chunk_id"), "text", tries.alias("attempt"))
    good = F.col("attempt") * 3 >= F.col("doc_id") % 40
    return rows.select(
        "doc_id", "chunk_id", "attempt",
        F.when(good, F.concat(F.lit("訳"), "text")).when(F.col("attempt") % 2 == 0, F.concat(F.lit("```"), "text")).otherwise(" ").alias("text"),
        F.when(~good & (F.col("attempt") % 3 == 0), F.repeat(F.lit("timeout "), 100)).alias("error"),
    )


@query("settle_attempts", """
with a as (select doc_id, text, unnest(range(1, doc_id % 13 + 1)) as attempt from documents where doc_id % 13 > 0),
j as (select *, attempt * 3 >= doc_id % 40 as good from a where attempt <= 10),
w as (select *, case when good then null when attempt % 3 = 0 then left(repeat('timeout ', 100), 500) when attempt % 2 = 0 then 'code fence count changed' else 'translated text is empty' end as wrong from j),
s as (select doc_id, min(case when good then attempt end) as hit, max_by(wrong, attempt) as last_error, max(attempt) as tried from w group by 1)
select doc_id, case when lang in ('fr', 'es') then 'skipped' when hit is not null then 'success' else 'fallback_source' end as status,
case when lang not in ('fr', 'es') and hit is not null then '訳' || text else text end as translated_text,
case when lang not in ('fr', 'es') and hit is null then coalesce(last_error, 'no attempt left') end as error,
case when lang in ('fr', 'es') then 0 else coalesce(hit, tried, 0) end as attempts from documents left join s using (doc_id)""")
def settle_attempts(spark, d):
    settled = translation.settle_attempts(one_chunk(spark, d), attempts(spark, d))
    return settled.select("doc_id", "status", "translated_text", "error", F.col("attempts").cast("bigint").alias("attempts"))


@query("validate_translation", """
select doc_id, case doc_id % 5 when 0 then 'translated text is empty' when 1 then 'code fence count changed' when 2 then 'markdown table row count changed' when 3 then 'markdown table column count changed' end as error from documents""")
def validate_translation(spark, d):
    kind = F.col("doc_id") % 5
    source = F.concat(F.lit("| a | b |\n| --- | --- |\n\n"), F.col("text"))
    target = (
        F.when(kind == 0, "\n \t").when(kind == 1, F.concat(F.lit("```\n"), source)).when(kind == 2, F.concat(F.lit("| x |\n"), source))
        .when(kind == 3, F.concat(F.lit("| a | b |\n| --- |\n\n"), F.col("text"))).otherwise(F.upper(source))
    )
    return inputs.documents(spark, d).select("doc_id", translation.translation_error(source, target, F.lit("table")).alias("error"))


@query("id_mismatches", """
select o_custkey as request_id, o_orderkey as item_id, case o_orderkey % 10 when 1 then 'missing id' when 2 then 'duplicate id' when 3 then 'source text changed' end as problem
from orders where o_orderkey % 10 in (1, 2, 3) union all select o_custkey, -o_orderkey - 1, 'unknown id' from orders where o_orderkey % 10 = 4""")
def id_mismatches(spark, d):
    o = table(spark, d, "orders")
    asked = o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("source_text"))
    kind = F.col("item_id") % 10
    back = asked.filter(kind != 1).withColumn("source_text", F.when(kind == 3, "changed").otherwise(F.col("source_text")))
    twice = back.filter(kind == 2)
    strange = asked.filter(kind == 4).withColumn("item_id", -F.col("item_id") - 1)
    return translation.id_mismatches(asked, back.unionByName(twice).unionByName(strange))


_LOST = " union all ".join(
    rf"""select doc_id, '{n}' as token_kind, token, sum(k) as missing from (select doc_id, unnest(regexp_extract_all(s, '{shape}')) as token, 1 as k from p
 union all select doc_id, unnest(regexp_extract_all(coalesce(t, ''), '{shape}')), -1 from p) group by 1, 2, 3 having sum(k) > 0"""
    for n, shape in translation.KEPT_SHAPES.items()
)


@query("lost_tokens", f"""
with n as ({inputs.NOISY_SQL}), p as (select doc_id, text || ' {{name}} `x=1` 5 GB 5 GB' as s,
case doc_id % 3 when 0 then text || ' {{name}} 5 GB' when 1 then replace(text, '1', '') end as t from n) {_LOST}""")
def lost_tokens(spark, d):
    """A repeated unit said once, numbers without their ones, and translations that are missing."""
    docs = inputs.noisy_documents(spark, d)
    kind = F.col("doc_id") % 3
    target = F.when(kind == 0, F.concat("text", F.lit(" {name} 5 GB"))).when(kind == 1, F.replace("text", F.lit("1"), F.lit("")))
    pairs = docs.select("doc_id", F.concat("text", F.lit(" {name} `x=1` 5 GB 5 GB")).alias("source_text"), target.alias("translated_text"))
    return translation.lost_tokens(pairs, KEYS)


@query("element_routes", f"""
with e as ({ELEMENTS_SQL}) select case when text = '' then 'empty' when label = 'code' or regexp_matches(raw_text, '{inputs.CODE_SQL}') then 'code' when label in ('title', 'section_header') then 'heading' else 'body' end as route,
count(*) as n from e group by 1""")
def element_routes(spark, d):
    return translation.element_route(line_table(spark, d)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("translated_elements", f"""
with e as ({ELEMENTS_SQL}), k as (select *, case when text = '' then 'empty' when label = 'code' or regexp_matches(raw_text, '{inputs.CODE_SQL}') then 'code' when label in ('title', 'section_header') then 'heading' else 'body' end as route from e)
select doc_id, idx, case route when 'heading' then text || ' / ' || '訳:' || text when 'body' then '訳:' || text else text end as render_text from k""")
def translated_elements(spark, d):
    lines = kept_lines(spark, d, "doc_id", "idx", "grp", "label", "text", "raw_text")
    texts = lines.select("text").distinct()
    memory = texts.select(F.sha2("text", 256).alias("source_sha256"), F.concat(F.lit("訳:"), "text").alias("translated_text"), F.lit(0).alias("updated_at"))
    return translation.translate_elements(lines.drop("text"), memory).select("doc_id", "idx", "render_text")


@query("translated_cells", """
select p_partkey as doc_id, col, case when col = 0 then p_type when col = 1 then '訳:' || p_name else '' end as render_text,
case when col = 0 then 'protected' when col = 1 then 'body' else 'empty' end as route from part, (values (0), (1), (2)) v(col)""")
def translated_cells(spark, d):
    cells = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(F.col("p_type"), F.col("p_name"), F.lit(" "))).alias("col", "text")
    )
    texts = cells.select("text").distinct()
    memory = texts.select(F.sha2("text", 256).alias("source_sha256"), F.concat(F.lit("訳:"), "text").alias("translated_text"), F.lit(0).alias("updated_at"))
    return translation.translate_cells(cells, memory).select("doc_id", "col", "render_text", "route")
