"""Registered queries of the patch and redaction families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.redact import mask_secrets, mask_string_fields, redact_known, redact_table
from weftline.operators import patches
from weftline.operators.rows import unpack
from weftline.plans import inputs
from weftline.plans.element_queries import kept_lines, line_table
from weftline.plans.inputs import ELEMENTS_SQL, LINES_SQL, NOISY_SQL, table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("page_units", f"""
with e as ({ELEMENTS_SQL}) select doc_id, page as page_no, 'page-' || lpad(cast(page as varchar), 4, '0') as unit_id, idx, ref, label, text from e""")
def page_units(spark, d):
    return patches.page_units(line_table(spark, d))


@query("structure_units", f"with e as ({ELEMENTS_SQL}) select doc_id, idx, ref, page, label, coalesce(level, 0) as level, left(raw_text, 500) as text from e")
def structure_units(spark, d):
    units = patches.structure_units(line_table(spark, d))
    return units.withColumn("page", F.get("page", F.lit(0))).withColumn("level", F.coalesce("level", F.lit(0)))


PATCHES = '{"patches":[{"op":"set_label","ref":"#/texts/0","label":"title"},{"op":"set_level","ref":"#/texts/1","level":2}]}'
BAD_OP = '{"patches":[{"op":"set_label","ref":"#/texts/0","label":"title"},{"op":"explode","ref":"#/texts/1"}]}'


def responses(spark: SparkSession, d: str) -> DataFrame:
    """One model response per document in one of eight shapes, some broken."""
    kind = F.col("doc_id") % 8
    raw = (
        F.when(kind == 0, PATCHES).when(kind == 1, "```json\n" + PATCHES + "\n```").when(kind == 2, F.concat(F.lit("Sure {x}: "), F.lit(PATCHES), F.lit(" done")))
        .when(kind == 3, "  \n").when(kind == 4, BAD_OP).when(kind == 5, F.concat(F.lit("no json: "), F.substring("text", 1, 20)))
        .when(kind == 6, '{"patches":[]}').otherwise('{"result":1}')
    )
    return inputs.documents(spark, d).select(F.col("doc_id").cast("string").alias("unit_id"), raw.alias("raw"))


@query("patch_responses", """
select cast(doc_id as varchar) as unit_id, seq, op, ref, coalesce(label, '') as label, coalesce(level, 0) as level from documents,
(values (0, 'set_label', '#/texts/0', 'title', null), (1, 'set_level', '#/texts/1', null, 2)) v(seq, op, ref, label, level) where doc_id % 8 <= 2""")
def patch_responses(spark, d):
    good, _ = patches.read_responses(responses(spark, d))
    return good.select("unit_id", "seq", "op", "ref", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("level", F.lit(0)).alias("level"))


@query("patch_responses_lenient", """
select cast(doc_id as varchar) as unit_id, seq, op from documents,
(values (0, 'set_label', 'any'), (1, 'set_level', 'good'), (1, 'explode', 'bad')) v(seq, op, k)
where (doc_id % 8 <= 1 and k <> 'bad') or (doc_id % 8 = 4 and k <> 'good')  or (doc_id % 8 = 2 and k <> 'bad')""")
def patch_responses_lenient(spark, d):
    good, _ = patches.read_responses(responses(spark, d), strict=False)
    return good.select("unit_id", "seq", "op")


@query("patch_rejects", """
select cast(doc_id as varchar) as unit_id, case doc_id % 8 when 3 then 'response was empty' when 4 then 'invalid patch object'
when 5 then 'no patches object in response: no json: ' || rtrim(replace(left(text, 20), chr(10), '\\n')) else 'response must be an object with a patches array' end as reason
from documents where doc_id % 8 in (3, 4, 5, 7)""")
def patch_rejects(spark, d):
    _, bad = patches.read_responses(responses(spark, d))
    return bad


_PATCH_ROWS = (
    (1, "set_label", "#/texts/0", None, "section_header", None), (2, "set_level", "#/texts/0", None, None, 3),
    (3, "set_text", "#/texts/0", "First", None, None), (4, "set_text", "#/texts/0", "Second", None, None),
    (5, "set_text", "#/texts/999999", "Lost", None, None), (6, "drop", "#/texts/0", None, None, None), (7, "set_text", "#/texts/1", None, None, None),
)
_PATCH_SQL = "(values " + ", ".join(
    "(" + ", ".join("null" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in row) + ")" for row in _PATCH_ROWS
) + ") p(seq, op, ref, text, label, level)"


def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same seven patches for every document."""
    rows = F.array(*[
        F.struct(
            F.lit(s).alias("seq"), F.lit(op).alias("op"), F.lit(ref).alias("ref"), F.lit(text).cast("string").alias("text"),
            F.lit(label).cast("string").alias("label"), F.lit(level).cast("int").alias("level"),
        )
        for s, op, ref, text, label, level in _PATCH_ROWS
    ])
    return unpack(inputs.documents(spark, d), ["doc_id"], rows)


@query("patch_audit", f"""
with e as ({ELEMENTS_SQL}), p as (select doc_id, p.* from documents, {_PATCH_SQL}),
j as (select p.doc_id, p.seq, p.ref, p.op, coalesce(p.text, p.label, cast(p.level as varchar)) as after, e.text as et, e.label as el, e.level as ev, e.idx from p left join e on p.doc_id = e.doc_id and p.ref = e.ref),
k as (select *, case when op = 'drop' then 'unsupported patch op: drop' when idx is null then 'unknown ref: ' || ref when after is null then 'patch has no value' end as error from j)
select doc_id, seq, ref, op, case when error is null then 'success' else 'failed' end as status,
case when error is null then coalesce(lag(after) over (partition by doc_id, ref, op order by seq), case op when 'set_text' then et when 'set_label' then el else cast(ev as varchar) end) end as before,
case when error is null then after end as after, error from k""")
def patch_audit(spark, d):
    return patches.patch_audit(line_table(spark, d), patch_rows(spark, d))


@query("patch_apply", f"""
with e as ({ELEMENTS_SQL}) select doc_id, idx, case when idx = 0 then 'section_header' else label end as label,
case when idx = 0 then 3 else coalesce(level, 0) end as level, case when idx = 0 then 'Second' else text end as text from e""")
def patch_apply(spark, d):
    return patches.apply_field_patches(line_table(spark, d), patch_rows(spark, d)).select("doc_id", "idx", "label", F.coalesce("level", F.lit(0)).alias("level"), "text")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Second and first line swapped; some orders name unknown or repeated refs."""
    kind = F.col("doc_id") % 4
    refs = (
        F.when(kind == 1, F.array(F.lit("#/texts/1"), F.lit("#/texts/999999"))).when(kind == 2, F.array(F.lit("#/texts/0"), F.lit("#/texts/0")))
        .otherwise(F.array(F.lit("#/texts/1"), F.lit("#/texts/0")))
    )
    return inputs.documents(spark, d).select("doc_id", refs.alias("refs"))


_SIZES = f"sizes as (select doc_id, count(*) as n from ({LINES_SQL}) group by 1)"


@query("order_problems", f"""
with {_SIZES}, p as (select doc_id, case when doc_id % 4 = 1 then 1 + (n < 2)::int when doc_id % 4 = 2 then 0 else (n < 2)::int end as unknown_refs, (doc_id % 4 = 2)::int as duplicate_refs,
n - least(n, case when doc_id % 4 in (1, 2) then 1 else 2 end) + case when doc_id % 4 = 1 and n < 2 then 1 else 0 end as missing_refs from sizes)
select doc_id, cast(unknown_refs as bigint) as unknown_refs, cast(duplicate_refs as bigint) as duplicate_refs, missing_refs from p where unknown_refs > 0 or duplicate_refs > 0 or missing_refs > 0""")
def order_problems(spark, d):
    return patches.order_problems(line_table(spark, d), orders(spark, d), complete=True)


@query("reorder_texts", f"""
with e as ({ELEMENTS_SQL}), {_SIZES}
select doc_id, idx, case when doc_id % 4 in (0, 3) and n >= 2 and idx < 2 then 0 else 1 end as order_major,
case when doc_id % 4 in (0, 3) and n >= 2 and idx < 2 then 1 - idx else idx end as order_minor from e join sizes using (doc_id)""")
def reorder_texts(spark, d):
    return patches.reorder_texts(line_table(spark, d), orders(spark, d)).select("doc_id", "idx", "order_major", "order_minor")


@query("patch_sequence", f"""
with e as ({ELEMENTS_SQL}), {_SIZES},
s0 as (select e.*, n, idx as i from e join sizes using (doc_id)),
s1 as (select * replace (case when idx = 0 then 'before' else text end as text) from s0),
s2 as (select * replace (case when n >= 3 and idx <= 2 then (idx + 1) % 3 else i end as i) from s1),
s3 as (select * replace (case when i = 0 then 'after' else text end as text, case when i = 1 then 'code' else label end as label) from s2),
s4 as (select * replace (case when n >= 2 and idx = 0 then 0 when n >= 3 and idx = 2 then 1 when n >= 3 and idx = 1 then 2 else i end as i) from s3),
s5 as (select * replace (case when i = n - 1 and n >= 4 then 'last' else text end as text) from s4)
select doc_id, ref, i as idx, label, text from s5""")
def patch_sequence(spark, d):
    """Field patches on positional refs between three reorders, of which one is unusable, in every document with all its texts."""
    row = "struct<seq:int,op:string,ref:string,text:string,label:string,level:int,refs:array<string>>"
    steps = F.from_json(
        F.lit('[{"seq":1,"op":"set_text","ref":"#/texts/0","text":"before"},{"seq":2,"op":"reorder_texts","refs":["#/texts/2","#/texts/0","#/texts/1"]},'
              '{"seq":3,"op":"set_text","ref":"#/texts/0","text":"after"},{"seq":4,"op":"set_label","ref":"#/texts/1","label":"code"},'
              '{"seq":5,"op":"reorder_texts","refs":["#/texts/1","#/texts/1"]},{"seq":6,"op":"reorder_texts","refs":["#/texts/0","#/texts/2"]}]'), f"array<{row}>",
    )
    todo = unpack(inputs.documents(spark, d), ["doc_id"], steps)
    lines = kept_lines(spark, d, "doc_id", "grp", "idx", "ref", "label", "level", "text")
    n = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    late = n.select(
        "doc_id", F.lit(7).alias("seq"), F.lit("set_text").alias("op"), F.format_string("#/texts/%d", F.col("n") - 1).alias("ref"), F.lit("last").alias("text"),
        null("label", "string"), null("level", "int"), null("refs", "array<string>"))
    return patches.apply_patches(lines, todo.unionByName(late)).select("doc_id", "ref", "idx", "label", "text")


@query("patch_routing", "select lang, n_chars % 10 >= 8 as sure, count(*) as n from documents group by 1, 2")
def patch_routing(spark, d):
    scored = table(spark, d, "documents").withColumn("confidence", (F.col("n_chars") % 10) / 10)
    sure, review = patches.route_patches(scored, 0.8)
    both = sure.withColumn("sure", F.lit(True)).unionByName(review.withColumn("sure", F.lit(False)))
    return both.groupBy("lang", "sure").agg(F.count(F.lit(1)).alias("n"))


@query("patch_merge", f"""
with e as ({ELEMENTS_SQL}), {_SIZES}
select e.doc_id, e.ref, case when e.idx = 0 and o.text is not null then e.text || case when e.doc_id % 2 = 0 then ' ' else chr(10) end || o.text else e.text end as text,
case when e.idx = 0 and e.doc_id % 2 = 1 then 'code' else e.label end as label
from e left join e o on o.doc_id = e.doc_id and o.idx = 1 and e.idx = 0 where e.idx <> 1""")
def patch_merge(spark, d):
    merges = inputs.documents(spark, d).select(
        "doc_id", F.array(F.lit("#/texts/0"), F.lit("#/texts/1")).alias("refs"),
        F.when(F.col("doc_id") % 2 == 0, "merge").otherwise("group_as_code").alias("kind"),
    )
    return patches.merge_elements(line_table(spark, d), merges).select("doc_id", "ref", "text", "label")


def _mask_sql(x: str) -> str:
    x = f"regexp_replace({x}, 'sk-[A-Za-z0-9_\\-]{{8,}}', '***', 'g')"
    x = f"regexp_replace({x}, '(?i)(authorization:\\s*bearer\\s+)[^\\s]+', '\\1***', 'g')"
    return f"regexp_replace({x}, '(?i)(x-api-key:\\s*)[^\\s]+', '\\1***', 'g')"


@query("mask_secrets", f"select doc_id, {_mask_sql('text')} as text from ({NOISY_SQL})")
def mask_secrets_query(spark, d):
    return inputs.noisy_documents(spark, d).select("doc_id", mask_secrets(F.col("text")).alias("text"))


@query("mask_event_fields", """
select event_id, 'X-Api-Key: ***' as header, case when event_type = 'error' then 'error ***' else event_type end as message, user_id from events""")
def mask_event_fields(spark, d):
    e = table(spark, d, "events")
    message = F.when(F.col("event_type") == "error", F.concat("event_type", F.lit(" sk-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))).otherwise(F.col("event_type"))
    events = e.select("event_id", F.concat(F.lit("X-Api-Key: "), F.md5("props")).alias("header"), message.alias("message"), "user_id")
    return mask_string_fields(events)


@query("known_secrets", "select doc_id, replace(replace(text, 'the ', '[REDACTED]'), 'and', '[REDACTED]') as text from documents")
def known_secrets(spark, d):
    return inputs.documents(spark, d).select("doc_id", redact_known(F.col("text"), "the ", "", "and").alias("text"))


_SECRETS = "select distinct split_part(text, ' ', 1) as secret from documents where length(split_part(text, ' ', 1)) >= 6 union select distinct c_mktsegment from customer"


@query("known_secrets_table", f"""
with recursive s as materialized (select secret, row_number() over (order by -length(secret), secret) as k from ({_SECRETS})),
h as materialized (select d.doc_id, s.secret, row_number() over (partition by d.doc_id order by s.k) as k from documents d join s on contains(d.text, s.secret)),
r(doc_id, k, text) as (select doc_id, 0::bigint, text from documents union all select r.doc_id, h.k, replace(r.text, h.secret, chr(1)) from r join h on h.doc_id = r.doc_id and h.k = r.k + 1)
select doc_id, replace(max_by(text, k), chr(1), '[REDACTED]') as text from r group by 1""")
def known_secrets_table(spark, d):
    """The first words of all documents, if long enough, and the market segments, as secrets."""
    word = F.substring_index("text", " ", 1)
    secrets = inputs.documents(spark, d).select(word.alias("secret")).filter(F.length("secret") >= 6).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("secret")))
    return redact_table(inputs.documents(spark, d), "text", secrets, "secret", ("doc_id",))
