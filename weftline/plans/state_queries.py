"""Registered queries of the state family and of the dump readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.labels import looks_like_channel_id
from weftline.operators import state
from weftline.plans import inputs
from weftline.plans.element_queries import line_table
from weftline.plans.inputs import ELEMENTS_SQL, table
from weftline.sources import dumps, feeds

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("text_hashes", "select doc_id, sha256(text) as sha256 from documents")
def text_hashes(spark, d):
    return inputs.documents(spark, d).select("doc_id", state.text_hash(F.col("text")).alias("sha256"))


@query("file_hashes", "select page_id, sha256(html) as sha256 from pages")
def file_hashes(spark, d):
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return state.file_hashes(files).select(F.col("path").cast("bigint").alias("page_id"), "sha256")


@query("tree_hash", "select sha256(string_agg(n || chr(0) || h || chr(0), '' order by n)) as sha256 from (select lpad(cast(page_id as varchar), 9, '0') || '.html' as n, sha256(html) as h from pages)")
def tree_hash(spark, d):
    name = F.concat(F.lit("file:/data/site/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html"))
    files = table(spark, d, "pages").select(name.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return state.directory_hash(state.file_hashes(files), "/data/site")


NOW = "2024-02-01 00:00:00"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    units = inputs.documents(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unit_id"), "text", "doc_id")
    return state.manifest_skeleton(units, "run-1", NOW, F.sha2("text", 256))


@query("manifest_skeleton", "select 'run-1' as run_id, 'doc-' || doc_id as unit_id, 'pending' as status, 0 as attempts, sha256(text) as input_sha256, cast(null as varchar) as output_ref from documents")
def manifest_skeleton(spark, d):
    return manifest(spark, d).drop("updated_at")


def _current(spark, d):
    text = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return inputs.documents(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unit_id"), F.sha2(text, 256).alias("input_sha256"))


@query("input_mismatches", "select 'doc-' || doc_id as unit_id, sha256(text) as input_sha256, sha256(text || '!') as current_sha256 from documents where doc_id % 10 = 3")
def input_mismatches(spark, d):
    return state.input_mismatches(manifest(spark, d), _current(spark, d))


@query("guarded_manifest", "select 'doc-' || doc_id as unit_id, 'pending' as status from documents")
def guarded_manifest(spark, d):
    same = manifest(spark, d).select("unit_id", "input_sha256")
    return state.guarded(manifest(spark, d), same).select("unit_id", "status")


@query("replayed_patches", f"""
with e as ({ELEMENTS_SQL}) select doc_id, idx, case when doc_id % 2 = 0 and idx = 0 then 'again' else text end as text,
case when doc_id % 2 = 0 and idx = 0 then 'heading' else label end as label from e""")
def replayed_patches(spark, d):
    row = "struct<op:string,ref:string,text:string,label:string,level:int>"
    stored = F.from_json(
        F.lit('[{"op":"set_text","ref":"#/texts/0","text":"once"},{"op":"set_label","ref":"#/texts/0","label":"heading"},{"op":"set_text","ref":"#/texts/0","text":"again"}]'),
        f"array<{row}>",
    )
    done = inputs.documents(spark, d).select(
        "doc_id", F.lit("page-0001").alias("unit_id"), F.when(F.col("doc_id") % 2 == 0, "success").otherwise("failed").alias("status"), stored.alias("patches"),
    )
    return state.replay_patches(line_table(spark, d), done).select("doc_id", "idx", "text", "label")


@query("merged_states", """
select 'run-1' as run_id, 'doc-' || doc_id as unit_id, case when quality is null then 'pending' when toxic = 1 then 'failed' else 'success' end as status,
case when quality is null then 0 else 1 end as attempts from documents left join labels using (doc_id)""")
def merged_states(spark, d):
    later = table(spark, d, "labels").select(
        F.lit("run-1").alias("run_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unit_id"), F.lit(1).alias("attempts"),
        F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"), F.lit(NOW).cast("timestamp").alias("updated_at"),
    )
    known = inputs.documents(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unit_id"))
    return state.merge_states(manifest(spark, d), later.join(known, "unit_id", "left_semi")).select("run_id", "unit_id", "status", "attempts")


@query("stage_events", "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at from events")
def stage_events(spark, d):
    e = table(spark, d, "events")
    return state.stage_event(e.select("event_id", "ts"), F.col("ts").cast("timestamp")).select("event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("pending_outputs", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_outputs(spark, d):
    return state.pending_outputs(inputs.documents(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("resume_plan", """
select case o_orderstatus when 'F' then 'translate' else 'render' end as stage, cast(o_orderkey as varchar) as unit_id,
case o_orderkey % 7 when 1 then 'pending' when 2 then 'failed' else 'completed' end as status,
o_orderkey % 7 in (0, 5, 6) and o_orderstatus <> 'F' as reuse,
case when o_orderkey % 7 = 1 then 'stale running' when o_orderkey % 7 = 2 then 'not completed' when o_orderkey % 7 = 3 then 'artifact missing' when o_orderkey % 7 = 4 then 'artifact changed'
when o_orderstatus = 'F' then 'config changed' else 'valid' end as reason from orders""")
def resume_plan(spark, d):
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 7
    rows = o.select(
        F.when(F.col("o_orderstatus") == "F", "translate").otherwise("render").alias("stage"), F.col("o_orderkey").cast("string").alias("unit_id"),
        F.when(kind == 1, "running").when(kind == 2, "failed").otherwise("completed").alias("status"), F.md5("o_orderpriority").alias("sha256"),
        F.lit("c1").alias("config_hash"), F.lit("i1").alias("input_hash"), kind.alias("kind"),
    )
    artifacts = rows.filter("kind <> 3").select("stage", "unit_id", F.when(F.col("kind") == 4, "other").otherwise(F.col("sha256")).alias("sha256"))
    config = rows.select("stage").distinct().select(
        "stage", F.when(F.col("stage") == "translate", "c2").otherwise("c1").alias("config_hash"), F.lit("i1").alias("input_hash")
    )
    return state.resume_plan(rows.drop("kind"), artifacts, config)


@query("config_hashes", """
select cast(c_custkey as varchar) as stage, sha256('{"name":"' || c_name || '","nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}') as config_hash from customer""")
def config_hashes(spark, d):
    """Customers as stages with three settings each."""
    settings = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("stage"),
        F.explode(F.array(
            F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("name").alias("name"), F.col("c_name").alias("value")),
            F.struct(F.lit("nation").alias("name"), F.col("c_nationkey").cast("string").alias("value")),
        )).alias("s"),
    ).select("stage", "s.*")
    return state.config_hash(settings)


EVENT_STAGES = ("click", "error", "purchase", "signup", "view")


@query("invalidated_stages", """
with n as (select event_type, count(*) as n, count(*) filter (where value > 0 or event_type <> 'purchase') as m from events group by 1),
o as (select *, row_number() over (order by event_type) - 1 as stage_no from n)
select cast(stage_no as integer) as stage_no, event_type as stage, case when stage_no >= 2 then 'invalidate' else 'reuse' end as action from o""")
def invalidated_stages(spark, d):
    """Event types as stages, ten counts each as settings; one stage changes."""
    e = table(spark, d, "events")
    settings = e.groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 10).cast("string").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    changed = settings.withColumn("value", F.when(F.col("stage") == "purchase", "x").otherwise(F.col("value")))
    return state.invalidated_stages(state.config_hash(settings), state.config_hash(changed), EVENT_STAGES)


@query("only_pages", f"with e as ({ELEMENTS_SQL}) select doc_id, idx from e where page in (2, 3)")
def only_pages(spark, d):
    return state.only_pages(line_table(spark, d), [2, 3]).select("doc_id", "idx")


def _stage_log(spark, d):
    e = table(spark, d, "events")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("user_id") % 3).cast("string")))
    return e.select((F.col("user_id") % 5).alias("stage"), error.alias("error_type"), (F.col("value") * 100).cast("bigint").alias("duration_ms"))


_LOG = "log as (select user_id % 5 as stage, case when event_type = 'error' then 'E' || (user_id % 3) end as error_type, cast(trunc(value * 100) as bigint) as duration_ms from events)"


@query("stage_metrics", f"with {_LOG} select stage, count(*) as events, count(error_type) as errors, round(avg(duration_ms), 4) as avg_ms, max(duration_ms) as max_ms from log group by 1")
def stage_metrics(spark, d):
    m = state.stage_metrics(_stage_log(spark, d))
    return m.select("stage", "events", "errors", F.round("avg_ms", 4).alias("avg_ms"), "max_ms")


@query("merged_durations", f"""
with {_LOG} select stage, count(*) as events, count(error_type) as errors, true as p50_right, true as p95_right, true as p99_right from log group by 1""")
def merged_durations(spark, d):
    """Sketches of ten runs merged; each quantile is checked against the exact ranks of the value it names."""
    log = _stage_log(spark, d).withColumn("run_id", F.pmod(F.xxhash64("duration_ms"), F.lit(10)))
    merged = state.merged_durations(state.duration_sketches(log))
    ranks = log.filter("duration_ms is not null").join(merged.select("stage", "p50_ms", "p95_ms", "p99_ms"), "stage").groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("duration_ms") < F.col(f"{p}_ms")).alias(f"{p}_below") for p in ("p50", "p95", "p99")],
        *[F.count_if(F.col("duration_ms") <= F.col(f"{p}_ms")).alias(f"{p}_upto") for p in ("p50", "p95", "p99")])
    off = state.RANK_ERROR * 1.5
    right = [((F.col(f"{p}_below") <= (q + off) * F.col("n")) & (F.col(f"{p}_upto") >= (q - off) * F.col("n"))).alias(f"{p}_right")
             for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return merged.select("stage", "events", "errors").join(ranks.select("stage", *right), "stage")


@query("settled_states", """
with e as (select event_type as stage, cast(user_id as varchar) as unit_id, ts, case event_id % 3 when 0 then 'running' when 1 then 'completed' else 'failed' end as status, event_id from events),
l as (select *, row_number() over (partition by stage, unit_id order by ts desc, status desc, event_id desc) as k from e)
select stage, unit_id, ts, case when status = 'running' and ts + interval 3 days <= timestamp '2024-01-20' then 'pending' else status end as status from l where k = 1""")
def settled_states(spark, d):
    """Events as states of (type, user); running ones that are three days old are pending."""
    kind = F.col("event_id") % 3
    log = table(spark, d, "events").select(
        F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("unit_id"), "ts",
        F.when(kind == 0, "running").when(kind == 1, "completed").otherwise("failed").alias("status"))
    return state.settled_states(log, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "3 days")


@query("errors_by_type", f"with {_LOG} select stage, error_type, count(*) as errors from log where error_type is not null group by 1, 2")
def errors_by_type(spark, d):
    return state.errors_by_type(_stage_log(spark, d))


@query("usage_totals", "select l_returnflag as run_id, l_linestatus as model, count(*) as calls, cast(sum(l_orderkey) as bigint) as input_tokens, cast(sum(l_linenumber) as bigint) as output_tokens, cast(sum(cast(l_quantity as bigint)) as bigint) as cost from lineitem group by 1, 2")
def usage_totals(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("run_id"), F.col("l_linestatus").alias("model"), F.col("l_orderkey").alias("input_tokens"),
        F.col("l_linenumber").alias("output_tokens"), F.col("l_quantity").cast("bigint").alias("cost"),
    )
    return state.usage_totals(rows)


# --- dump readers -----------------------------------------------------------

@query("envelope_items", """
select user_id, event_id, cast(k as bigint) as seq, event_type || k as name from events, (values (0), (1)) v(k) where event_id % 4 <> 3""")
def envelope_items(spark, d):
    """Each event as a response of two items: a list, two envelopes, and junk."""
    e = table(spark, d, "events")
    items = F.to_json(F.array(*[F.struct(F.concat("event_type", F.lit(str(k))).alias("name")) for k in (0, 1)]))
    kind = F.col("event_id") % 4
    payload = (
        F.when(kind == 0, items).when(kind == 1, F.concat(F.lit('{"chats":'), items, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"chats":{},"data":'), items, F.lit("}"))).otherwise('{"chats":"none"}')
    )
    found = dumps.envelope_items(e.select("user_id", "event_id", payload.alias("payload")), ("chats",))
    return found.select("user_id", "event_id", F.col("seq").cast("bigint").alias("seq"), F.try_variant_get("item", "$.name", "string").alias("name"))


@query("channel_rows", """
select 'c' || c_custkey as id, case when c_custkey % 2 = 0 then c_name else c_mktsegment end as name from customer where c_custkey % 5 <> 4""")
def channel_rows(spark, d):
    c = table(spark, d, "customer")
    item = F.struct(
        F.when(F.col("c_custkey") % 5 < 2, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("id"),
        F.when(F.col("c_custkey") % 5 < 4, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("channel_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.col("c_mktsegment").alias("title"),
    )
    payload = F.concat(F.lit('{"channels":["junk",'), F.to_json(item), F.lit("]}"))
    return dumps.channels(c.select(payload.alias("payload"))).select("id", "name")


@query("stitched_pages", """
with p as (select l_orderkey as k, cast(l_linenumber as integer) as page, count(*) as n from lineitem group by 1, 2),
e as (select k, min(case when n < 1 + k % 2 then page end) as last from p group by 1)
select p.k, p.page, p.n from p join e using (k) where last is null or page <= last""")
def stitched_pages(spark, d):
    """Order lines as page dumps; every second order wants two items a page."""
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page")).agg(F.collect_list("l_partkey").alias("items"))
    odd = dumps.stitch_pages(pages.filter("k % 2 = 1"), page_size=2, keys=["k"])
    even = dumps.stitch_pages(pages.filter("k % 2 = 0"), page_size=1, keys=["k"])
    return odd.unionByName(even).groupBy("k", "page").agg(F.count(F.lit(1)).alias("n"))


@query("message_page", "select event_id, event_type from events order by ts, event_id limit 50 offset 100")
def message_page(spark, d):
    return dumps.page_of(table(spark, d, "events"), ["ts", "event_id"], 100, 50).select("event_id", "event_type")


@query("hydrated_items", """
select doc_id as id, case when quality is null then source else 'q' || quality end as name, coalesce(toxic, -1) as toxic, case when quality is null then 'detail not available' end as error
from documents left join labels using (doc_id)""")
def hydrated_items(spark, d):
    summaries = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    details = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("name"), "toxic")
    return dumps.hydrate(summaries, details).withColumn("toxic", F.coalesce("toxic", F.lit(-1)))


@query("export_fallback", """
select 'export' as source, 'full export not available, using the visible list' as reason, 1 as n
union all select 'details', 'detail not available', count(*) from documents where doc_id not in (select doc_id from labels)""")
def export_fallback(spark, d):
    summaries = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    details = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("name"))
    _, warnings = dumps.preferred_export(None, summaries, details)
    source = F.when(F.col("source") == "export", "export").otherwise("details")
    return warnings.groupBy(source.alias("source"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("file_contents", """
select page_id as file_id, case when page_id % 3 = 0 then regexp_extract(html, '<title>([^<]*)</title>', 1) when page_id % 3 = 1 then html else '' end as content from pages""")
def file_contents(spark, d):
    p = table(spark, d, "pages").withColumnRenamed("page_id", "file_id")
    extracted = p.filter("file_id % 3 = 0").select("file_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("content"))
    raw = p.filter("file_id % 3 < 2").select("file_id", F.col("html").alias("content"))
    return dumps.file_content(p.select("file_id"), extracted, raw)


@query("resolved_channels", """
with c as (select c_name as name, c_custkey as id from customer), a as (select o_orderkey, case o_orderkey % 4 when 0 then '#Customer#' || lpad(cast(o_custkey as varchar), 9, '0') when 1 then 'id_' || lpad(cast(o_orderkey as varchar), 16, '0')
 when 2 then ' ' else 'nobody' end as v, o_custkey from orders)
select o_orderkey, case o_orderkey % 4 when 0 then cast(o_custkey as varchar) when 1 then v when 2 then '0' end as channel_id,
case o_orderkey % 4 when 0 then 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') when 2 then 'Customer#000000000' end as channel_name,
case o_orderkey % 4 when 3 then 'channel not found: nobody' end as error from a""")
def resolved_channels(spark, d):
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 4
    name = F.concat(F.lit("##Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    asked = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("id_"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0"))).when(kind == 2, " ").otherwise("nobody")
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return dumps.resolve_channels(o.select("o_orderkey", asked.alias("channel")), names, "#Customer#000000000").drop("channel")


@query("channel_id_shapes", "select doc_id, doc_id % 3 <> 2 as is_id from documents")
def channel_id_shapes(spark, d):
    h = F.md5("text")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    value = F.when(F.col("doc_id") % 3 == 0, uuid).when(F.col("doc_id") % 3 == 1, h).otherwise(F.substring(h, 1, 15))
    return inputs.documents(spark, d).select("doc_id", looks_like_channel_id(value).alias("is_id"))


@query("feed_registry", """
select page_id as k, cast(seq as bigint) as seq, case when seq < 3 then 'page ' || page_id else 'later' end as source_category, url || case when seq = 2 then '&b' else '' end as url
from pages, (values (1), (2), (3)) v(seq)""")
def feed_registry(spark, d):
    """A registry text per page: two feeds under one heading, one under another."""
    p = table(spark, d, "pages")
    text = F.concat(F.lit("# page "), F.col("page_id").cast("string"), F.lit("\n"), "url", F.lit(" \n"), "url", F.lit("&b\n\n#later\nnot a feed\n"), "url")
    return feeds.registry_rows(p.select(F.col("page_id").alias("k"), text.alias("value"))).withColumn("seq", F.col("seq").cast("bigint"))
