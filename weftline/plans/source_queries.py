"""Registered round trips: a given table is written by a sink, read by its reader and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking, elements
from weftline.plans import inputs
from weftline.plans.element_queries import document_payloads
from weftline.plans.inputs import table
from weftline.plans.render_queries import Q as RENDERED
from weftline.plans.render_queries import SQL as RENDERED_SQL
from weftline.session import ensure_checkpoint_dir
from weftline.sources import dumps, feeds, glossaries, sinks

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place of checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "select event_id, user_id, event_type, props from events")
def jsonl_round_trip(spark, d):
    """Half the events are written, the other half appended, all are read."""
    path = folder(spark)
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    sinks.write_jsonl(events.filter("event_id % 2 = 0"), path)
    sinks.write_jsonl(events.filter("event_id % 2 = 1"), path, append=True)
    return dumps.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, props string")[0]


def _broken_lines(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct("doc_id", F.length("text").alias("n")))
    shown = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("doc_id") % 7 == 1, F.substring(body, 2, 1000)).when(F.col("doc_id") % 7 == 2, "  ")
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce(shown, body).alias("value"))


@query("jsonl_good_lines", "select doc_id, length(text) as n from documents where doc_id % 7 > 2")
def jsonl_good_lines(spark, d):
    """Arrays, broken and blank lines among the objects."""
    path = folder(spark)
    _broken_lines(spark, d).select("value").write.text(path)
    return dumps.read_jsonl(spark, path, "doc_id bigint, n bigint")[0]


@query("jsonl_rejects", """
with n as (select source, doc_id, text, row_number() over (partition by source order by doc_id) as line_no from documents)
select source, line_no, case doc_id % 7 when 0 then '[{"doc_id":' || doc_id || ',"n":' || length(text) || '}]' else '"doc_id":' || doc_id || ',"n":' || length(text) || '}' end as line
from n where doc_id % 7 < 2""")
def jsonl_rejects(spark, d):
    """One file for each source, its lines by id; rejects name file and line."""
    path = folder(spark)
    docs = _broken_lines(spark, d)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").option("maxRecordsPerFile", 0).text(path)
    bad = dumps.read_jsonl(spark, path, "doc_id bigint, n bigint")[1]
    return bad.select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "line_no", "line")


@query("json_files", "select item_id, text from benchmark")
def json_files(spark, d):
    """One JSON file per item."""
    path = folder(spark)
    body = table(spark, d, "benchmark").select(F.col("item_id").alias("folder"), F.to_json(F.struct("item_id", "text")).alias("value"))
    body.write.partitionBy("folder").text(path)
    return dumps.read_json_documents(spark, f"{path}/*/*.txt", "item_id bigint, text string")


@query("json_documents", "select doc_id, lang, text from documents")
def json_documents(spark, d):
    path = folder(spark)
    docs = table(spark, d, "documents")
    sinks.write_json_documents(docs.select("doc_id", F.to_json(F.struct("lang", "text")).alias("payload")), path, "doc_id")
    rows = dumps.read_jsonl(spark, path, "doc_id bigint, document string")[0]
    return rows.select("doc_id", F.from_json("document", "lang string, text string").alias("r")).select("doc_id", "r.*")


@query("glossary_csv", "select trim(p_name) as english, p_brand as japanese, '\"' || p_type || '\", a' || chr(10) || 'b' as genre, cast(p_size as varchar) as description from part")
def glossary_csv(spark, d):
    """Quotes, commas and line breaks inside values."""
    path = folder(spark)
    genre = F.concat(F.lit('"'), "p_type", F.lit('", a\nb'))
    part = table(spark, d, "part").select(
        F.col("p_name").alias("english"), F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("japanese"), genre.alias("genre"), F.col("p_size").cast("string").alias("description"))
    part.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return glossaries.read_glossary(spark, path).drop("seq")


@query("feed_xml", """
select 'page ' || page_id as title, url, timestamp '2024-01-01' + to_hours(page_id % 1000) as published_ts from pages where page_id % 3 < 2
union all select 'page ' || page_id, url, null from pages where page_id % 3 = 2""")
def feed_xml(spark, d):
    """Pages as RSS items with RFC 822 dates in two zones, or none."""
    path = folder(spark)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") % 1000).cast("int"))
    east = F.concat(F.date_format(ts + F.make_dt_interval(hours=F.lit(9)), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900"))
    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("page_id") % 3 == 1, east)
    items = table(spark, d, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("link"), date.alias("pubDate"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return feeds.read_feed_items(spark, path).select("title", "url", "published_ts")


@query("json_array_items", "select c_custkey, c_name from customer")
def json_array_items(spark, d):
    """Customers as JSON arrays: a nation's customers in as many arrays as keep each at about a thousand."""
    path = folder(spark)
    customers = table(spark, d, "customer")
    blocks = max(1, customers.count() // 25_000)
    block = F.pmod(F.xxhash64("c_custkey"), F.lit(blocks)).alias("block")
    c = customers.groupBy("c_nationkey", block).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("value"))
    c.write.partitionBy("c_nationkey", "block").text(path)
    return dumps.read_items(spark, f"{path}/*/*/*.txt", schema="struct<c_custkey:bigint,c_name:string>").select("c_custkey", "c_name")


@query("markdown_sink", RENDERED_SQL["document_render"])
def markdown_sink(spark, d):
    path = folder(spark)
    sinks.write_markdown(RENDERED["document_render"](spark, d), path)
    return spark.read.parquet(path)


@query("markdown_files", f"select doc_id, markdown from ({RENDERED_SQL['document_render']})")
def markdown_files(spark, d):
    """A Markdown file per document, read back by name."""
    path = folder(spark)
    sinks.write_markdown_files(RENDERED["document_render"](spark, d), path, fanout=16)
    files = sinks.read_markdown_files(spark, path, fanout=16)
    return files.select(F.col("name").cast("bigint").alias("doc_id"), "markdown")


@query("pictures_leave_no_chunk", "select doc_id, 1 as tables, 0 as pictures from documents")
def pictures_leave_no_chunk(spark, d):
    """Each document has one table and one picture without text."""
    made = chunking.build_chunks(elements.element_arrays(document_payloads(spark, d)))
    return made.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "table").cast("int").alias("tables"), F.sum(F.size("assets")).cast("int").alias("pictures"))
