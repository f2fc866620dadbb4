"""Message, feed, document and glossary tables derived from the given tables.

Every function reads whole tables; nothing is filtered by id or cut short. The
``*_SQL`` strings are the same derivations for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.labels import chat_owner, knowledge_name, user_label
from weftline.operators.elements import line_elements

SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-25 23:59:59"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user(user_id: Column) -> Column:
    """A user record in which name and e-mail are often empty or absent."""
    number = user_id.cast("string")
    return F.struct(
        F.when(user_id % 2 == 0, F.concat(F.lit("user "), number)).otherwise("").alias("name"),
        F.when(user_id % 3 == 0, F.concat(F.lit("u"), number, F.lit("@example.com"))).alias("email"),
        number.alias("id"),
    )


USER_SQL = "case when {0} % 2 = 0 then 'user ' || {0} when {0} % 3 = 0 then 'u' || {0} || '@example.com' else cast({0} as varchar) end"


def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as channel messages; the type is the channel."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), "ts",
        F.col("event_type").alias("channel_id"), F.col("event_type").alias("channel_name"),
        _user(F.col("user_id")).alias("user"), F.col("user_id").cast("string").alias("user_id"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
    ).withColumn("user_label", user_label(F.col("user"), F.col("user_id")))


CHANNEL_SQL = (
    "select event_id as seq, cast(event_id as varchar) as id, ts, event_type as channel_id, event_type as channel_name, "
    + USER_SQL.format("user_id") + " as user_label, event_type || ' ' || props as content from events"
)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation headers: one chat per conversation, hourly start times."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    user_id = F.col("conv_id") % 150
    return ids.select(
        F.col("conv_id").alias("chat_id"),
        (start + F.make_dt_interval(hours=(F.col("conv_id") % 1000).cast("int"))).alias("chat_ts"),
        chat_owner(_user(user_id), [], user_id.cast("string")).alias("owner"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; every second turn lacks a time of its own."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    user_id = F.col("conv_id") % 150
    chat_ts = start + F.make_dt_interval(hours=(F.col("conv_id") % 1000).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "turn",
        chat_owner(_user(user_id), [], user_id.cast("string")).alias("owner"), "role",
        F.col("text").alias("content"), chat_ts.alias("chat_ts"),
        F.when(F.col("turn") % 2 == 0, chat_ts + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("message_ts"),
    ).withColumn("ts", F.coalesce("message_ts", "chat_ts"))


CHAT_SQL = (
    "select conv_id as chat_id, conv_id * 1000 + turn as seq, turn, " + USER_SQL.format("(conv_id % 150)") + " as owner, role, text as content, "
    "timestamp '2024-01-01' + to_hours(conv_id % 1000) as chat_ts, "
    "timestamp '2024-01-01' + to_hours(conv_id % 1000) + case when turn % 2 = 0 then to_minutes(turn) else to_minutes(0) end as ts "
    "from conversations"
)


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge items."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"),
        knowledge_name(F.concat("source", F.lit("/"), "lang"), F.lit(None), F.col("doc_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("url"),
        (start + F.make_dt_interval(hours=(F.col("doc_id") % 1000).cast("int"))).alias("ts"),
    )


KNOWLEDGE_SQL = (
    "select doc_id as seq, cast(doc_id as varchar) as id, source || '/' || lang as name, "
    "timestamp '2024-01-01' + to_hours(doc_id % 1000) as ts from documents"
)

# Text fragments put into document texts so that cleanup and masking have work.
NOISE = (
    "Wait......  see https://example.com/a...b and ・・・・・・・・ now ----\n\n\n\n",
    "sk-abcdefgh1234 Authorization: Bearer abc.def X-Api-Key: k1 ======== ",
    "See   https://example.com/a---b .... ———— ~~~~~~~~~ inter-\nnational ",
    "2026-08-13 10:00:00 INFO Starting\n2026-08-13 10:00:01 INFO Connected\nCPU Usage : 85%\nMemory : 10.4 GB\n",
)


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of the noise fragments in front of the text."""
    noise = F.get(F.array(*[F.lit(n) for n in NOISE]), (F.col("doc_id") % len(NOISE)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(noise, F.col("text")).alias("text"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


NOISY_SQL = (
    "select doc_id, case doc_id % 4 " + " ".join(f"when {i} then {_sql_text(n)}" for i, n in enumerate(NOISE)) + " end || text as text from documents"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


HEADING_CHARS = 60


def document_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as element arrays; short lines are headings."""
    return line_elements(documents(spark, sf_dir), heading_chars=HEADING_CHARS)


CODE_SQL = r"(^|\n)[\s]*(def |class |import |from |```|Traceback|[A-Za-z_][\pL\pN_-]*[\s]*=)"
STRIP_SQL = r"trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
LINES_SQL = (
    "select doc_id, generate_subscripts(l, 1) - 1 as idx, unnest(l) as line from "
    "(select doc_id, case when text like '%' || chr(10) then string_split(left(text, length(text) - 1), chr(10)) "
    "else string_split(text, chr(10)) end as l from documents)"
)
ELEMENTS_SQL = (
    "select doc_id, cast(idx as integer) as idx, '#/texts/' || idx as ref, line as raw_text, "
    + STRIP_SQL.format("line") + " as text, "
    "case when idx = 0 then 'title' when regexp_matches(line, '" + CODE_SQL + "') then 'code' "
    f"when length(line) < {HEADING_CHARS} then 'section_header' else 'paragraph' end as label, "
    f"case when idx > 0 and not regexp_matches(line, '" + CODE_SQL + f"') and length(line) < {HEADING_CHARS} then length(line) % 4 + 1 end as level, "
    "cast(idx // 50 + 1 as integer) as page from (" + LINES_SQL + ")"
)


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as glossary terms; each name occurs many times."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.element_at(F.split("p_name", " "), 1).alias("english"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("japanese"), F.col("p_type").alias("genre"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise("").alias("description"),
    )


GLOSSARY_SQL = (
    "select p_partkey as seq, string_split(p_name, ' ')[1] as english, p_brand || '/' || p_type as japanese, p_type as genre, "
    "case when p_size > 25 then 'size ' || p_size else '' end as description from part"
)


def short_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary of words that do occur in the texts: all words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split(F.regexp_replace("text", r"[.,\n]", " "), " +")).alias("at", "w")
    ).filter("w != ''")
    return words.select(
        (F.col("item_id") * 10000 + F.col("at")).alias("seq"), F.lower("w").alias("english"),
        F.concat(F.lit("訳"), F.col("item_id").cast("string")).alias("japanese"),
        F.lit("").alias("genre"), F.lit("").alias("description"),
    )


SHORT_TERMS_SQL = (
    "select item_id * 10000 + k - 1 as seq, lower(w) as english, '訳' || item_id as japanese, '' as genre, '' as description from "
    "(select item_id, generate_subscripts(l, 1) as k, unnest(l) as w from "
    "(select item_id, regexp_split_to_array(regexp_replace(text, '[.,\\n]', ' ', 'g'), ' +') as l from benchmark)) where w <> ''"
)


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed items: host as source, page title as title."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return pages.select(
        F.col("page_id").alias("seq"),
        F.lit("").alias("title"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("headline"),
        host.alias("site"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("https://"), host, F.lit("/feed")).alias("feed_url"),
        F.date_format(
            F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") % 1000).cast("int")),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        ).alias("date"),
        F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("description"),
    )


FEED_SQL = (
    "select page_id as seq, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, "
    "regexp_extract(url, '^https?://([^/]+)', 1) as source, case when page_id % 5 = 0 then '' else url end as url, "
    "'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/feed' as feed_url, "
    "strftime(timestamp '2024-01-01' + to_hours(page_id % 1000), '%Y-%m-%dT%H:%M:%SZ') as published_at, "
    "regexp_extract(html, '<h1>([^<]*)</h1>', 1) as raw_summary from pages"
)
