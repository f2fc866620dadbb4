"""Registered queries of the activity family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.coerce import iso_utc, nanos_moment, single_line, text_moment, truncate
from weftline.functions.labels import channel_link, channel_url, chat_title
from weftline.operators import activity, messages
from weftline.plans import inputs
from weftline.plans.activity_report import ReportInput, report_lines
from weftline.plans.inputs import SINCE, UNTIL, table

Q: dict = {}
SQL: dict = {}

_WINDOW = f"ts between timestamp '{SINCE}' and timestamp '{UNTIL}'"
_CHANNEL = f"channel as ({inputs.CHANNEL_SQL}), posts as (select * from channel where {_WINDOW})"
_CHAT = f"chat as ({inputs.CHAT_SQL}), turns as (select * from chat where {_WINDOW})"
_KNOW = f"know as (select * from ({inputs.KNOWLEDGE_SQL}) where {_WINDOW})"


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def posts(spark: SparkSession, d: str) -> DataFrame:
    return activity.within_window(inputs.channel_messages(spark, d), SINCE, UNTIL)


def turns(spark: SparkSession, d: str) -> DataFrame:
    return activity.within_window(inputs.chat_messages(spark, d), SINCE, UNTIL)


def items(spark: SparkSession, d: str) -> DataFrame:
    return activity.within_window(inputs.knowledge(spark, d), SINCE, UNTIL)


@query("message_times", """
select event_id, case event_id % 8
  when 5 then null when 6 then null
  when 2 then strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  when 3 then strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  when 4 then strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  when 1 then strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  when 7 then strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00'
  else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%f') || '+00:00' end as moment
from events""")
def message_times(spark, d):
    """Seven spellings of a time, two of them unusable."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    micros, secs, kind = F.unix_micros("t"), F.unix_seconds("t"), F.col("event_id") % 8
    plain = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == 0, (micros * 1000).cast("string")).when(kind == 1, (secs * 1000).cast("string"))
        .when(kind == 2, secs.cast("string")).when(kind == 3, F.concat(plain, F.lit("Z")))
        .when(kind == 4, F.concat(F.date_format(F.col("t") + F.expr("interval 9 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
        .when(kind == 5, micros.cast("string")).when(kind == 6, "soon")
        .otherwise(F.date_format("t", "yyyyMMdd"))
    )
    return e.select("event_id", iso_utc(text_moment(text)).alias("moment"))


@query("message_times_nanos", """
select event_id, case when event_id % 4 = 0 then '1970-01-01T' else strftime(ts, '%Y-%m-%dT') end as day_part,
  event_id % 4 <> 0 and ts between timestamp '2024-01-05' and timestamp '2024-01-25 23:59:59' as in_range
from events""")
def message_times_nanos(spark, d):
    """Channel times are nanoseconds; a seconds value falls out of any window."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    stamp = F.when(F.col("event_id") % 4 == 0, F.unix_seconds("t")).otherwise(F.unix_micros("t") * 1000)
    moment = nanos_moment(stamp)
    return e.select(
        "event_id", F.date_format(moment, "yyyy-MM-dd'T'").alias("day_part"),
        activity.in_window(moment, SINCE, UNTIL).alias("in_range"),
    )


@query("activity_window", f"with {_CHANNEL} select channel_id, count(*) as n from posts group by 1")
def activity_window(spark, d):
    return posts(spark, d).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))


@query("default_window", "select count(*) as n from events where ts between timestamp '2024-01-25 23:59:59' - interval 24 hours and timestamp '2024-01-25 23:59:59'")
def default_window(spark, d):
    return activity.last_day_window(inputs.channel_messages(spark, d), UNTIL).agg(F.count(F.lit(1)).alias("n"))


@query("posts_per_user", f"with {_CHANNEL} select user_label as user_name, count(*) as posts from posts group by 1")
def posts_per_user(spark, d):
    return activity.posts_per_user(posts(spark, d))


@query("top_users", f"with {_CHANNEL} select user_label as user_name, count(*) as posts from posts group by 1 order by 2 desc, 1 limit 5")
def top_users(spark, d):
    return activity.top_users(posts(spark, d))


@query("top_channels", f"with {_CHANNEL} select channel_name as channel, count(*) as n, min(seq) as first_seq from posts group by 1 order by 2 desc, 3 limit 5")
def top_channels(spark, d):
    return activity.top_channels(posts(spark, d))


@query("chat_usage", f"with {_CHAT} select owner, count(*) as n, min(seq) as first_seq from turns group by 1 order by 2 desc, 3 limit 5")
def chat_usage(spark, d):
    return activity.chat_usage(turns(spark, d))


@query("chat_usage_all", f"with {_CHAT} select owner, count(*) as n from turns group by 1")
def chat_usage_all(spark, d):
    return activity.chat_usage(turns(spark, d), limit=None)


@query("chat_titles", """
select conv_id, turn, case when turn % 3 = 0 then 'Chat ' || conv_id when turn % 3 = 1 then role else cast(conv_id as varchar) end as title
from conversations""")
def chat_titles(spark, d):
    c = table(spark, d, "conversations")
    inner = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Chat "), F.col("conv_id").cast("string")))
    outer = F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("")
    return c.select("conv_id", "turn", chat_title(inner, F.lit(""), outer, F.col("conv_id").cast("string")).alias("title"))


@query("chat_flatten", "select conv_id, turn, cast(p as bigint) as pos, role, text || '#' || p as content from conversations, (values (0), (1)) v(p)")
def chat_flatten(spark, d):
    """Every turn as a chat of two messages in one of the five payload shapes."""
    c = table(spark, d, "conversations")

    def message(p):
        return F.to_json(F.struct(F.format_string(f"z{p}", ).alias("id"), F.col("role"), F.concat("text", F.lit(f"#{p}")).alias("content")))

    def as_list():
        return F.concat(F.lit('["junk",'), message(0), F.lit(",7,"), message(1), F.lit("]"))

    def as_map():
        return F.concat(F.lit('{"z":'), message(0), F.lit(',"a":'), message(1), F.lit(',"k":null}'))

    shape = F.col("turn") % 5
    body = (
        F.when(shape == 0, F.concat(F.lit('{"messages":'), as_list(), F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"messages":'), as_map(), F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"history":'), as_list(), F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"chat":{"history":{"messages":'), as_map(), F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"chat":{"title":"t","history":{"messages":'), as_list(), F.lit("}}}")))
    )
    flat = messages.chat_messages(c.select("conv_id", "turn", body.alias("payload")))
    # junk entries are dropped, so positions are re-read from the message ids
    return flat.select("conv_id", "turn", F.substring("message_id", 2, 1).cast("bigint").alias("pos"), "role", "content")


@query("message_channel", f"""
with {_CHANNEL} select channel_id, case when channel_id = 'view' then 'view' else 'ch-' || channel_id end as channel_name, count(*) as n
from posts group by 1, 2""")
def message_channel(spark, d):
    p = posts(spark, d).drop("channel_name")
    names = table(spark, d, "events").select(F.col("event_type").alias("id")).distinct().withColumn(
        "name", F.when(F.col("id") == "view", "").otherwise(F.concat(F.lit("ch-"), F.col("id")))
    )
    return activity.with_channel(p, names).groupBy("channel_id", "channel_name").agg(F.count(F.lit(1)).alias("n"))


@query("chat_time_fallback", f"with {_CHAT} select chat_id, turn, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from turns")
def chat_time_fallback(spark, d):
    timed = messages.effective_time(inputs.chat_messages(spark, d).drop("ts"))
    return activity.within_window(timed, SINCE, UNTIL).select("chat_id", "turn", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("active_chats", f"""
with {_CHAT}, hits as (select chat_id, count(*) as n from turns group by 1),
heads as (select distinct chat_id, chat_ts as ts from chat)
select h.chat_id, coalesce(n, 0) as messages_in_range from heads h left join hits using (chat_id) where n > 0 or {_WINDOW}""")
def active_chats(spark, d):
    found = activity.active_chats(inputs.chats(spark, d), inputs.chat_messages(spark, d), SINCE, UNTIL)
    return found.select("chat_id", "messages_in_range")


_REPLIES_SQL = "select conv_id as id, cast(conv_id as varchar) || '-' || turn as reply_id, turn, text from conversations where turn > 0"


@query("thread_attach", f"""
select c.conv_id as id, coalesce(string_agg(r.reply_id, ',' order by r.turn), '') as replies
from conversations c left join ({_REPLIES_SQL}) r on r.id = c.conv_id where c.turn = 0 group by 1""")
def thread_attach(spark, d):
    c = table(spark, d, "conversations")
    heads = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("id"), F.col("text").alias("content"))
    replies = c.filter(F.col("turn") > 0).select(
        F.col("conv_id").alias("parent_id"), F.col("turn").alias("seq"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"),
    )
    nested = messages.attach_threads(heads, replies)
    return nested.select("id", F.array_join(F.transform("thread", lambda t: t["id"]), ",").alias("replies"))


@query("message_files", """
select id, cast(k - 1 - (case when k > 2 then 1 else 0 end) as bigint) as file_pos, f as file_id from
(select o_orderkey as id, unnest([1, 2, 3]) as k, unnest(['c' || o_custkey, '', 'o' || o_orderkey]) as f from orders) where f <> ''""")
def message_files(spark, d):
    o = table(spark, d, "orders")
    files = F.array(
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")), F.struct(F.lit("").alias("id")),
        F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")),
    )
    found = messages.file_ids(o.select(F.col("o_orderkey").alias("id"), files.alias("files")))
    return found.select("id", F.col("file_pos").cast("bigint").alias("file_pos"), "file_id")


@query("activity_totals", f"""
with {_CHANNEL}, {_CHAT}, {_KNOW}, k as (select 'channel' as kind, count(*) as n from posts union all
select 'chat', count(*) from turns union all select 'knowledge', count(*) from know)
select kind, n from k union all select 'total', cast(sum(n) as bigint) from k""")
def activity_totals(spark, d):
    return activity.event_totals(posts(spark, d), turns(spark, d), items(spark, d))


@query("user_activity_matrix", f"""
with {_CHANNEL}, {_CHAT}, p as (select user_label as u, count(*) as n from posts group by 1),
c as (select owner as u, count(*) as n from turns group by 1)
select coalesce(p.u, c.u) as user_name, coalesce(p.n, 0) as channel_posts, coalesce(c.n, 0) as chat_messages
from p full outer join c on p.u = c.u""")
def user_activity_matrix(spark, d):
    return activity.user_activity(posts(spark, d), turns(spark, d))


def all_texts(spark, d) -> DataFrame:
    """Posts, then chat turns, each in order."""
    first = posts(spark, d).select(F.col("seq").alias("s"), F.lit(0).alias("k"), "content")
    second = turns(spark, d).select(F.col("seq").alias("s"), F.lit(1).alias("k"), "content")
    both = first.unionByName(second)
    return both.select(F.struct("k", "s").alias("seq"), "content")


_WORDS_SQL = "(values " + ", ".join(f"('{w}', {i})" for i, w in enumerate(activity.ACTION_WORDS)) + ") w(word, word_pos)"
_MENTIONS = f"""{_CHANNEL}, {_CHAT},
texts as (select 0 as k, seq, content from posts union all select 1, seq, content from turns),
mentions as (select word, word_pos, count(*) as n, min(k * 1000000000 + seq) as first_seq from texts, {_WORDS_SQL}
where contains(lower(content), word) group by 1, 2)"""


def _flat_seq(m: DataFrame) -> DataFrame:
    return m.withColumn("first_seq", F.col("first_seq.k").cast("bigint") * 1000000000 + F.col("first_seq.s"))


@query("keyword_mentions", f"with {_MENTIONS} select word, word_pos, n, first_seq from mentions")
def keyword_mentions(spark, d):
    return _flat_seq(activity.keyword_mentions(all_texts(spark, d)))


@query("top_actions", f"with {_MENTIONS} select word, n from mentions order by n desc, first_seq, word_pos limit 3")
def top_actions(spark, d):
    return activity.top_actions(activity.keyword_mentions(all_texts(spark, d))).select("word", "n")


@query("risk_mentions", f"with {_MENTIONS} select word, n from mentions where word in ('error', 'incident', '障害') order by first_seq, word_pos limit 3")
def risk_mentions(spark, d):
    return activity.risk_mentions(activity.keyword_mentions(all_texts(spark, d))).select("word", "n")


@query("channel_links", f"""
with {_CHANNEL} select min(seq) as first_seq, 'https://chat.example/channels/' || channel_id as url,
'[#' || channel_id || '](https://chat.example/channels/' || channel_id || ')' as link from posts group by channel_id order by 1 limit 5""")
def channel_links(spark, d):
    return activity.channel_links(posts(spark, d), "https://chat.example/")


@query("channel_link_labels", """
select c_custkey, '/channels/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '%2Fx%3F%20~%2A' as url,
'[#' || case when c_custkey % 2 = 0 then c_mktsegment else c_name || '/x? ~*' end || '](/channels/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '%2Fx%3F%20~%2A)' as link
from customer""")
def channel_link_labels(spark, d):
    c = table(spark, d, "customer")
    cid = F.concat("c_name", F.lit("/x? ~*"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" ##"), "c_mktsegment", F.lit(" ")))
    return c.select("c_custkey", channel_url(cid).alias("url"), channel_link(name, cid).alias("link"))


@query("distinct_in_order", "select props as value, min(event_id) as first_seq from events where props <> '' group by 1")
def distinct_in_order(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    return activity.distinct_in_order(e, "value", "event_id")


@query("truncated_texts", """
with t as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as x from documents)
select doc_id, case when length(x) <= 4000 then x else rtrim(left(x, 3980), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '...[truncated]' end as content from t""")
def truncated_texts(spark, d):
    return inputs.documents(spark, d).select("doc_id", truncate(F.col("text"), 4000).alias("content"))


_LINE = "replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ')"
_CUT = "case when length({0}) <= 4000 then {0} else rtrim(left({0}, 3980)) || chr(10) || '...[truncated]' end"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({0}) % 1000000 > 0 then '.' || strftime({0}, '%f') else '' end || '+00:00'"


@query("summary_feed", f"""
with {_CHANNEL}, {_CHAT}, {_KNOW}
select 'channel' as kind, seq, channel_name as channel, channel_id, '/channels/' || channel_id as channel_url, user_label as user_name,
{_ISO.format('ts')} as created_at, {_CUT.format(_LINE.format('content'))} as content from posts
union all select 'chat', seq, null, null, null, owner, {_ISO.format('ts')}, {_CUT.format(_LINE.format('content'))} from turns
union all select 'knowledge', seq, null, null, null, null, {_ISO.format('ts')}, name from know""")
def summary_feed(spark, d):
    return activity.summary_feed(posts(spark, d), turns(spark, d), items(spark, d))


@query("newest_knowledge", f"with {_KNOW} select seq, name from know order by seq limit 10")
def newest_knowledge(spark, d):
    return activity.newest_knowledge(items(spark, d)).select("seq", "name")


@query("snippets_per_user", f"""
with {_CHAT}, r as (select owner, seq, row_number() over (partition by owner order by seq) as rn, count(*) over (partition by owner) as posts,
left({_LINE.format('content')}, 100) as s from turns)
select owner as user_name, max(posts) as posts, string_agg(s, ' / ' order by rn) filter (where rn <= 2 and s <> '') as summary from r group by 1
order by 2 desc, 1 limit 3""")
def snippets_per_user(spark, d):
    return activity.snippets_per_user(turns(spark, d), user="owner")


@query("snippets_every_user", f"""
with {_CHANNEL}, r as (select user_label, seq, row_number() over (partition by user_label order by seq) as rn, count(*) over (partition by user_label) as posts,
left({_LINE.format('content')}, 100) as s from posts)
select user_label as user_name, max(posts) as posts, string_agg(s, ' / ' order by rn) filter (where rn <= 2 and s <> '') as summary from r group by 1""")
def snippets_every_user(spark, d):
    return activity.snippets_per_user(posts(spark, d), users=None)


@query("trace_counts", """
with t as (select event_id as seq, case when event_type = 'view' then 'unnamed' else event_type end as name, cast(user_id as varchar) as u from events),
n as (select name, count(*) as n, min(seq) as s from t group by 1 order by 2 desc, 3 limit 5),
u as (select u, count(*) as n, min(seq) as s from t group by 1 order by 2 desc, 3 limit 5)
select 'total' as facet, '' as value, count(*) as n from t union all select 'name', name, n from n union all select 'user', u, n from u""")
def trace_counts(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return activity.trace_counts(e.select(F.col("event_id").alias("seq"), name.alias("name"), F.col("user_id").cast("string").alias("user_id")))


@query("error_ledger", "select event_id as seq, 'user ' || user_id as source, props as reason from events where event_type = 'error' order by event_id limit 10")
def error_ledger(spark, d):
    bad = table(spark, d, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"), F.col("props").alias("reason"),
    )
    return activity.error_ledger(bad)


def report_input(spark, d) -> ReportInput:
    e = table(spark, d, "events")
    errors = e.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"), F.col("props").alias("reason"),
    )
    return ReportInput(
        channel=posts(spark, d), chat=turns(spark, d),
        chats=activity.active_chats(inputs.chats(spark, d), inputs.chat_messages(spark, d), SINCE, UNTIL),
        knowledge=items(spark, d), channels=e.select(F.col("event_type").alias("id")).distinct(), errors=errors,
    )


@query("report_metadata", f"""
with {_CHANNEL}, {_CHAT}, {_KNOW}
select '2024-01-05T00:00:00+00:00' as since, '2024-01-25T23:59:59+00:00' as until, '2024-01-26' as report_date,
(select count(*) from posts) as messages, (select count(distinct event_type) from events) as channels,
(select count(distinct chat_id) from (select chat_id, chat_ts as ts from chat union all select chat_id, ts from chat) where {_WINDOW}) as chats,
(select count(*) from turns) as chat_messages, (select count(*) from know) as knowledge,
(select count(*) from events where event_type = 'error') as errors""")
def report_metadata(spark, d):
    r = report_input(spark, d)
    return activity.report_metadata(r.channel, r.chats, r.chat, r.knowledge, r.channels, r.errors, SINCE, UNTIL, "Asia/Tokyo")


def _fixed(section: int, pos: str, *lines: str, source: str = "one", where: str = "true", key: str = "''") -> str:
    """SQL of a block of lines with their numbers."""
    return " union all ".join(f"select {section} as section, {pos} as pos, {key} as key, {k} as k, {line} as line from {source} where {where}" for k, line in enumerate(lines))


def _q(text: str) -> str:
    return "'" + text + "'"


_TITLE = "(select count(*) from posts) as n_posts, (select count(*) from turns) as n_turns, (select count(*) from know) as n_items"
_REPORT = " union all ".join([
    _fixed(
        0, "0", _q("---"), _q("## 📊 アクティビティレポート (2024-01-26)"), _q(""), "'- 🔢 集計対象イベント数：' || (n_posts + n_turns + n_items) || '件'",
        _q("- 📅 集計期間：2024-01-05T00:00:00+00:00 〜 2024-01-25T23:59:59+00:00"),
        "'- 💬 チャネル投稿：' || n_posts || '件 / 🤖 チャットメッセージ：' || n_turns || '件 / 📚 新規ナレッジ：' || n_items || '件'", _q(""),
        _q("📝 取得した投稿本文をもとに、Skill呼び出し元のAgentが全体傾向を総合要約してください。"), _q(""), _q("### 🔥 本日の主要イベント"),
    ),
    _fixed(
        1, "1", _q("1. チャネル横断の活動"),
        "'   - 🧭 概要：' || n_channels || '件のチャネルを確認し、期間内の投稿 ' || n_posts || ' 件を集計しました。主要チャネルは ' || top_channels || ' です。'",
        "'   - 👥 関連ユーザー：' || top_users", "'   - 🔗 URL：' || l", where="n_posts > 0",
    ),
    _fixed(
        1, "2", "case when n_posts > 0 then 2 else 1 end || '. ユーザーチャットの活動'",
        "'   - 🧭 概要：' || n_chats || '件のチャットから期間内のメッセージ ' || n_turns || ' 件を集計しました。'", "'   - 👥 関連ユーザー：' || top_owners",
        _q("   - 🔗 URL：なし（チャットは個人情報保護のためリンク非掲載）"), where="n_turns > 0",
    ),
    _fixed(
        1, "3", "(1 + (n_posts > 0)::int + (n_turns > 0)::int) || '. 新規ナレッジの追加'",
        "'   - 🧭 概要：期間内に ' || n_items || ' 件のナレッジが追加されました。主なナレッジは ' || item_names || ' です。'",
        _q("   - 👥 関連ユーザー：未特定（ナレッジ詳細確認）"), "'   - 🔗 URL：' || item_urls", where="n_items > 0",
    ),
    _fixed(
        1, "4", _q("1. 主要イベントなし"), _q("   - 🧭 概要：指定期間内のチャネル投稿、チャット、ナレッジ追加は見つかりませんでした。"), _q("   - 👥 関連ユーザー：なし"),
        _q("   - 🔗 URL：なし"), where="n_posts + n_turns + n_items = 0",
    ),
    _fixed(2, "0", _q(""), _q("### ✅ 推奨アクションアイテム")), _fixed(3, "0", _q(""), _q("### ⚠️ 潜在的なリスク")),
    _fixed(4, "0", _q(""), _q("### 👥 ユーザー別アクティビティ")), _fixed(5, "0", _q(""), _q("### 📚 新規ナレッジ")),
    _fixed(6, "0", _q(""), _q("### ⚠️ 取得時の注意"), where="exists (from bad)"),
    _fixed(
        2, "i", "i || '. `' || word || '` に関する確認'", "'   - 🧭 概要：`' || word || '` が ' || n || ' 件の投稿で言及されています。担当者と期限を確認してください。'",
        _q("   - 👥 担当者：未定（チャンネルオーナー確認）"), _q("   - ⏰ 期限：次回定例まで"), source="tops", where="i <= 3",
    ),
    _fixed(
        2, "1", _q("1. 継続監視"), _q("   - 🧭 概要：目立ったアクションまたはリスク関連キーワードは検出されませんでした。"), _q("   - 👥 担当者：チャンネル参加者全員"),
        _q("   - ⏰ 期限：次回レポートまで"), where="not exists (from tops)",
    ),
    _fixed(
        3, "i", "i || '. `' || word || '` の継続監視が必要'", "'   - 🧭 概要：`' || word || '` が ' || n || ' 件の投稿で言及されています。根本原因の特定状況を確認してください。'",
        _q("   - 👥 関連ユーザー：未特定（該当スレッド確認）"), "'   - 🔗 URL：' || l", source="risks, one", where="i <= 3",
    ),
    _fixed(
        3, "1", _q("1. 顕在化した重大リスクなし"), _q("   - 🧭 概要：エラー・障害系キーワードの集中は確認されませんでした。"), _q("   - 👥 関連ユーザー：なし"),
        _q("   - 🔗 URL：なし"), where="not exists (from risks)",
    ),
    _fixed(4, "1", "'- ' || u || '：🗨️ ' || p || '件のチャンネル投稿、🤖 ' || c || '件のチャット利用'", source="users", key="u"),
    _fixed(4, "1", _q("- 対象ユーザーの投稿はありませんでした。"), where="not exists (from users)"),
    _fixed(5, "i", "'- ' || name || '：' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'", source="k", where="i <= 10"),
    _fixed(5, "1", _q("- 指定期間内に追加されたナレッジはありませんでした。"), where="not exists (from k)"),
    _fixed(6, "i", "'- ' || t", source="bad", where="i <= 10"),
])


@query("activity_report_lines", f"""
with {_MENTIONS}, {_KNOW},
tops as (select word, n, row_number() over (order by n desc, first_seq, word_pos) as i from mentions),
risks as (select word, n, row_number() over (order by first_seq, word_pos) as i from mentions where word in ('error', 'incident', '障害')),
k as (select *, row_number() over (order by seq) as i from know),
bad as (select 'user ' || user_id || ': ' || props as t, row_number() over (order by event_id) as i from events where event_type = 'error'),
users as (select u, sum(p) as p, sum(c) as c from (select user_label as u, 1 as p, 0 as c from posts union all select owner, 0, 1 from turns) group by 1),
ch as (select channel_name as v, count(*) as n, min(seq) as s from posts group by 1 order by 2 desc, 3 limit 5),
us as (select user_label as v, count(*) as n from posts group by 1 order by 2 desc, 1 limit 5),
ow as (select owner as v, count(*) as n, min(seq) as s from turns group by 1 order by 2 desc, 3 limit 5),
one as (select {_TITLE}, (select count(distinct event_type) from events) as n_channels,
(select count(distinct chat_id) from (select chat_id, chat_ts as ts from chat union all select chat_id, ts from chat) where {_WINDOW}) as n_chats,
(select string_agg(v || ' (' || n || ')', ', ' order by n desc, s) from ch) as top_channels, (select string_agg(v, ', ' order by n desc, v) from us) as top_users,
(select string_agg(v || ' (' || n || ')', ', ' order by n desc, s) from ow) as top_owners,
(select string_agg(name, ', ' order by seq) from k where i <= 5) as item_names, (select string_agg(id, ', ' order by seq) from k where i <= 5) as item_urls,
(select string_agg('[#' || channel_id || '](/channels/' || channel_id || ')', ', ' order by s) from
 (select channel_id, min(seq) as s from posts group by 1 order by 2 limit 5)) as l)
{_REPORT}""")
def activity_report_lines(spark, d):
    """Every line of the report, in order."""
    return report_lines(report_input(spark, d), SINCE, UNTIL, "Asia/Tokyo").orderBy("section", "pos", "key", "k")


@query("completion_messages", """
with u as (select conv_id as chat_id, turn as seq, role, text as content from conversations where role in ('user', 'assistant', 'system') and text <> ''),
l as (select chat_id, max(seq) as m from u group by 1),
p as (select conv_id as chat_id, min(text) as pending from conversations group by 1)
select chat_id, seq, role, content from u union all
select p.chat_id, coalesce(l.m, -1) + 1, 'user', pending from p left join l using (chat_id) left join u on u.chat_id = l.chat_id and u.seq = l.m
where u.content is null or u.content <> pending""")
def completion_messages(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    pending = c.groupBy("chat_id").agg(F.min("content").alias("pending"))
    return messages.completion_messages(c, pending)


@query("publishable_posts", """
select doc_id, case when length(text) > 20000 then 'content exceeds 20000 characters' when trim(text, ' ' || chr(10)) = '' then 'content is required' end as reason,
length(text) <= 20000 and trim(text, ' ' || chr(10)) <> '' as accepted from documents""")
def publishable_posts(spark, d):
    return messages.publishable(inputs.documents(spark, d).withColumnRenamed("text", "content")).select("doc_id", "reason", "accepted")


def chat_tree(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    node = lambda t: F.concat(F.lit("m"), t.cast("string"))
    children = F.when(F.col("turn") < F.col("last"), F.array(node(F.col("turn") + 1))).otherwise(F.array().cast("array<string>"))
    return c.join(last, "conv_id").select(
        F.col("conv_id").alias("chat_id"), node(F.col("turn")).alias("id"),
        F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent_id"), children.alias("children_ids"), "role", F.col("text").alias("content"),
    )


_TREE_SQL = "select conv_id as chat_id, 'm' || turn as id, case when turn > 0 then 'm' || (turn - 1) end as parent_id, case when turn < max(turn) over (partition by conv_id) then 'm' || (turn + 1) else '' end as children, role, text as content from conversations"


@query("chat_append", f"""
with t as ({_TREE_SQL}), h as (select conv_id as chat_id, max(turn) as m from conversations group by 1)
select t.chat_id, id, parent_id, case when id = 'm' || m then 'new-user' else children end as children, role, length(content) as n, false as is_head from t join h using (chat_id)
union all select chat_id, 'new-user', 'm' || m, 'new-reply', 'user', 5, false from h
union all select chat_id, 'new-reply', 'new-user', '', 'assistant', 0, true from h""")
def chat_append(spark, d):
    """A turn is added at the last message, and the head moves to the reply."""
    tree = chat_tree(spark, d)
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m"))
    heads = last.select(F.col("conv_id").alias("chat_id"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("current_id"))
    turn = heads.select("chat_id", F.lit("new-user").alias("user_id"), F.lit("new-reply").alias("assistant_id"), F.lit("hello").alias("content"))
    grown, after = messages.append_turn(tree, heads, turn)
    marked = grown.join(after.select("chat_id", F.col("current_id").alias("id"), F.lit(True).alias("_h")), ["chat_id", "id"], "left")
    return marked.select(
        "chat_id", "id", "parent_id", F.array_join("children_ids", ",").alias("children"), "role", F.length("content").cast("bigint").alias("n"),
        F.coalesce("_h", F.lit(False)).alias("is_head"))


def branching_tree(spark, d) -> DataFrame:
    """Chats in which every third message answers the one before the last; some links are cut, and some chats have lost their first message."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    node = lambda t: F.concat(F.lit("m"), t.cast("string"))
    t = F.col("turn")
    next_ = F.when((t % 3 != 1) & ~((t % 9 == 2) & (F.col("conv_id") % 2 == 1)), t + 1)
    over = F.when(t % 3 == 0, t + 2)
    children = F.transform(F.filter(F.array(next_, over), lambda x: x <= F.col("last")), node)
    parent = F.when(t % 3 == 2, node(t - 2)).when(t > 0, node(t - 1))
    return c.join(last, "conv_id").filter((t > 0) | (F.col("conv_id") % 5 > 0)).select(
        F.col("conv_id").alias("chat_id"), node(t).alias("id"), parent.alias("parent_id"), children.alias("children_ids"), "role", F.col("text").alias("content"))


_BRANCHES = """b as (select conv_id as chat_id, turn, case when turn % 3 = 2 then turn - 2 when turn > 0 then turn - 1 end as parent,
 case when turn in (1, 2) and conv_id % 5 = 0 then 'unknown parent' when turn % 9 = 3 and conv_id % 2 = 1 then 'not listed by parent' end as reason
 from conversations where turn > 0 or conv_id % 5 > 0)"""


@query("chat_broken_links", f"""
with recursive {_BRANCHES}, up(chat_id, turn, cur) as (
 select chat_id, turn, turn from b union all
 select u.chat_id, u.turn, b.parent from up u join b on b.chat_id = u.chat_id and b.turn = u.cur where b.parent is not null and b.reason is null)
select b.chat_id, 'm' || b.turn as id, 'm' || b.parent as parent_id, coalesce(b.reason, 'under a broken link') as reason, 'm' || e.turn as broken_at
from up u join b e on e.chat_id = u.chat_id and e.turn = u.cur and e.reason is not null join b on b.chat_id = u.chat_id and b.turn = u.turn""")
def chat_broken_links(spark, d):
    return messages.broken_links(branching_tree(spark, d))


@query("chat_visible_branch", f"""
with recursive {_BRANCHES}, h as (select chat_id, max(turn) - chat_id % 2 as turn from b group by chat_id), up(chat_id, turn, below) as (
 select h.chat_id, h.turn, 0 from h join b using (chat_id, turn) union all
 select u.chat_id, b.parent, below + 1 from up u join b on b.chat_id = u.chat_id and b.turn = u.turn where b.parent is not null and b.reason is null)
select chat_id, 'm' || turn as id, max(below) over (partition by chat_id) - below as place from up""")
def chat_visible_branch(spark, d):
    tree = branching_tree(spark, d)
    turn = F.substring("id", 2, 9).cast("bigint")
    heads = tree.groupBy("chat_id").agg(F.concat(F.lit("m"), (F.max(turn) - F.col("chat_id") % 2).cast("string")).alias("current_id"))
    return messages.ChatTrees(tree).visible(heads)


@query("message_lines", f"select conv_id, turn, {_LINE.format('text')} as line from conversations")
def message_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", single_line(F.lit(""), F.col("text")).alias("line"))
