import pytest
from pyspark.sql import functions as F

from weftline.functions.coerce import feed_moment, first_truthy, item_moment, iso_utc, lines_of, strip, text_moment, truncate
from weftline.functions.labels import channel_link
from weftline.operators import activity, messages
from weftline.plans.activity_report import ReportInput, report_lines

SINCE, UNTIL = "2026-04-28 00:00:00", "2026-04-28 23:59:59"


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1777345200000000000", "2026-04-28T03:00:00+00:00"),
        ("1777345200000", "2026-04-28T03:00:00+00:00"),
        ("1777345200", "2026-04-28T03:00:00+00:00"),
        ("2026-04-28T03:00:00Z", "2026-04-28T03:00:00+00:00"),
        ("2026-04-28T12:00:00+09:00", "2026-04-28T03:00:00+00:00"),
        ("2026-04-28 03:00", "2026-04-28T03:00:00+00:00"),
        ("2026-04-28", "2026-04-28T00:00:00+00:00"),
        ("1777345200000000", None), ("abc", None), ("", None), ("2026", "1970-01-01T00:33:46+00:00"),
    ],
)
def test_time_ladder(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(iso_utc(text_moment(F.col("t"))))) == [(expected,)]


def test_first_time_key_that_parses(spark):
    df = spark.createDataFrame([("soon", 1777345200.0, "2020-01-01")], "created_at string, timestamp double, updated_at string")
    assert one(df.select(iso_utc(item_moment(df)))) == [("2026-04-28T03:00:00+00:00",)]


def test_falsy_values_are_skipped(spark):
    df = spark.createDataFrame([("", None, "x")], "a string, b string, c string")
    assert one(df.select(first_truthy(F.col("a"), F.col("b"), F.col("c"), default="d"))) == [("x",)]


def test_strip_and_truncate(spark):
    df = spark.createDataFrame([("　\t a b \n ",), ("x" * 30 + " y" * 20,)], "t string")
    assert one(df.select(strip(F.col("t"))))[0] == ("a b",)
    assert one(df.select(truncate(F.col("t"), 51)))[1] == ("x" * 30 + "\n...[truncated]",)


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "a\n\nb", "a\r\nb\r\n", "a b\x0bc\x85"])
def test_lines_match_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(lines_of(F.col("t")))) == [(text.splitlines(),)]


def test_chat_shapes(spark):
    bodies = [
        '{"messages":[{"id":"z","content":"1"},"x",{"id":"a","content":"2"}]}',
        '{"messages":{"z":{"id":"z","content":"1"},"n":3,"a":{"id":"a","text":"2"}}}',
        '{"history":[{"id":"z","content":"1"},{"id":"a","content":"2"}]}',
        '{"chat":{"history":{"messages":{"z":{"id":"z","content":"1"},"a":{"id":"a","content":"2"}}}}}',
        '{"history":{"messages":[{"id":"z","content":"1"},{"id":"a","content":"2"}]}}',
        '{"title":"nothing"}', "not json",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "chat_id int, payload string")
    rows = messages.chat_messages(df).orderBy("chat_id", "pos").select("chat_id", "message_id", "content").collect()
    assert [tuple(r) for r in rows] == [(i, m, c) for i in range(5) for m, c in (("z", "1"), ("a", "2"))]


def report_tables(spark, empty=False):
    keep = 0 if empty else 1
    ts = "timestamp '2026-04-28 03:00:00'"
    return ReportInput(
        channel=spark.sql(f"select 0L as seq, 'ch1' as channel_id, 'general' as channel_name, 'alice' as user_label, {ts} as ts, 'Investigate incident' as content").limit(keep),
        chat=spark.sql(f"select 0L as seq, 'bob' as owner, {ts} as ts, 'Review model cost' as content").limit(keep),
        chats=spark.sql("select 'chat1' as chat_id").limit(keep),
        knowledge=spark.sql(f"select 0L as seq, 'kb1' as id, 'Runbook' as name, cast(null as string) as url, {ts} as ts").limit(keep),
        channels=spark.sql("select 'ch1' as id"), errors=spark.sql("select 0L as seq, 'chats' as source, 'down' as reason"),
    )


def test_report(spark):
    lines = report_lines(report_tables(spark), SINCE, UNTIL, "Asia/Tokyo").orderBy("section", "pos", "key", "k")
    text = "\n".join(r.line for r in lines.collect())
    assert "## 📊 アクティビティレポート (2026-04-29)" in text
    assert "- 🔢 集計対象イベント数：3件" in text
    assert "💬 チャネル投稿：1件 / 🤖 チャットメッセージ：1件 / 📚 新規ナレッジ：1件" in text
    assert "general (1)" in text and "[#general](/channels/ch1)" in text
    assert "1. `investigate` に関する確認" in text and "1. `incident` の継続監視が必要" in text
    assert "- bob：🗨️ 0件のチャンネル投稿、🤖 1件のチャット利用" in text
    assert "- Runbook：2026-04-28T03:00:00+00:00" in text and "- chats: down" in text
    assert "chat1" not in text
    assert text.index("本日の主要イベント") < text.index("推奨アクション") < text.index("ユーザー別")


def test_empty_report(spark):
    lines = report_lines(report_tables(spark, empty=True), SINCE, UNTIL).orderBy("section", "pos", "key", "k")
    text = "\n".join(r.line for r in lines.collect())
    for part in ("主要イベントなし", "1. 継続監視", "顕在化した重大リスクなし", "対象ユーザーの投稿はありませんでした", "追加されたナレッジはありませんでした"):
        assert part in text


def test_keywords_and_risks(spark):
    df = spark.createDataFrame([(0, "Investigate INCIDENT"), (1, "error, error"), (2, "障害 and error")], "seq long, content string")
    found = activity.keyword_mentions(df)
    assert {(r.word, r.n) for r in found.collect()} == {("investigate", 1), ("incident", 1), ("error", 2), ("障害", 1)}
    assert [r.word for r in activity.risk_mentions(found).collect()] == ["incident", "error", "障害"]
    assert [r.word for r in activity.top_actions(found).collect()] == ["error", "investigate", "incident"]


def test_links_appear_once(spark):
    cid = "2b63b27b-fc60-4b84-bb04-e51d2fced360"
    df = spark.createDataFrame([(0, cid, "report"), (1, cid, "renamed"), (2, None, "x")], "seq long, channel_id string, channel_name string")
    links = activity.joined_links(activity.channel_links(df, "http://webui.example"))
    assert one(links) == [(f"[#report](http://webui.example/channels/{cid})",)]
    assert one(activity.joined_links(activity.channel_links(df.limit(0)))) == [("なし",)]
    named = spark.createDataFrame([("", "a b")], "n string, i string").select(channel_link(F.col("n"), F.col("i")))
    assert one(named) == [("[#a b](/channels/a%20b)",)]


def test_summary_feed_hides_chats(spark):
    t = report_tables(spark)
    rows = activity.summary_feed(t.channel, t.chat, t.knowledge).collect()
    assert not any("chat1" in str(v) for r in rows for v in r)
    assert {r.kind for r in rows} == {"channel", "chat", "knowledge"}


def test_threads_whole_and_in_pages(spark):
    replies = spark.range(2000).selectExpr("'m1' as parent_id", "id as seq", "cast(id as string) as id", "'r' as content")
    heads = spark.createDataFrame([("m1",), ("m2",)], "id string")
    rows = {r.id: r for r in messages.attach_threads(heads, replies).collect()}
    assert [t.reply_no for t in rows["m1"].thread] == list(range(1, 2001)) and rows["m2"].thread == [] and not rows["m1"].thread_more
    page = {r.id: r for r in messages.attach_threads(heads, replies, limit=50, skip=1940).collect()}
    assert [t.id for t in page["m1"].thread] == [str(i) for i in range(1940, 1990)] and page["m1"].thread_more
    assert not messages.attach_threads(heads.filter("id = 'm1'"), replies, limit=60, skip=1940).first().thread_more


def test_channels_listed_twice_or_not_at_all(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, channel_id string")
    channels = spark.createDataFrame([("a", "Ann"), ("a", "Ann")], "id string, name string")
    assert sorted((r.seq, r.channel_name) for r in activity.with_channel(posts, channels).collect()) == [(1, "Ann"), (2, "b")]


def test_feed_dates(spark):
    texts = ["Wed, 24 Apr 2024 09:00:00 +0900", "24 Apr 24 00:00 GMT", "Tue, 23 Apr 2024 20:00:00 EDT", "2024-04-24T00:00:00Z", "soon", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.unix_seconds(feed_moment(F.col("t"))).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [1713916800] * 4 + [None, None]


def test_pending_turn(spark):
    df = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "tool", "x"), ("c", 2, "assistant", "")], "chat_id string, seq long, role string, content string")
    for pending, expected in (("hi", 1), ("next", 2)):
        todo = spark.createDataFrame([("c", pending)], "chat_id string, pending string")
        assert messages.completion_messages(df, todo).count() == expected
