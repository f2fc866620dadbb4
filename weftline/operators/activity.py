"""Windowed activity analytics over channel messages, chats and knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.coerce import first_truthy, iso_utc, single_line, truncate
from weftline.functions.labels import channel_link, channel_url
from weftline.operators.ordering import first_seen, row_count, top_counts

# Words counted as action hints, in tie-breaking order, and the risk subset.
ACTION_WORDS = (
    "deploy", "fix", "review", "investigate", "release", "error", "incident", "cost", "model",
    "障害", "費用", "調査", "修正", "リリース",
)
RISK_WORDS = ("error", "incident", "障害")
SUMMARY_CHARS = 4000
EVENT_KINDS = ("channel", "chat", "knowledge")


def in_window(ts: Column, since: str, until: str) -> Column:
    """Inclusive window test; rows without a time never pass."""
    low, high = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    return F.coalesce(ts.between(low, high), F.lit(False))


def within_window(df: DataFrame, since: str, until: str, ts: str = "ts") -> DataFrame:
    """Filter the time column itself, so the range reaches the file scan.

    The bounds take the column's own type; a cast on the column would stop the
    push-down.
    """
    dtype = dict(df.dtypes)[ts]
    return df.filter(F.col(ts).between(F.lit(since).cast(dtype), F.lit(until).cast(dtype)))


def last_day_window(df: DataFrame, until: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """The default report window: ``hours`` back from ``until``."""
    high = F.lit(until).cast("timestamp")
    return df.filter(F.col(ts).between(high - F.make_dt_interval(hours=F.lit(hours)), high))


def with_channel(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Add the channel name; the id stands in where there is none.

    A channel listed twice has one name, so messages never multiply, and
    messages of unlisted channels stay.
    """
    names = channels.groupBy(F.col("id").alias("channel_id")).agg(F.max("name").alias("_channel_name"))
    named = messages.join(names, "channel_id", "left")
    return named.withColumn(
        "channel_name", first_truthy(F.col("_channel_name"), F.col("channel_id"))
    ).drop("_channel_name")


def active_chats(chats: DataFrame, messages: DataFrame, since: str, until: str) -> DataFrame:
    """Chats whose own time or any message lies in the window.

    Both sides reduce to one row per chat before they meet.
    """
    hits = within_window(messages, since, until).groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages_in_range"))
    joined = chats.join(hits, "chat_id", "left")
    counted = joined.withColumn("messages_in_range", F.coalesce("messages_in_range", F.lit(0)))
    return counted.filter((F.col("messages_in_range") > 0) | in_window(F.col("chat_ts"), since, until))


def event_totals(channel: DataFrame, chat: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Rows per kind plus the total; kinds without rows show 0."""
    def tally(kind: str, rows: DataFrame) -> DataFrame:
        return rows.agg(row_count(rows).alias("n")).select(F.lit(kind).alias("kind"), "n")

    parts = tally("channel", channel).unionByName(tally("chat", chat)).unionByName(tally("knowledge", knowledge))
    return parts.rollup("kind").agg(F.sum("n").alias("n")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "n"
    )


def posts_per_user(messages: DataFrame, user: str = "user_label") -> DataFrame:
    """Posts per user, most first, then by name."""
    counted = messages.groupBy(F.col(user).alias("user_name")).agg(row_count(messages).alias("posts"))
    return counted.orderBy(F.desc("posts"), "user_name")


def top_users(messages: DataFrame, limit: int = 5) -> DataFrame:
    return posts_per_user(messages).limit(limit)


def top_channels(messages: DataFrame, limit: int = 5) -> DataFrame:
    label = first_truthy(F.col("channel_name"), F.col("channel_id"), default="unknown")
    return top_counts(messages, label, "seq", limit, "channel")


def chat_usage(messages: DataFrame, limit: int | None = 5) -> DataFrame:
    """Chat messages per owner; ``limit=None`` keeps every owner."""
    owner = first_truthy(F.col("owner"), default="unknown")
    if limit is not None:
        return top_counts(messages, owner, "seq", limit, "owner")
    return messages.groupBy(owner.alias("owner")).agg(row_count(messages).alias("n"))


def user_activity(channel: DataFrame, chat: DataFrame) -> DataFrame:
    """Posts and chat messages of every user seen on either side.

    A union of two narrow projections and one aggregation: the same rows as a
    full outer join of two counts with one shuffle instead of three.
    """
    def weight(df: DataFrame) -> Column:
        return F.col("rows") if "rows" in df.columns else F.lit(1)

    posts = channel.select(F.col("user_label").alias("user_name"), weight(channel).alias("p"), F.lit(0).alias("c"))
    chats = chat.select(F.col("owner").alias("user_name"), F.lit(0).alias("p"), weight(chat).alias("c"))
    return (
        posts.unionByName(chats)
        .groupBy("user_name")
        .agg(F.sum("p").cast("bigint").alias("channel_posts"), F.sum("c").cast("bigint").alias("chat_messages"))
        .orderBy("user_name")
    )


def keyword_mentions(texts: DataFrame, words: tuple[str, ...] = ACTION_WORDS) -> DataFrame:
    """Messages that mention each word, with the first such message.

    ``texts`` has ``seq`` and ``content``. One pass with two aggregates per
    word; nothing is exploded and only one row per task is shuffled.
    """
    lowered = texts.select("seq", F.lower("content").alias("t"))
    aggregates = []
    for i, word in enumerate(words):
        hit = F.contains(F.col("t"), F.lit(word.lower()))
        aggregates += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.col("seq"))).alias(f"s{i}")]
    row = lowered.agg(*aggregates)
    entries = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.lit(i).alias("word_pos"),
                     F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("first_seq"))
            for i, w in enumerate(words)
        ]
    )
    return row.select(F.inline(entries)).filter(F.col("n") > 0)


def top_actions(mentions: DataFrame, limit: int = 3) -> DataFrame:
    return mentions.orderBy(F.desc("n"), "first_seq", "word_pos").limit(limit)


def risk_mentions(mentions: DataFrame, limit: int = 3) -> DataFrame:
    """Risk words in order of first appearance."""
    return mentions.filter(F.col("word").isin(*RISK_WORDS)).orderBy("first_seq", "word_pos").limit(limit)


def channel_links(messages: DataFrame, base_url: str = "", limit: int = 5) -> DataFrame:
    """Distinct channel links in first-seen order; the first name wins."""
    usable = messages.filter(first_truthy(F.col("channel_id")).isNotNull())
    # ids map one to one to URLs, so the group key stays the short id
    per_channel = usable.groupBy("channel_id").agg(
        F.min(F.struct("seq", F.coalesce("channel_name", F.lit("")).alias("name"))).alias("first")
    )
    return (
        per_channel.select(
            F.col("first.seq").alias("first_seq"),
            channel_url(F.col("channel_id"), base_url).alias("url"),
            channel_link(F.col("first.name"), F.col("channel_id"), base_url).alias("link"),
        )
        .orderBy("first_seq")
        .limit(limit)
    )


def joined_links(links: DataFrame) -> DataFrame:
    """One line of links (input is already limited), or the empty marker."""
    ordered = F.array_sort(F.collect_list(F.struct("first_seq", "link")))
    line = F.array_join(F.transform(ordered, lambda x: x["link"]), ", ")
    return links.agg(first_truthy(line, default="なし").alias("links"))


def distinct_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct non-empty values, first-seen order."""
    return first_seen(df, value, position).select(value, "first_seq").orderBy("first_seq")


def snippets_per_user(
    messages: DataFrame, per_user: int = 2, chars: int = 100, users: int | None = 3, user: str = "user_label"
) -> DataFrame:
    """First posts of each user as short snippets, for the most active users.

    Ranking keeps ``per_user`` rows per user before the shuffle.
    """
    first = Window.partitionBy(user).orderBy("seq")
    ranked = messages.select(user, "seq", "content").withColumn("rn", F.row_number().over(first))
    snippet = F.substring(single_line(F.col("content")), 1, chars)
    few = ranked.filter(F.col("rn") <= per_user).withColumn("snippet", snippet).filter(F.col("snippet") != "")
    ordered = F.array_sort(F.collect_list(F.struct("rn", "snippet")))
    lines = few.groupBy(user).agg(F.array_join(F.transform(ordered, lambda x: x["snippet"]), " / ").alias("summary"))
    ranking = messages.groupBy(user).agg(F.count(F.lit(1)).alias("posts")).orderBy(F.desc("posts"), user)
    if users is not None:
        ranking = ranking.limit(users)
    return ranking.join(lines, user, "left").select(
        F.col(user).alias("user_name"), "posts",
        first_truthy(F.col("summary"), default="投稿内容の要約を生成できませんでした。").alias("summary"),
    )


def trace_counts(traces: DataFrame, limit: int = 5) -> DataFrame:
    """Total traces, most used trace names and most active users."""
    total = traces.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("facet"), F.lit("").alias("value"), "n"
    )
    names = top_counts(traces, first_truthy(F.col("name"), default="unnamed"), "seq", limit)
    users = top_counts(traces, first_truthy(F.col("user_id"), default="unknown"), "seq", limit)
    return (
        total.unionByName(names.select(F.lit("name").alias("facet"), "value", "n"))
        .unionByName(users.select(F.lit("user").alias("facet"), "value", "n"))
    )


def summary_feed(channel: DataFrame, chat: DataFrame, knowledge: DataFrame, base_url: str = "") -> DataFrame:
    """Privacy-safe rows for a summariser.

    Chat rows carry user, time and text; no chat id, title or link leaves here.
    """
    blank = F.lit(None).cast("string")

    def text(df: DataFrame) -> Column:
        alternatives = [F.col(c) for c in ("content", "text") if c in df.columns]
        return truncate(single_line(*alternatives), SUMMARY_CHARS)

    posts = channel.select(
        F.lit("channel").alias("kind"), "seq",
        first_truthy(F.col("channel_name"), F.col("channel_id"), default="unknown").alias("channel"),
        F.col("channel_id").cast("string").alias("channel_id"),
        channel_url(F.nullif(F.col("channel_id").cast("string"), F.lit("")), base_url).alias("channel_url"),
        F.col("user_label").alias("user_name"), iso_utc(F.col("ts")).alias("created_at"),
        text(channel).alias("content"),
    )
    chats = chat.select(
        F.lit("chat").alias("kind"), "seq", blank.alias("channel"), blank.alias("channel_id"),
        blank.alias("channel_url"), first_truthy(F.col("owner"), default="unknown").alias("user_name"),
        iso_utc(F.col("ts")).alias("created_at"), text(chat).alias("content"),
    )
    items = knowledge.select(
        F.lit("knowledge").alias("kind"), "seq", blank.alias("channel"), blank.alias("channel_id"),
        blank.alias("channel_url"), blank.alias("user_name"),
        iso_utc(F.col("ts")).alias("created_at"), F.col("name").alias("content"),
    )
    return posts.unionByName(chats).unionByName(items)


def newest_knowledge(knowledge: DataFrame, limit: int = 10) -> DataFrame:
    """First items of the listing, in input order."""
    return knowledge.orderBy("seq").limit(limit)


def error_ledger(rejects: DataFrame, limit: int = 10) -> DataFrame:
    """First failures across sources, in the order they were met."""
    return rejects.orderBy("seq").limit(limit)


def report_metadata(
    channel: DataFrame, chats: DataFrame, chat: DataFrame, knowledge: DataFrame, channels: DataFrame,
    errors: DataFrame, since: str, until: str, tz: str = "UTC",
) -> DataFrame:
    """One row with the window, the report date and every count."""
    def tagged(kind: str, rows: DataFrame) -> DataFrame:
        return rows.agg(row_count(rows).alias("n")).select(F.lit(kind).alias("kind"), "n")

    parts = tagged("messages", channel)
    for kind, rows in (("channels", channels), ("chats", chats), ("chat_messages", chat),
                       ("knowledge", knowledge), ("errors", errors)):
        parts = parts.unionByName(tagged(kind, rows))
    high = F.lit(until).cast("timestamp")
    counts = [
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
        for kind in ("messages", "channels", "chats", "chat_messages", "knowledge", "errors")
    ]
    return parts.agg(*counts).select(
        iso_utc(F.lit(since).cast("timestamp")).alias("since"),
        iso_utc(high).alias("until"),
        F.to_date(F.from_utc_timestamp(high, tz)).cast("string").alias("report_date"),
        "messages", "channels", "chats", "chat_messages", "knowledge", "errors",
    )
