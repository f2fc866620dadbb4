"""The activity report as an ordered table of lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.coerce import first_truthy, iso_utc
from weftline.operators import activity
from weftline.operators.ordering import roll_up


@dataclass(frozen=True)
class ReportInput:
    """Tables of one window, already filtered.

    channel: seq, channel_id, channel_name, user_label, ts, content
    chat: seq, owner, ts, content; chats: chat_id
    knowledge: seq, id, name, url, ts; channels: id; errors: seq, source, reason
    """

    channel: DataFrame
    chat: DataFrame
    chats: DataFrame
    knowledge: DataFrame
    channels: DataFrame
    errors: DataFrame


# Report wording.
HEAD = "### 🔥 本日の主要イベント"
ACTIONS = "### ✅ 推奨アクションアイテム"
RISKS = "### ⚠️ 潜在的なリスク"
USERS = "### 👥 ユーザー別アクティビティ"
KNOWLEDGE = "### 📚 新規ナレッジ"
NOTES = "### ⚠️ 取得時の注意"


def _lines(section: int, pos: Column, *lines: Column, key: Column | None = None) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(section).alias("section"), pos.cast("int").alias("pos"),
                    (key if key is not None else F.lit("")).alias("key"), F.lit(k).alias("k"), line.alias("line"),
                )
                for k, line in enumerate(lines)
            ]
        )
    )


def _ranked(few: DataFrame, *order: Column | str) -> DataFrame:
    """Number the rows of a table that a limit keeps to ten rows at most."""
    return few.withColumn("i", F.row_number().over(Window.orderBy(*order)))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _listed(df: DataFrame, order: list[str], item: Column, name: str, empty: str) -> DataFrame:
    """One row with the items of an already limited table joined by commas."""
    entries = F.array_sort(F.collect_list(F.struct(*order, item.alias("t"))))
    return df.agg(first_truthy(F.array_join(F.transform(entries, lambda x: x["t"]), ", "), default=empty).alias(name))


def _all_mentions(data: ReportInput) -> DataFrame:
    """Keyword counts over posts, then chat messages."""
    def texts(df: DataFrame, rank: int) -> DataFrame:
        return df.select(F.struct(F.lit(rank).alias("k"), F.col("seq").cast("bigint").alias("s")).alias("seq"), "content")

    return activity.keyword_mentions(texts(data.channel, 0).unionByName(texts(data.chat, 1)))


def _opening(scalars: DataFrame) -> DataFrame:
    """Title block and main events, all from one row of figures."""
    n_posts, n_turns, n_items = F.col("messages"), F.col("chat_messages"), F.col("knowledge")
    has_posts, has_turns, has_items = n_posts > 0, n_turns > 0, n_items > 0
    blocks = [
        (0, 0, F.lit(True), [
            F.lit("---"), _text("## 📊 アクティビティレポート (", F.col("report_date"), ")"), F.lit(""),
            _text("- 🔢 集計対象イベント数：", n_posts + n_turns + n_items, "件"),
            _text("- 📅 集計期間：", F.col("since"), " 〜 ", F.col("until")),
            _text("- 💬 チャネル投稿：", n_posts, "件 / 🤖 チャットメッセージ：", n_turns, "件 / 📚 新規ナレッジ：", n_items, "件"),
            F.lit(""), F.lit("📝 取得した投稿本文をもとに、Skill呼び出し元のAgentが全体傾向を総合要約してください。"), F.lit(""), F.lit(HEAD),
        ]),
        (1, 1, has_posts, [
            F.lit("1. チャネル横断の活動"),
            _text("   - 🧭 概要：", F.col("channels"), "件のチャネルを確認し、期間内の投稿 ", n_posts,
                  " 件を集計しました。主要チャネルは ", F.col("top_channels"), " です。"),
            _text("   - 👥 関連ユーザー：", F.col("top_users")), _text("   - 🔗 URL：", F.col("links")),
        ]),
        (1, 2, has_turns, [
            _text(has_posts.cast("int") + 1, ". ユーザーチャットの活動"),
            _text("   - 🧭 概要：", F.col("chats"), "件のチャットから期間内のメッセージ ", n_turns, " 件を集計しました。"),
            _text("   - 👥 関連ユーザー：", F.col("top_owners")), F.lit("   - 🔗 URL：なし（チャットは個人情報保護のためリンク非掲載）"),
        ]),
        (1, 3, has_items, [
            _text(has_posts.cast("int") + has_turns.cast("int") + 1, ". 新規ナレッジの追加"),
            _text("   - 🧭 概要：期間内に ", n_items, " 件のナレッジが追加されました。主なナレッジは ", F.col("item_names"), " です。"),
            F.lit("   - 👥 関連ユーザー：未特定（ナレッジ詳細確認）"), _text("   - 🔗 URL：", F.col("item_urls")),
        ]),
        (1, 4, ~has_posts & ~has_turns & ~has_items, [
            F.lit("1. 主要イベントなし"),
            F.lit("   - 🧭 概要：指定期間内のチャネル投稿、チャット、ナレッジ追加は見つかりませんでした。"),
            F.lit("   - 👥 関連ユーザー：なし"), F.lit("   - 🔗 URL：なし"),
        ]),
    ]
    entries = [
        F.struct(
            F.lit(section).alias("section"), F.lit(pos).alias("pos"), F.lit("").alias("key"), F.lit(k).alias("k"),
            F.when(shown, line).alias("line"),
        )
        for section, pos, shown, lines in blocks
        for k, line in enumerate(lines)
    ]
    return scalars.select(F.inline(F.array(*entries))).filter(F.col("line").isNotNull())


def report_lines(data: ReportInput, since: str, until: str, tz: str = "UTC", base_url: str = "") -> DataFrame:
    """All report lines; sorted by (section, pos, key, k) they are the report.

    The per-user part grows with the users, so lines stay rows: write them
    with an ordered text sink.
    """
    # each source is read once for its roll-up and once for the keywords; the
    # sections share those shuffles, and nothing runs while the plan is made
    posts = roll_up(data.channel, ["channel_id", "channel_name", "user_label"])
    turns = roll_up(data.chat, ["owner"])
    mentions = _all_mentions(data)
    meta = activity.report_metadata(
        posts, data.chats, turns, data.knowledge, data.channels, data.errors, since, until, tz
    )
    channels = activity.top_channels(posts).withColumn("o", -F.col("n"))
    owners = activity.chat_usage(turns).withColumn("o", -F.col("n"))
    users = activity.top_users(posts).withColumn("o", -F.col("posts"))
    links = activity.joined_links(activity.channel_links(posts, base_url))
    first_items = activity.newest_knowledge(data.knowledge, 5)
    risks = _ranked(activity.risk_mentions(mentions), "first_seq", "word_pos")
    # one row of figures: each fact is a one-row table, and one aggregate puts them side by side
    facts = {
        "top_channels": _listed(channels, ["o", "first_seq"], _text(F.col("channel"), " (", F.col("n"), ")"), "top_channels", "なし"),
        "top_users": _listed(users, ["o", "user_name"], F.col("user_name"), "top_users", "なし"),
        "links": links,
        "top_owners": _listed(owners, ["o", "first_seq"], _text(F.col("owner"), " (", F.col("n"), ")"), "top_owners", "unknown"),
        "item_names": _listed(first_items, ["seq"], F.col("name"), "item_names", ""),
        "item_urls": _listed(first_items, ["seq"], first_truthy(F.col("url"), F.col("id"), default="なし"), "item_urls", ""),
    }
    rows = meta.select(F.struct("*").alias("meta"))
    rows = rows.unionByName(risks.agg(F.collect_list(F.struct("i", "word", "n")).alias("risks")), allowMissingColumns=True)
    for name, fact in facts.items():
        rows = rows.unionByName(fact.select(F.lit(name).alias("fact"), F.col(name).alias("text")), allowMissingColumns=True)
    scalars = rows.agg(
        F.first("meta", ignorenulls=True).alias("meta"), F.first("risks", ignorenulls=True).alias("risks"),
        *[F.max(F.when(F.col("fact") == name, F.col("text"))).alias(name) for name in facts],
    ).select("meta.*", "risks", *facts)
    opening = _opening(scalars)

    actions = _ranked(activity.top_actions(mentions), F.desc("n"), "first_seq", "word_pos")

    def or_default(section: int, title: str, rows: DataFrame, entry: list[Column], none: list[str], key: Column | None = None) -> DataFrame:
        counted = rows.agg(F.count(F.lit(1)).alias("c"))
        opening = counted.select(_lines(section, F.lit(0), F.lit(""), F.lit(title)))
        fallback = counted.filter(F.col("c") == 0).select(_lines(section, F.lit(1), *[F.lit(t) for t in none]))
        return opening.unionByName(rows.select(_lines(section, F.col("i"), *entry, key=key))).unionByName(fallback)

    word, n = F.col("word"), F.col("n")
    action_part = or_default(
        2, ACTIONS, actions,
        [
            _text(F.col("i"), ". `", word, "` に関する確認"),
            _text("   - 🧭 概要：`", word, "` が ", n, " 件の投稿で言及されています。担当者と期限を確認してください。"),
            F.lit("   - 👥 担当者：未定（チャンネルオーナー確認）"), F.lit("   - ⏰ 期限：次回定例まで"),
        ],
        [
            "1. 継続監視", "   - 🧭 概要：目立ったアクションまたはリスク関連キーワードは検出されませんでした。",
            "   - 👥 担当者：チャンネル参加者全員", "   - ⏰ 期限：次回レポートまで",
        ],
    )
    linked = scalars.select("links", F.inline("risks"))
    risk_part = or_default(
        3, RISKS, linked,
        [
            _text(F.col("i"), ". `", word, "` の継続監視が必要"),
            _text("   - 🧭 概要：`", word, "` が ", n, " 件の投稿で言及されています。根本原因の特定状況を確認してください。"),
            F.lit("   - 👥 関連ユーザー：未特定（該当スレッド確認）"), _text("   - 🔗 URL：", F.col("links")),
        ],
        [
            "1. 顕在化した重大リスクなし", "   - 🧭 概要：エラー・障害系キーワードの集中は確認されませんでした。",
            "   - 👥 関連ユーザー：なし", "   - 🔗 URL：なし",
        ],
    )
    user_rows = activity.user_activity(posts, turns).withColumn("i", F.lit(1))
    user_part = or_default(
        4, USERS, user_rows,
        [_text("- ", F.col("user_name"), "：🗨️ ", F.col("channel_posts"), "件のチャンネル投稿、🤖 ", F.col("chat_messages"), "件のチャット利用")],
        ["- 対象ユーザーの投稿はありませんでした。"], key=F.col("user_name"),
    )
    items = _ranked(activity.newest_knowledge(data.knowledge), "seq")
    item_part = or_default(
        5, KNOWLEDGE, items, [_text("- ", F.col("name"), "：", F.coalesce(iso_utc(F.col("ts")), F.lit("日時不明")))],
        ["- 指定期間内に追加されたナレッジはありませんでした。"],
    )
    faults = _ranked(activity.error_ledger(data.errors), "seq")
    fault_open = faults.filter(F.col("i") == 1).select(_lines(6, F.lit(0), F.lit(""), F.lit(NOTES)))
    fault_part = fault_open.unionByName(
        faults.select(_lines(6, F.col("i"), _text("- ", F.col("source"), ": ", F.col("reason"))))
    )
    report = opening
    for part in (action_part, risk_part, user_part, item_part, fault_part):
        report = report.unionByName(part)
    return report
