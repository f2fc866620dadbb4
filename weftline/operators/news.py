"""News curation: normalised items, inventory, de-duplication, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.coerce import column_or_null, feed_moment, first_truthy, strip
from weftline.operators.components import similar_groups
from weftline.operators.ordering import number_rows

# Output field, its input aliases in order, and the default.
_COMMON = {
    "source_category": (("source_category", "source_genre"), ""),
    "url": (("url",), ""),
    "published_at": (("published_at", "date", "published"), ""),
    "raw_summary": (("summary", "description", "content"), ""),
}
NEWS_FIELDS = {
    "title": (("title", "headline"), "タイトル未設定"),
    "category": (("category", "genre"), "トピック"),
    "source": (("source", "site"), "出典未設定"),
    **_COMMON,
    "impact_hint": (("impact", "importance"), ""),
}
ARTICLE_FIELDS = {
    "title": (("title", "headline"), "タイトル未設定"),
    "category": (("category", "genre"), "技術記事"),
    "source": (("source", "site"), "出典未設定"),
    **_COMMON,
    "audience_hint": (("recommended_for", "audience"), ""),
    "learning_hint": (("takeaways", "learning_points", "impact"), ""),
    "use_case_hint": (("use_case", "application"), ""),
}
PODCAST_FIELDS = {
    "title": (("title", "episode_title"), "タイトル未設定"),
    "category": (("category", "genre"), "Podcast"),
    "source": (("source", "show", "program"), "番組未設定"),
    **_COMMON,
    "highlight_hint": (("highlights", "listening_points", "impact"), ""),
    "audience_hint": (("recommended_for", "audience"), ""),
}
EPISODE_ALIASES = ("episode", "episode_number", "source", "show", "program")
SECTIONS = ("news", "articles", "podcasts")
SECTION_LIMITS = {"news": 5, "articles": 5, "podcasts": 3}
REPORT_TITLE = "技術ニュースレポート"
REPORT_FOCUS = "生成AI、クラウド、FinOps、開発ツール"
NO_URL = "N/A"


def _normalized(raw: DataFrame, fields: dict[str, tuple[tuple[str, ...], str]], extra: dict[str, Column] | None = None) -> DataFrame:
    picks = [
        first_truthy(*[column_or_null(raw, a) for a in aliases], default=default).alias(name)
        for name, (aliases, default) in fields.items()
    ]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return raw.select("seq", *picks, *more)


def normalize_news(raw: DataFrame) -> DataFrame:
    return _normalized(raw, NEWS_FIELDS)


def normalize_articles(raw: DataFrame) -> DataFrame:
    return _normalized(raw, ARTICLE_FIELDS)


def normalize_podcasts(raw: DataFrame) -> DataFrame:
    """Podcast episodes; an episode without a number shows its programme."""
    names = [column_or_null(raw, a) for a in EPISODE_ALIASES]
    return _normalized(raw, PODCAST_FIELDS, {"episode": first_truthy(*names, default="番組未設定")})


def all_sections(news: DataFrame, articles: DataFrame, podcasts: DataFrame) -> DataFrame:
    """The three tables as one with a section column; absent hints are NULL."""
    parts = [d.withColumn("section", F.lit(s)) for s, d in zip(SECTIONS, (news, articles, podcasts))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def inventory(items: DataFrame) -> DataFrame:
    """Numbered source list per section, in input order.

    Three sections would mean three tasks in a plain window; the numbering is
    spread over range partitions instead.
    """
    numbered = number_rows(items.select("section", "seq", "category", "title", "source", "url"), ["seq"], ["section"], "item_no")
    line = F.concat(
        F.lit("- "), F.col("item_no").cast("string"), F.lit(". "), F.col("category"), F.lit(": "), F.col("title"),
        F.lit(" - "), F.col("source"), F.lit(" ("), first_truthy(F.col("url"), default=NO_URL), F.lit(")"),
    )
    return numbered.select("section", "item_no", line.alias("line"))


def section_counts(items: DataFrame) -> DataFrame:
    """Items per section; a section without items shows 0."""
    counts = [F.count_if(F.col("section") == s).alias(s) for s in SECTIONS]
    entries = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in SECTIONS])
    return items.agg(*counts).select(F.inline(entries))


def inventory_document(items: DataFrame, report_date: str, title: str = REPORT_TITLE, focus: str = REPORT_FOCUS) -> DataFrame:
    """All lines of the inventory (header, counts, sections) in order.

    Rows ``(part, pos, line)``: writing them sorted gives the Markdown text.
    """
    spark = items.sparkSession
    counts = section_counts(items)
    order = F.when(F.col("section") == "news", 1).when(F.col("section") == "articles", 2).otherwise(3)
    head = spark.createDataFrame(
        [(0, 0, f"# {title} source inventory ({report_date})"), (0, 1, f"- focus: {focus}")], "part int, pos bigint, line string"
    )
    tally = counts.select(
        F.lit(0).alias("part"), (order + 1).cast("bigint").alias("pos"),
        F.concat("section", F.lit(": "), F.col("items").cast("string")).alias("line"),
    ).withColumn("line", F.concat(F.lit("- "), "line"))
    titles = counts.filter(F.col("items") > 0).select(
        order.alias("part"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("\n## "), "section").alias("line")
    )
    lines = inventory(items).select(order.alias("part"), F.col("item_no").alias("pos"), "line")
    return head.unionByName(tally).unionByName(titles).unionByName(lines)


def report_input(items: DataFrame, report_date: str, title: str = REPORT_TITLE, focus: str = REPORT_FOCUS) -> DataFrame:
    """Report material, one JSON object per item with the report's header.

    JSON lines instead of one document: the arrays grow with the data.
    """
    fields = [c for c in items.columns if c not in ("seq", "section")]
    return items.select(
        F.lit(title).alias("report_title"), F.lit(report_date).alias("report_date"), F.lit(focus).alias("focus"),
        "section", "seq", F.to_json(F.struct(*fields)).alias("item"),
    )


def with_feed_category(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items labelled with the category of the feed they came from.

    A feed under several headings takes the first of them (by ``seq`` if the
    registry has it); an item of an unlisted feed keeps its own label.
    """
    place = F.col("seq") if "seq" in registry.columns else F.col("source_category")
    feeds = registry.filter(F.coalesce("source_category", F.lit("")) != "").groupBy(F.col("url").alias("feed_url")).agg(
        F.min_by("source_category", F.struct(place, F.col("source_category"))).alias("_category"))
    own = F.coalesce(column_or_null(items, "source_category"), F.lit(""))
    return items.join(feeds, "feed_url", "left").withColumn("source_category", F.coalesce("_category", own)).drop("_category")


def published_moment(items: DataFrame, published: str) -> Column:
    """The publication time; texts are read in every form feeds use."""
    return feed_moment(F.col(published)) if dict(items.dtypes)[published] == "string" else F.col(published).cast("timestamp")


def recent(items: DataFrame, until: str, hours: int = 72, published: str = "published_at") -> DataFrame:
    """Items published in the last ``hours`` before ``until``."""
    high = F.lit(until).cast("timestamp")
    ts = published_moment(items, published)
    return items.filter((ts >= high - F.make_dt_interval(hours=F.lit(hours))) & (ts <= high))


#: Share of title words that makes two items one topic.
SAME_TOPIC = 0.6


def topic_key(title: Column) -> Column:
    """Key of a topic: letters and digits of the title, lower-cased."""
    words = F.regexp_replace(F.lower(strip(title)), r"[^\p{L}\p{N}]+", " ")
    return F.sha2(F.trim(words), 256)


def one_per_topic(items: DataFrame, title: str = "title", priority: str = "source_priority", published: str = "published_at") -> DataFrame:
    """One item per topic: primary sources first, then the earliest; an item without a date comes last.

    Only the keys are reduced, before the shuffle, so a topic that holds a
    third of all items sends one short row per task; the chosen items are then
    joined by their ``seq``, which identifies an item.
    """
    ts = published_moment(items, published)
    order = F.struct(F.col(priority).isNull().alias("p0"), F.col(priority).alias("p"), ts.isNull().alias("t0"), ts.alias("t"), F.col("seq").alias("seq"))
    best = items.groupBy(topic_key(F.col(title)).alias("topic")).agg(F.min(order)["seq"].alias("_seq"), F.count(F.lit(1)).alias("copies"))
    return items.join(best, items["seq"] == best["_seq"]).select("topic", "copies", *[items[c] for c in items.columns])


def one_per_similar_topic(
    items: DataFrame, threshold: float = SAME_TOPIC, title: str = "title", priority: str = "source_priority", published: str = "published_at",
) -> DataFrame:
    """One item per topic under whatever titles: ``topic_seq``, ``copies`` and the item's columns.

    Items are of one topic if their titles share at least ``threshold`` of
    their words (Jaccard), directly or over other titles; ``topic_seq`` is the
    smallest ``seq`` of the topic. Primary sources first, then the earliest, as
    in :func:`one_per_topic`. Only keys are grouped; items are joined by ``seq``.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(strip(F.col(title))), r"[^\p{L}\p{N}]+", " ")), " ")
    words = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != "")
    ts = published_moment(items, published)
    keyed = items.select("seq", F.col(priority).alias("_p"), ts.alias("_t"), words.alias("_words"))
    order = F.struct(F.col("_p").isNull().alias("p0"), F.col("_p").alias("p"), F.col("_t").isNull().alias("t0"), F.col("_t").alias("t"), F.col("seq").alias("seq"))
    grouped = similar_groups(keyed, "seq", "_words", threshold).join(keyed.drop("_words"), "seq")
    best = grouped.groupBy(F.col("group").alias("topic_seq")).agg(F.min(order)["seq"].alias("_seq"), F.count(F.lit(1)).alias("copies"))
    return items.join(best, items["seq"] == best["_seq"]).select("topic_seq", "copies", *[items[c] for c in items.columns])


def balanced(items: DataFrame, limits: dict[str, int] | None = None, source: str = "source", priority: str = "source_priority") -> DataFrame:
    """Items per section taken in turn from each source, up to the limit.

    No source can place more than ``limit`` items, so ranks beyond it are
    dropped before the second ranking; both ranks are limited ahead of their
    shuffle.
    """
    limits = limits or SECTION_LIMITS
    most = max(limits.values())
    per_source = Window.partitionBy("section", source).orderBy(priority, "seq")
    turns = items.withColumn("turn", F.row_number().over(per_source)).filter(F.col("turn") <= most)
    per_section = Window.partitionBy("section").orderBy("turn", priority, "seq")
    ranked = turns.withColumn("pick", F.row_number().over(per_section)).filter(F.col("pick") <= most)
    allowed = F.coalesce(*[F.when(F.col("section") == s, n) for s, n in limits.items()], F.lit(0))
    return ranked.filter(F.col("pick") <= allowed)


def newest_per_feed(items: DataFrame, count: int = 1, feed: str = "feed_url", published: str = "published_at") -> DataFrame:
    """Newest ``count`` items of each feed, by date; undated ones come last. 0 keeps all."""
    if count == 0:
        return items
    order = Window.partitionBy(feed).orderBy(published_moment(items, published).desc_nulls_last(), "seq")
    return items.withColumn("feed_rank", F.row_number().over(order)).filter(F.col("feed_rank") <= count).drop("feed_rank")
