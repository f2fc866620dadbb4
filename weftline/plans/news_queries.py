"""Registered queries of the news family: pages as news, documents as articles,
benchmark texts as podcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import news
from weftline.plans import inputs
from weftline.plans.inputs import table

Q: dict = {}
SQL: dict = {}
UNTIL = "2024-01-09 12:00:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def article_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("category"), F.col("lang").alias("genre"),
        F.col("source").alias("site"), F.lit("2024-01-02").alias("published"), F.col("text").alias("content"),
        F.col("lang").alias("audience"), F.col("n_chars").cast("string").alias("learning_points"),
    )


def podcast_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("seq"), F.concat(F.lit("Episode "), F.col("item_id").cast("string")).alias("episode_title"),
        F.lit("Bench FM").alias("show"),
        F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).alias("episode_number"), F.col("text").alias("description"),
    )


_NEWS = f"news as (select *, 'トピック' as category, '' as source_category, '' as impact_hint from ({inputs.FEED_SQL}))"
_ARTICLES = """articles as (select doc_id as seq, 'Doc ' || doc_id as title, lang as category, '' as source_category, source, '' as url,
'2024-01-02' as published_at, text as raw_summary, lang as audience_hint, cast(n_chars as varchar) as learning_hint, '' as use_case_hint from documents)"""
_PODCASTS = """podcasts as (select item_id as seq, 'Episode ' || item_id as title, 'Podcast' as category, '' as source_category, 'Bench FM' as source,
'' as url, '' as published_at, case when item_id % 2 = 0 then cast(item_id as varchar) else 'Bench FM' end as episode, text as raw_summary,
'' as highlight_hint, '' as audience_hint from benchmark)"""
_ALL = f"""{_NEWS}, {_ARTICLES}, {_PODCASTS},
items as (select 'news' as section, seq, category, title, source, url, published_at from news
union all select 'articles', seq, category, title, source, url, published_at from articles
union all select 'podcasts', seq, category, title, source, url, published_at from podcasts)"""


@query("news_normalise", f"""
with {_NEWS} select seq, title, category, source, source_category, url, published_at, raw_summary, impact_hint
from (select * replace (case when title = '' then 'タイトル未設定' else title end as title) from news)""")
def news_normalise(spark, d):
    return news.normalize_news(inputs.feed_items(spark, d))


@query("article_normalise", f"with {_ARTICLES} select * from articles")
def article_normalise(spark, d):
    return news.normalize_articles(article_rows(spark, d))


@query("podcast_normalise", f"with {_PODCASTS} select * from podcasts")
def podcast_normalise(spark, d):
    return news.normalize_podcasts(podcast_rows(spark, d))


def all_items(spark: SparkSession, d: str) -> DataFrame:
    return news.all_sections(
        news.normalize_news(inputs.feed_items(spark, d)), news.normalize_articles(article_rows(spark, d)),
        news.normalize_podcasts(podcast_rows(spark, d)),
    )


@query("news_inventory", f"""
with {_ALL} select section, item_no, '- ' || item_no || '. ' || category || ': ' || title || ' - ' || source || ' (' || case when url = '' then 'N/A' else url end || ')' as line
from (select *, row_number() over (partition by section order by seq) as item_no from items)""")
def news_inventory(spark, d):
    return news.inventory(all_items(spark, d))


@query("news_section_counts", f"with {_ALL} select section, count(*) as items from items group by 1")
def news_section_counts(spark, d):
    return news.section_counts(all_items(spark, d))


@query("news_document", f"""
with {_ALL}, c as (select section, case section when 'news' then 1 when 'articles' then 2 else 3 end as p, count(*) as n from items group by 1, 2)
select 0 as part, 0 as pos, '# 技術ニュースレポート source inventory (2024-01-09)' as line
union all select 0, 1, '- focus: 生成AI、クラウド、FinOps、開発ツール'
union all select 0, p + 1, '- ' || section || ': ' || n from c
union all select p, 0, chr(10) || '## ' || section from c
union all select case section when 'news' then 1 when 'articles' then 2 else 3 end, row_number() over (partition by section order by seq),
'- ' || row_number() over (partition by section order by seq) || '. ' || category || ': ' || title || ' - ' || source || ' (' || case when url = '' then 'N/A' else url end || ')' from items""")
def news_document(spark, d):
    return news.inventory_document(all_items(spark, d), "2024-01-09")


@query("news_report_input", f"""
with {_ALL} select '技術ニュースレポート' as report_title, '2024-01-09' as report_date, section, seq, title as item_title, source as item_source from items""")
def news_report_input(spark, d):
    lines = news.report_input(all_items(spark, d), "2024-01-09")
    return lines.select(
        "report_title", "report_date", "section", "seq",
        F.get_json_object("item", "$.title").alias("item_title"), F.get_json_object("item", "$.source").alias("item_source"),
    )


@query("news_feed_category", f"""
with f as ({inputs.FEED_SQL}) select seq, feed_url, case when source like '%.com' then 'a com' when source like '%.org' then 'org' else 'own' || seq % 3 end as source_category from f""")
def news_feed_category(spark, d):
    """The registry lists some feeds twice; items of feeds it does not list keep their own label."""
    items = inputs.feed_items(spark, d).select("seq", "feed_url", F.concat(F.lit("own"), (F.col("seq") % 3).cast("string")).alias("source_category"))
    registry = inputs.feed_items(spark, d).select("feed_url", "site").distinct().select(
        F.col("feed_url").alias("url"), F.when(F.col("site").endswith(".com"), "com").when(F.col("site").endswith(".org"), "org").alias("source_category"),
    ).filter(F.col("source_category").isNotNull())
    registry = registry.unionByName(registry.filter("source_category = 'com'").withColumn("source_category", F.lit("a com")))
    return news.with_feed_category(items, registry)


def dated_items(spark: SparkSession, d: str) -> DataFrame:
    """Feed items whose dates come as ISO text, as RFC 822 text in two zones, or not at all."""
    ts = F.to_timestamp("date")
    mail = F.date_format(ts + F.make_dt_interval(hours=F.lit(9)), "EEE, d MMM yyyy HH:mm:ss")
    form = F.col("seq") % 4
    date = F.when(form == 0, F.col("date")).when(form == 1, F.concat(mail, F.lit(" +0900"))).when(form == 2, F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return inputs.feed_items(spark, d).withColumn("date", date)


_DATED = f"d as (select *, case when seq % 4 < 3 then strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') end as ts from ({inputs.FEED_SQL}))"


@query("news_recent_dates", f"with {_DATED} select seq from d where ts between timestamp '{UNTIL}' - interval 72 hours and timestamp '{UNTIL}'")
def news_recent_dates(spark, d):
    return news.recent(news.normalize_news(dated_items(spark, d)), UNTIL).select("seq")


@query("news_recent", f"""
with f as ({inputs.FEED_SQL}) select seq, published_at from f
where strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') between timestamp '{UNTIL}' - interval 72 hours and timestamp '{UNTIL}'""")
def news_recent(spark, d):
    items = news.normalize_news(inputs.feed_items(spark, d))
    return news.recent(items, UNTIL).select("seq", "published_at")


def ranked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items; the first line is the title, so copies collide."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.split("text", "\n").getItem(0).alias("title"), "source",
        F.lit("articles").alias("section"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("source_priority"),
        F.when(F.col("doc_id") % 5 > 0, F.format_string("2024-01-%02d", (F.col("doc_id") % 28 + 1).cast("int"))).alias("published_at"),
    )


_RANKED = """docs as (select doc_id as seq, string_split(text, chr(10))[1] as title, source, 'articles' as section,
case when lang = 'en' then 0 else 1 end as source_priority, case when doc_id % 5 > 0 then '2024-01-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') end as published_at from documents)"""
_TOPIC = r"sha256(trim(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}]+', ' ', 'g')))"


@query("news_dedup", f"""
with {_RANKED}, r as (select *, {_TOPIC} as topic, row_number() over (partition by {_TOPIC} order by source_priority, published_at nulls last, seq) as rn,
count(*) over (partition by {_TOPIC}) as copies from docs)
select topic, copies, seq, title, source, section, source_priority, published_at from r where rn = 1""")
def news_dedup(spark, d):
    return news.one_per_topic(ranked_documents(spark, d))


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def titled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages under their titles, under titles with a comment added, and in other case and punctuation."""
    pages = inputs.feed_items(spark, d)
    kind = F.col("seq") % 4
    said = F.when(kind == 1, F.concat("headline", F.lit(": a comment"))).when(kind == 2, F.concat(F.lit("On "), F.translate("headline", _SMALL, _SMALL.upper()), F.lit("!"))).otherwise(F.col("headline"))
    return pages.select("seq", said.alias("title"), "site", F.when(kind == 0, 0).otherwise(1).alias("source_priority"), F.col("date").alias("published_at"))


@query("news_same_topic", rf"""
with recursive f as ({inputs.FEED_SQL}), t as (select seq, published_at, case when seq % 4 = 0 then 0 else 1 end as p,
 case seq % 4 when 1 then title || ': a comment' when 2 then 'On ' || translate(title, '{_SMALL}', '{_SMALL.upper()}') || '!' else title end as title from f),
w as (select *, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))) as words from t),
k as (select words, min(seq) as rep from w group by words),
s as (select rep, words, unnest(words) as token from k), c as (select a.rep as a, b.rep as b, count(*) as common, len(any_value(a.words)) + len(any_value(b.words)) as n
 from s a join s b on a.token = b.token and a.rep <> b.rep group by 1, 2),
l as (select a, b from c where common >= 0.6 * (n - common) - 1e-9),
r(rep, other) as (select rep, rep from k union select r.rep, l.b from r join l on l.a = r.other),
g as (select w.*, x.topic_seq from w join k on k.words = w.words join (select rep, min(other) as topic_seq from r group by rep) x on x.rep = k.rep),
h as (select *, case when len(words) = 0 then seq else topic_seq end as topic from g),
o as (select *, row_number() over (partition by topic order by p, published_at, seq) as rn, count(*) over (partition by topic) as copies from h)
select topic as topic_seq, copies, seq, title, p as source_priority from o where rn = 1""")
def news_same_topic(spark, d):
    return news.one_per_similar_topic(titled_pages(spark, d)).select("topic_seq", "copies", "seq", "title", "source_priority")


def sectioned(spark: SparkSession, d: str) -> DataFrame:
    feed = inputs.feed_items(spark, d).select(
        "seq", F.col("site").alias("source"), F.lit("news").alias("section"),
        F.when(F.col("site").endswith(".com"), 0).otherwise(1).alias("source_priority"),
    )
    docs = ranked_documents(spark, d).select("seq", "source", "section", "source_priority")
    bench = table(spark, d, "benchmark").select(
        F.col("item_id").alias("seq"), F.lit("Bench FM").alias("source"), F.lit("podcasts").alias("section"), F.lit(0).alias("source_priority"),
    )
    return feed.unionByName(docs).unionByName(bench)


@query("news_balanced", f"""
with {_RANKED}, f as ({inputs.FEED_SQL}), s as (
select seq, source, 'news' as section, case when source like '%.com' then 0 else 1 end as source_priority from f
union all select seq, source, section, source_priority from docs union all select item_id, 'Bench FM', 'podcasts', 0 from benchmark),
t as (select *, row_number() over (partition by section, source order by source_priority, seq) as turn from s),
p as (select *, row_number() over (partition by section order by turn, source_priority, seq) as pick from t)
select section, seq, source, source_priority, turn, pick from p where pick <= case section when 'podcasts' then 3 else 5 end""")
def news_balanced(spark, d):
    return news.balanced(sectioned(spark, d)).select("section", "seq", "source", "source_priority", "turn", "pick")


@query("news_feed_topn", f"""
with {_DATED}, r as (select seq, feed_url, row_number() over (partition by feed_url order by ts desc nulls last, seq) as rn from d)
select seq, feed_url from r where rn <= 2""")
def news_feed_topn(spark, d):
    items = dated_items(spark, d).select("seq", "feed_url", F.col("date").alias("published_at"))
    return news.newest_per_feed(items, 2).select("seq", "feed_url")


@query("news_feed_all", f"with f as ({inputs.FEED_SQL}) select seq, feed_url from f")
def news_feed_all(spark, d):
    return news.newest_per_feed(inputs.feed_items(spark, d).select("seq", "feed_url"), 0)
