"""Feed registry and feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.coerce import feed_moment, lines_of, strip
from weftline.operators.rows import unpack

# Element names of the three feed formats.
ITEM_TAGS = {"rss": "item", "rdf": "item", "atom": "entry"}
_RSS_SCHEMA = "title string, link string, description string, pubDate string, date string, category array<string>"
_ATOM_SCHEMA = (
    "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, "
    "published string, updated string"
)


def registry_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Feed URLs with the heading they stand under.

    Runs inside the row of a registry text: the heading of a URL is the last
    heading line before it.
    """
    def rows(lines: Column) -> Column:
        def is_heading(s: Column) -> Column:
            return F.startswith(s, F.lit("#"))

        def labelled(line: Column, i: Column) -> Column:
            above = F.try_element_at(F.filter(F.slice(lines, F.lit(1), i + 1), is_heading), F.lit(-1))
            return F.struct(strip(F.ltrim(above, F.lit("#"))).alias("source_category"), line.alias("url"))

        return F.filter(F.transform(lines, labelled), lambda r: r["url"].rlike(r"^https?://"))

    found = let(F.transform(lines_of(F.col(text)), strip), rows)
    kept = [c for c in texts.columns if c != text]
    return unpack(texts, kept, found, "_n").select(*kept, (F.col("_n") + 1).alias("seq"), "source_category", "url")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_rows(spark.read.text(path, wholetext=True))


def read_feed_items(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """Items of feed dumps as texts, with the date also as a timestamp (``published_ts``)."""
    schema = _ATOM_SCHEMA if kind == "atom" else _RSS_SCHEMA
    rows = spark.read.format("xml").option("rowTag", ITEM_TAGS[kind]).schema(schema).load(path)
    feed = F.col("_metadata.file_path").alias("feed_url")
    if kind == "atom":
        link = F.coalesce(
            F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
            F.get("link", F.lit(0))["_href"],
        )
        return rows.select(
            feed, "title", link.alias("url"), F.coalesce("published", "updated").alias("published_at"),
            F.coalesce("summary", "content").alias("summary"), feed_moment(F.coalesce("published", "updated")).alias("published_ts"),
        )
    return rows.select(
        feed, "title", F.col("link").alias("url"), F.coalesce("pubDate", "date").alias("published_at"),
        F.col("description").alias("summary"), feed_moment(F.coalesce("pubDate", "date")).alias("published_ts"),
    )
