"""Daily activity counts over a stream of message dumps.

An addition to the batch report, whose default window is one day: the same
counts kept up to date as dump files arrive. Ids repeated within the watermark
are counted once and rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.activity import ACTION_WORDS


def read_messages(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def distinct_messages(messages: DataFrame, delay: str = "1 day", ts: str = "ts", key: str = "id") -> DataFrame:
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_users(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """Posts per user and day."""
    day = F.window(ts, "1 day")
    return messages.groupBy(day.alias("w"), "user_label").agg(F.count(F.lit(1)).alias("posts")).select(
        F.col("w.start").alias("day"), "user_label", "posts"
    )


def daily_totals(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per kind and day."""
    return messages.groupBy(F.window(ts, "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("day"), "kind", "n"
    )


def daily_keywords(messages: DataFrame, ts: str = "ts", words: tuple[str, ...] = ACTION_WORDS) -> DataFrame:
    """Messages per day that mention each action word; one aggregate per word."""
    text = F.lower("content")
    counts = [F.count_if(F.contains(text, F.lit(w.lower()))).alias(f"n{i}") for i, w in enumerate(words)]
    entries = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"n{i}").alias("n")) for i, w in enumerate(words)])
    daily = messages.groupBy(F.window(ts, "1 day").alias("w")).agg(*counts)
    return daily.select(F.col("w.start").alias("day"), F.inline(entries)).filter(F.col("n") > 0)


def start(counts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write finished days to ``path``; state lives in the checkpoint folder."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
