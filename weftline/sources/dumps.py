"""JSON dumps: documents, JSON lines, envelopes, pages and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.coerce import first_truthy, strip
from weftline.functions.labels import bare_channel_name, looks_like_channel_id
from weftline.operators.rows import unpack


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per JSON file: its path and text, or its typed fields."""
    if schema is not None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )


def _is_object(text: str) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit("")), F.lit("OBJECT"))


def text_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of text files, and what numbers them.

    Lines are (path, block, at, value): the file, the byte at which the block
    of the file begins that a task reads, and a number that grows by one with
    every line of a block. Blocks are (path, block, first, before): the number
    of a block's first line and the lines of the file ahead of it, from a count
    per block and a running sum over the blocks of a file. So line numbers
    need no file to be read by one task: ``at - first + before + 1``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return lines, counts.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines files, and the lines that are no JSON objects (path, line_no, line).

    Blank lines are skipped but counted. Line numbers start at 1 and hold for
    files of any size, however many tasks read one: see :func:`text_lines`.
    """
    lines, blocks = text_lines(spark, path)
    filled = lines.filter(strip(F.col("value")) != "")
    good = filled.filter(_is_object("value")).select(F.from_json("value", schema).alias("r")).select("r.*")
    bad = filled.filter(~_is_object("value")).join(blocks, ["path", "block"])
    return good, bad.select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), F.col("value").alias("line"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like :func:`read_jsonl`, but a line that is no object fails the job."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    message = F.concat(F.lit("JSON lines must contain objects: "), F.substring("value", 1, 120))
    checked = F.when(_is_object("value"), F.col("value")).otherwise(F.raise_error(message))
    return lines.select(F.from_json(checked, schema).alias("r")).select("r.*")


def read_items(spark: SparkSession, path: str | None = None, inline: str | None = None, schema: str | None = None) -> DataFrame:
    """Items of a JSON array given as a file or inline; ``seq`` keeps order."""
    if path:
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.createDataFrame([(inline or "[]",)], "value string")
    fields = schema or "map<string,string>"
    return text.select(F.posexplode(F.from_json("value", f"array<{fields}>")).alias("seq", "item")).select("seq", "item.*" if schema else "item")


def envelope_items(dump: DataFrame, keys: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """Items of a response that is a list, ``{key: [...]}`` or ``{data: [...]}``."""
    raw = F.col(payload)

    def listed(text: Column) -> Column:
        return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<variant>"))

    found = F.coalesce(listed(raw), *[listed(F.get_json_object(raw, f"$.{k}")) for k in (*keys, "data")])
    kept = [c for c in dump.columns if c != payload]
    return unpack(dump, kept, found, "seq", "item")


def channels(dump: DataFrame, payload: str = "payload") -> DataFrame:
    """Channel rows: id and name with their aliases; rows without id drop out."""
    items = envelope_items(dump, ("channels",), payload)

    def text(name: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", "string")

    is_object = F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))
    return items.filter(is_object).select(
        "seq", first_truthy(text("id"), text("channel_id")).alias("id"),
        first_truthy(text("name"), text("title"), default="").alias("name"),
        text("description").alias("description"), F.to_json("item").alias("raw"),
    ).filter(F.col("id").isNotNull())


def stitch_pages(pages: DataFrame, page_size: int = 100, max_pages: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Items of a paged dump up to and including the first short page, or ``max_pages`` if given.

    ``pages``: page, items (plus ``keys``). Only page numbers and sizes are
    aggregated; the items stay where they are.
    """
    groups = keys or ["_all"]
    sized = pages if max_pages is None else pages.filter(F.col("page") < max_pages)
    if not keys:
        sized = sized.withColumn("_all", F.lit(0))
    ends = sized.groupBy(*groups).agg(F.min(F.when(F.size("items") < page_size, F.col("page"))).alias("_end"))
    wanted = sized.join(ends, groups, "left").filter(F.col("_end").isNull() | (F.col("page") <= F.col("_end")))
    return wanted.select(*(keys or []), "page", F.posexplode("items").alias("pos", "item"))


def page_of(df: DataFrame, order_by: list[str], skip: int = 0, limit: int = 50) -> DataFrame:
    """One offset/limit page of a table."""
    return df.orderBy(*order_by).offset(skip).limit(limit)


def hydrate(summaries: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Each summary row replaced by its detail row.

    Without a detail the summary stays and ``error`` says so.
    """
    shared = [c for c in summaries.columns if c != key and c in details.columns]
    extra = [c for c in details.columns if c != key and c not in summaries.columns]
    right = details.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_d_{c}") for c in (*shared, *extra)])
    joined = summaries.join(right, key, "left")
    found = F.coalesce("_found", F.lit(False))
    kept = [
        (F.when(found, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c))
        for c in summaries.columns
    ]
    no_id = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    return joined.select(
        *kept, *[F.col(f"_d_{c}").alias(c) for c in extra],
        F.when(~found & ~no_id, "detail not available").alias("error"),
    )


def preferred_export(export: DataFrame | None, listing: DataFrame, details: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the full export where there is one, else the hydrated listing.

    The second table lists warnings: the missing export and missing details.
    """
    spark = listing.sparkSession
    none = spark.createDataFrame([], "source string, reason string")
    if export is not None:
        return export, none
    rows = hydrate(listing, details, key)
    warning = spark.createDataFrame([("export", "full export not available, using the visible list")], "source string, reason string")
    lost = rows.filter(F.col("error").isNotNull()).select(F.col(key).cast("string").alias("source"), F.col("error").alias("reason"))
    return rows.filter(F.col("error").isNull()).drop("error"), warning.unionByName(lost)


def file_content(files: DataFrame, extracted: DataFrame, raw: DataFrame) -> DataFrame:
    """Extracted text of each file, its raw text where nothing was extracted."""
    texts = extracted.select("file_id", F.lit(True).alias("_has"), F.col("content").alias("_x"))
    joined = files.join(texts, "file_id", "left").join(raw.select("file_id", F.col("content").alias("_r")), "file_id", "left")
    chosen = F.coalesce(F.when(F.col("_has"), F.coalesce("_x", F.lit(""))), "_r", F.lit(""))
    return joined.withColumn("content", chosen).drop("_has", "_x", "_r")


def resolve_channels(requests: DataFrame, channel_rows: DataFrame, default: str = "") -> DataFrame:
    """Channel id per request: id-shaped text passes, else an exact name match.

    Of several channels with one name the first in the list counts.
    """
    asked = F.when(strip(F.coalesce("channel", F.lit(""))) == "", F.lit(default)).otherwise(F.col("channel"))
    wanted = requests.withColumn("_v", strip(asked))
    is_id = ~F.startswith("_v", F.lit("#")) & looks_like_channel_id(F.col("_v"))
    wanted = wanted.withColumn("_name", F.when(~is_id, bare_channel_name(F.col("_v")))).withColumn("_is_id", is_id)
    names = channel_rows.groupBy(F.col("name").alias("_name")).agg(F.min_by("id", "seq").alias("_id"))
    joined = wanted.join(names, "_name", "left")
    error = (
        F.when(F.col("_v") == "", "channel is required")
        .when(~F.col("_is_id") & F.col("_id").isNull(), F.concat(F.lit("channel not found: "), F.col("_name")))
    )
    return joined.select(
        *requests.columns,
        F.when(F.col("_is_id"), F.col("_v")).otherwise(F.col("_id")).alias("channel_id"),
        F.when(~F.col("_is_id") & F.col("_id").isNotNull(), F.col("_name")).alias("channel_name"), error.alias("error"),
    )
