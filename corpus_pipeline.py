"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, token encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to ``documents`` one after another. Every stage is written as Parquet to
the shared folder and read again, so a lost executor or a restart costs at most
one stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import language, line_templates, merge_encoding, minhash_dedup, mixing
from weftline.llm.queries import piece_model
from weftline.llm.text_features import fold
from weftline.session import ensure_checkpoint_dir, remove_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the predicted language; below it the language counts as unknown.
LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: no text, no letter, or a low score.

    The model learns from ``lang`` outside the held-out fold. Without any
    labelled document nothing can be recognised, and all are kept.
    """
    model = language.train(docs, "doc_id", "text", "lang", fold(F.col("doc_id"), 4) != 2)
    if model is None:
        return docs.select(*COLUMNS)
    found = language.predict(docs.select(*COLUMNS), "text", model, "_lang", "_score")
    return found.filter((F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines whose template recurs; a document that loses all of them goes, one that was empty before stays."""
    cut = line_templates.drop_recurring_lines(docs.select(*COLUMNS), "doc_id", "text")
    emptied = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return cut.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group; documents without an id stay.

    Of rows that repeat an id and a text one stays; different texts under an id
    stay apart, unless the id as a whole is a copy of a smaller one.
    """
    found = minhash_dedup.near_duplicates(docs, "doc_id", "text")
    gone = found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("doc_id"))
    known = docs.select(*COLUMNS).filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    # the join has dealt the rows by id already
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*COLUMNS[2:])
    one = known.withColumn("_n", F.row_number().over(same)).filter("_n = 1").select(*COLUMNS)
    return one.unionByName(docs.select(*COLUMNS).filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix says; repeats are rows of their own."""
    mixed = mixing.mix(docs.select(*COLUMNS), "doc_id", "text", "source")
    return mixed.filter(F.col("copies") > 0).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every whole text, their number, and the SHA-256 of the text read back from them."""
    encoded = merge_encoding.encode(docs.select("doc_id", "source", "text"), "text", piece_model(), decoded="decoded")
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: A trained language model and hashed signatures have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")  # the next stage stands
        before = name
    return docs
