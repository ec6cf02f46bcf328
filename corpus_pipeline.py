"""A corpus made ready for training: language, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, in the columns of ``documents``; the last gives the packed
pieces. Every stage is written as Parquet to the shared folder and read again as the input of the next.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanewise.llm import byte_gru, order_minhash, packing, secret_forest
from lanewise.llm.common import few_at_once, saved
from lanewise.llm.queries import TOKENIZER, language_model


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without letters go."""
    few_at_once(spark)
    model = language_model(docs)
    texts = docs.where("text IS NOT NULL")
    # a text has one language wherever it stands: rows are matched by their text, not by an id that may be null
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    rejected = saved(byte_gru.predict(keyed, model, "key").where(F.col("lang_pred") == byte_gru.UND).select("key").distinct())
    return texts.join(rejected, F.xxhash64("text") == F.col("key"), "left_anti").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows that repeat id and text are one document; null ids stay."""
    few_at_once(spark)
    kept = saved(order_minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced by a mark and ``n_chars`` counted anew where it was counted."""
    words = secret_forest.dictionary(docs)
    model = secret_forest.train(secret_forest.labelled_findings(docs), words)
    clean = secret_forest.redact(docs, secret_forest.scan(docs, model, words))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    few_at_once(spark)
    return packing.pack(docs, TOKENIZER).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                                "sequence_id", "offset", "window")


STAGES = [("language", identify), ("near copies", deduplicate), ("secrets", hide_secrets), ("packing", pack)]
ORACLE_SQL = None  # a trained network, hashing and tokens are beyond SQL; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
