"""The corpus pipeline: documents in, training sequences out.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns the
pieces of the packed sequences. Nulls, empty texts and repeated rows are treated as the operators say; repeated rows
count as copies, so one of them stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.llm import ngram_join, packing, quality, secrets, substring_dedup
from graphlog.llm.common import WORD, cut, ensure_checkpoint_dir, remove_later


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id, else, if none has one, some text's row.

    Rows without an id and without words are classes of their own and stay.
    """
    classes = cut(ngram_join.join(docs, with_keys=True))
    first = classes.filter("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id").dropDuplicates(["doc_id", "text"])
    nameless = docs.filter("doc_id is null")
    only = classes.filter("doc_id is null and class_id is null and class_key is not null").groupBy("class_key").agg(F.min("tkey").alias("_tkey"))
    chosen = nameless.join(only.select("_tkey"), F.xxhash64("text") == F.col("_tkey"), "left_semi").dropDuplicates(["text"])
    wordless = nameless.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return named.select(docs.columns).unionByName(chosen).unionByName(wordless)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller id; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    struck = substring_dedup.dedup(docs, keep=rest, whole=True)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    named = {"text": F.col("kept"), "n_chars": chars}
    return struck.select(*[named.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with confirmed secrets replaced; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_scan),
    ("best-fit packing", packed_sequences),
]

#: Tokenising and the forest have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what each keeps is stored in the shared folder and read again by the next.

    The folder is removed when the application ends.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
