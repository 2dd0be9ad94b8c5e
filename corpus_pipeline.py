"""A corpus pipeline: quality classifier, near-duplicates, PII, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written
as Parquet and read again as docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, mixing, near_dedup, pii, quality_model
from pagewright.llm.common import read_table, remove_folder, use_checkpoints

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the documents given here.

    Null and empty texts are scored like any other, and equal rows stay or go together; a row without doc_id is scored
    but never learned from. Without labelled rows everything stays. An empty table gives an empty one.
    """
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Documents without doc_id stay."""
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data and secrets; n_chars counts the new text, and is null with it."""
    return pii.pseudonymise(docs, pii.DEMO_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to their sources' targets; one that is taken twice comes twice.

    Null and empty texts have no words and are not in the mix. A null source is one of its own. Rows that repeat or lack
    a doc_id are members of their own.
    """
    return mixing.mixed_documents(docs, ordered=False).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and of the decoded text; a null text has none."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), bpe.default_path()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Learned models, keyed permutations and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between them is written to the shared checkpoint folder."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")  # only the last one is read by what is returned
    return docs
