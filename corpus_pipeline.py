"""A corpus from raw documents to token ids, in five stages.

Each stage is ``(spark, docs, folder) -> DataFrame``; ``run`` writes what it returns as Parquet to the
shared folder and hands what it reads back to the next one. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.bpe import tokenized
from tablecraft.llm.common import table
from tablecraft.llm.mixing import mix_documents
from tablecraft.llm.secrets import mask_secrets
from tablecraft.llm.simhash import without_near_copies
from tablecraft.llm.toxicity import without_toxic
from tablecraft.session import settle


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that a classifier fitted on ``labels`` predicts to be toxic go."""
    return without_toxic(docs, table(spark, folder, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return without_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets in the texts are masked; ``n_chars`` follows the text. No document goes."""
    return mask_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in training order, each as often as the mix of the sources takes it."""
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return tokenized(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: The first stage applies a fitted classifier, which SQL cannot express; tests hold it against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage, over the whole table of documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, folder), name)
    return docs
