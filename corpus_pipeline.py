"""The training-data pipeline: STAGES applied one after the other to the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents, whatever further columns there are and however they are named; the last returns packed pieces. run()
writes every stage's rows to the shared folder before the next. An empty table gives no rows at any stage; repeated
rows get equal decisions at each but the near-duplicate stage, where one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepframe.llm import langid, ngram_join, packing, pii, toxicity
from stepframe.shared import materialise, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the ordinal regression finds toxic go; a chance just at the cut is toxic.

    Null and empty texts stay, as do rows without a doc_id that are clean; without labels of both classes all stay.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, in no learned language or with no language better than chance, go.

    Null and empty texts have no letters. Ties go to the first language in alphabetical order, so they change nothing here.
    """
    ship_package(spark)
    return langid.keep_known(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one with the least doc_id.

    Null and empty texts are like nothing and all stay; rows without a doc_id stay; of rows that repeat doc_id and text one
    stays.
    """
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind in angle brackets; n_chars follows unless it is null.

    Every row stays; null and empty texts are unchanged.
    """
    ship_package(spark)
    return pii.mask(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: best-fit decreasing into windows of 4096 ids.

    Null and empty texts are a piece with the end id alone; repeated rows and rows without a doc_id are packed each; equal
    lengths go by doc_id, nulls first.
    """
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: Learned models and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, spark)
    return docs
