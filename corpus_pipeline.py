"""A cleaning pipeline over ``documents``; each stage takes what the one before has kept.

1. toxicity: documents scored 0.5 or more go
2. near duplicates: of each class the document with the least id stays
3. decontamination: documents with a benchmark passage go
4. secrets: replaced in the text; no document goes
5. byte-pair encoding: counts and digests of ids and decoded text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from cloakframe.llm.common import new_scratch, prepare, row_key, table, unused


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled documents among ``docs``."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the least id."""
    return minhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    key = unused(docs, "doc_key")
    keys = found.where("contaminated").select(F.col("doc_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), "text"))
    return keyed.join(keys, key, "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    prepare()
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: Compression distances and signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
