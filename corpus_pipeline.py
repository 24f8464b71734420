"""From documents to token ids: five stages, each written as Parquet and read again as the next one's input.

The first four keep or drop whole rows and return the columns of `documents`; the last returns the ids.

1. quality   rows that the classifier scores below its threshold go
2. exact     of texts that are equal but for white space one stays
3. near      of SimHash groups (three words to a shingle, two bits) one document stays
4. leaks     texts that hold a benchmark item go
5. tokens    doc_id, n_tokens, ids, decoded_sha256 of what is left
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from flowsentry.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_equal_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words_in_shingle=3, distance=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, forms=("ids", "bytes"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").cast("array<int>").alias("ids"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", to_tokens),
]

#: SQL cannot express the classifier, the fingerprints' components or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
