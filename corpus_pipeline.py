"""The corpus pipeline: documents in, packed token sequences out.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents:

1. language ID drops documents whose language can't be told (a null text or one without a letter) and texts in a language that wasn't learned;
2. SimHash near-dedup keeps one document of each group, that with the smallest doc_id (null last); texts that share a doc_id are told apart, and
   of rows that repeat doc_id and text one stays;
3. secret scans replace every secret by a mark, and drop nothing;
4. mixing takes each document as often as its source's target weight asks for, which may be never; rows that are equal in every column share their copies;
5. packing cuts the texts' tokens into pieces and packs these into sequences.

Equal rows have equal fates in stages 1 and 3. Empty tables give empty results in all stages. Texts of any length are worked on whole. Columns beyond those of documents, whatever their names, are carried by the first four
stages as they are; the last one returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import langid, mixing, packing, secrets, simhash
from ragloom.session import scratch_path
from ragloom.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", pack),
]

#: Language ID, near duplicates and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
