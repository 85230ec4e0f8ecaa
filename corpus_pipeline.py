"""From raw documents to packed training sequences: toxicity, near-duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwise.llm import mixing, packing, simhash, toxicity
from cellwise.llm.store import keep


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose text the severity model, fitted on the labelled ones, does not reject.

    Null, empty and blank texts stay; repeated rows, null and repeated doc_ids are each judged by their own text; very long texts are read whole; extra
    columns come along, whatever their names; without labels nothing is rejected; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingle sets are similar by 0.8 or more: that of the least doc_id (null last), then of the least digest of its text.

    SimHash fingerprints in BK-trees propose, the whole shingle sets decide. Rows with equal sets (null and blank texts have none) are a group; texts of one doc_id
    are rows of their own; of repeated rows one stays. Extra columns come along, whatever their names; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it: not at all, once or twice.

    A text without words weighs nothing and may be taken or not; a null source is a source; repeated rows share their copies; null and repeated doc_ids keep their own.
    Extra columns come along, whatever their names; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their token ids, each row of ``docs`` once and a null text as an empty one.

    Repeated rows and null doc_ids are packed like others; other columns are ignored; an empty table gives no pieces.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", without_toxic), ("simhash_near_dedup", without_near_duplicates), ("source_mix", mixed), ("packing", packed)]

#: Tokens, checksums and fingerprints are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
