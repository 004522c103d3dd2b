"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomcube.llm import bpe, decontam, jaccard, quality_rules, suffix_dedup
from loomcube.llm.common import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts too, as they have no words. Repeated rows are judged alike."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and similar texts stays: that of the least doc_id, a null one last. Of repeated rows one stays; null and empty texts are equal."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that also start earlier are cut out: by doc_id, a null one first, then by digest. Texts of which nothing is left go; null and short ones stay as they are."""
    return suffix_dedup.drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay, repeated rows are judged alike, and so do all rows if the benchmark is empty."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and the digest of what they decode to; null and empty texts have none, repeated rows are kept."""
    return bpe.encode_documents(docs, *bpe.default_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: Suffix arrays, alignment and merges by rank are beyond SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives; the folder of a stage goes once the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
