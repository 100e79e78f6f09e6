"""The corpus pipeline: raw documents to a deduplicated, cleaned, mixed and encoded
training set.  Each stage takes all documents that the one before it kept.

Defined results, for every stage: null and empty texts are judged like others (all of them
are one group of near copies, and the mix, which counts words, takes none of them); texts
are read whole, however long; rows of a null id stay rows; rows that are alike are copies
of each other; ties of copies go to the smallest id; a null source is a source of its own;
columns of any name pass through all stages but the last, whose result has the id and the
encoding only; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import bpe, mixture, quality, secret_scan, simhash
from varloom.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks and ``n_chars`` brought up to date."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests, a row for each document of the mix."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: Classifier, fingerprints and encoding are beyond SQL; tests hold them against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    from varloom.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{k}")
    return docs
