"""Small side inputs: contig files, subject lists, position lists, synthetic names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """``chrom,ploidy,length`` lines after ``#`` lines; ploidy is 2 where it is missing."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path).select("value", order.alias("_o")).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", ",").alias("f"), "_o")
    number = lambda i, other: F.coalesce(F.expr(f"try_cast(trim(get(f, {i})) AS BIGINT)"), F.lit(other))
    cidx = F.row_number().over(Window.partitionBy().orderBy("_o")) - 1  # a genome's contigs are few
    return rows.select(F.trim(F.col("f")[0]).alias("chrom"), number(1, 2).cast("int").alias("ploidy"), number(2, 0).alias("length"), cidx.alias("cidx"))


def subject_list(spark: SparkSession, path: str, separator: str = "[,\t\n]") -> DataFrame:
    words = spark.read.text(path).select(F.explode(F.split("value", separator)).alias("name"))
    return words.select(F.trim("name").alias("name")).where("name <> ''").distinct()


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``chrom`` and ``pos`` by comma, blank or tab, once each."""
    pattern = r"^\s*([^,\s]+)[,\s]+([0-9]+)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("chrom"), F.regexp_extract("value", pattern, 2).cast("long").alias("pos")).distinct()


def synthetic_subjects(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("sid"), F.concat(F.lit("S"), F.col("id")).alias("name"))


def block_selector(text: str) -> list[tuple[str, int | None]]:
    """``chrom=a,b;node=0,2`` as (chrom, block) pairs; no nodes means whole contigs."""
    given = dict(part.split("=", 1) for part in text.split(";") if part)
    if set(given) - {"chrom", "node"} or "chrom" not in given:
        raise ValueError(f"not a block selector: {text}")
    nodes: list[int | None] = [int(x) for x in given["node"].split(",")] if given.get("node") else [None]
    return [(c, n) for c in given["chrom"].split(",") for n in nodes]
