"""The stored form: Parquet by contig, sorted by position, with properties beside it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import blocks

DATA, SUBJECTS, PROPERTIES = "sites", "subjects", "properties"


@dataclass(frozen=True)
class Properties:
    phased: bool = True
    block_size: int = 16384
    codec: str = "zstd"
    reference: str = ""
    version: int = 1


@dataclass(frozen=True)
class GenotypeTable:
    """A stored table: wide ``sites`` (codes in order of sid), ``subjects`` and properties."""

    sites: DataFrame
    subjects: DataFrame
    properties: Properties

    def calls(self) -> DataFrame:
        return stats.to_long(self.sites)

    def blocks(self) -> DataFrame:
        return blocks.stats(self.sites)

    def describe(self) -> DataFrame:
        return self.sites.agg(F.count_distinct("chrom").alias("chroms"), F.count("*").alias("variants"), F.coalesce(F.max(F.size("gt")), F.lit(0)).alias("subjects"))

    def chroms(self, *names: str) -> GenotypeTable:
        return GenotypeTable(self.sites.where(F.col("chrom").isin(list(names))), self.subjects, self.properties)


def write(calls: DataFrame, subjects: DataFrame, path: str, properties: Properties = Properties(), mode: str = "errorifexists") -> None:
    """Sites by contig and position; row groups then have narrow position ranges, so a
    range reads only the files and groups it meets."""
    spark = calls.sparkSession
    wide = blocks.form(stats.wide(calls), properties.block_size)  # stored rows go in as they are
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = wide.repartitionByRange(parts, "cidx", "pos").sortWithinPartitions("cidx", "pos", "vid")
    ranged.write.mode(mode).option("compression", properties.codec).partitionBy("chrom").parquet(f"{path}/{DATA}")
    subjects.select("sid", "name").write.mode(mode).parquet(f"{path}/{SUBJECTS}")
    spark.createDataFrame([(json.dumps(asdict(properties)),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{PROPERTIES}")


def read(spark: SparkSession, path: str) -> GenotypeTable:
    found = spark.read.text(f"{path}/{PROPERTIES}").collect()  # one line
    if len(found) != 1:
        raise ValueError(f"broken table: {path}")
    sites = spark.read.parquet(f"{path}/{DATA}").withColumn("chrom", F.col("chrom").cast("string"))
    return GenotypeTable(sites, spark.read.parquet(f"{path}/{SUBJECTS}"), Properties(**json.loads(found[0].value)))


def concat(*tables: GenotypeTable) -> GenotypeTable:
    """Tables of the same subjects one after another, repeated sites once.  Subjects (names
    and order), phase and reference must be equal."""
    first, *rest = tables
    for t in rest:
        if (t.properties.phased, t.properties.reference) != (first.properties.phased, first.properties.reference):
            raise ValueError("tables to concatenate differ in phase or reference")
        unlike = first.subjects.select("sid", "name").exceptAll(t.subjects.select("sid", "name")).unionByName(t.subjects.select("sid", "name").exceptAll(first.subjects.select("sid", "name")))
        if not unlike.isEmpty():
            raise ValueError("tables to concatenate have different subjects")
    sites = first.sites
    for t in rest:
        sites = sites.unionByName(t.sites)
    return GenotypeTable(sites.dropDuplicates([c for c in stats.SITE]), first.subjects, first.properties)


def replace(spark: SparkSession, path: str, rewrite) -> None:
    """Rewrite a table in place: the new form is written beside it, then the folders
    change names, so readers never meet a half-written table."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = old.getFileSystem(conf)
    fs.delete(new, True)
    rewrite(read(spark, path), f"{path}.new")
    fs.delete(gone, True)
    if not (fs.rename(old, gone) and fs.rename(new, old)):
        raise OSError(f"could not replace {path}")
    fs.delete(gone, True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.md5("content").alias("md5"))
