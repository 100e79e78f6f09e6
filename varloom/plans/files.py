"""Queries that go through files: variant files, stored tables and lists, written to a
folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.operators import ld, select
from varloom.plans.registry import registry
from varloom.sources import lists, table, vcf

QUERIES, ORACLE_SQL, add = registry()
CELL = ["chrom", "pos", "ref", "alt", "name", "a0", "a1"]
NAMED = "SELECT c.chrom, c.pos, c.ref, c.alt, s.name, c.a0, c.a1 FROM calls c JOIN subjects s ON s.sid = c.sid"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def _known(variants: DataFrame) -> DataFrame:
    """Contigs, from the sites: there is no need to make all calls for them."""
    return variants.select("chrom", "cidx", "ploidy").distinct()


def _names(subjects: DataFrame) -> list[str]:
    """A header needs them all; they are a table's width."""
    return [r.name for r in subjects.orderBy("sid").collect()]


def _vcf(c: DataFrame, s: DataFrame, path: str, compressed: bool) -> None:
    vcf.write(vcf.call_lines(c), path, vcf.header("ref", [("1", 1000), ("X", 0)], _names(s)), compressed)


def _back(c, s, v):
    path = folder(c.sparkSession) + "/a.vcf"
    _vcf(c, s, path, True)
    return vcf.read(c.sparkSession, path, _known(v)).select(*CELL)


def _united(c, s, v):
    """Two files in a folder and one below it; the second lacks half of the subjects."""
    path = folder(c.sparkSession)
    _vcf(c.where("vid % 2 = 0"), s, f"{path}/a.vcf", True)
    _vcf(c.where("vid % 2 = 1 AND sid < 30"), s.where("sid < 30"), f"{path}/deeper/b.vcf", False)
    return vcf.read(c.sparkSession, path, _known(v)).select(*CELL)


def _stored(c, s) -> table.GenotypeTable:
    path = folder(c.sparkSession)
    table.write(c, s, path, table.Properties(block_size=128, reference="r"))
    return table.read(c.sparkSession, path)


def _replaced(c, s):
    path = folder(c.sparkSession)
    table.write(c, s, path)
    table.replace(c.sparkSession, path, lambda old, new: table.write(old.sites.where("chrom <> 'X'"), old.subjects, new, old.properties))
    return table.read(c.sparkSession, path).calls().select("vid", "sid", "a0", "a1")


def _text(df: DataFrame, order: list[str], head: list[str]) -> str:
    """A one-column table as one text file."""
    path = folder(df.sparkSession)
    top = df.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    top.unionByName(df.orderBy(*order).select("value").coalesce(1)).coalesce(1).write.text(path)
    return path


def _contigs(v):
    rows = v.select("cidx", "chrom", "ploidy").distinct().withColumn("value", F.concat_ws(",", "chrom", "ploidy", F.col("cidx") * 1000))
    return lists.contigs(v.sparkSession, _text(rows, ["cidx"], ["##reference=x", "#chromosome,ploidy,length"]))


def through_csv(pairs: DataFrame) -> DataFrame:
    path = folder(pairs.sparkSession)
    ld.write(pairs, path)
    return pairs.sparkSession.read.option("header", True).schema(pairs.schema).csv(path)


add("vcf_round_trip", "calls subjects variants", _back, NAMED)
add("vcf_united", "calls subjects variants", _united, NAMED.replace("c.a0, c.a1", "CASE WHEN c.vid % 2 = 0 OR c.sid < 30 THEN c.a0 END AS a0, CASE WHEN c.vid % 2 = 0 OR c.sid < 30 THEN c.a1 END AS a1"))
add("table_round_trip", "calls subjects", lambda c, s: _stored(c, s).calls().select("vid", "chrom", "pos", "sid", "a0", "a1"), "SELECT vid, chrom, pos, sid, a0, a1 FROM calls")
add("table_describe", "calls subjects", lambda c, s: _stored(c, s).describe(), "SELECT count(DISTINCT chrom) AS chroms, count(DISTINCT vid) AS variants, count(DISTINCT sid) AS subjects FROM calls")
add("table_contig", "calls subjects", lambda c, s: _stored(c, s).chroms("7", "X").calls().select("vid", "sid", "a0", "a1"), "SELECT vid, sid, a0, a1 FROM calls WHERE chrom IN ('7', 'X')")
add("table_subjects", "calls subjects", lambda c, s: _stored(c, s).subjects, "SELECT sid, name FROM subjects")
add("table_replace", "calls subjects", _replaced, "SELECT vid, sid, a0, a1 FROM calls WHERE chrom <> 'X'")
add("table_concat", "calls subjects", lambda c, s: table.concat(_stored(c.where("cidx < 9"), s), _stored(c.where("cidx > 6"), s)).calls().select("vid", "sid", "a0", "a1"), "SELECT vid, sid, a0, a1 FROM calls")
add("contig_file", "variants", _contigs, "SELECT DISTINCT chrom, ploidy, CAST(cidx * 1000 AS BIGINT) AS length, cidx FROM variants")
add(
    "subject_file",
    "subjects",
    lambda s: lists.subject_list(s.sparkSession, _text(s.withColumn("value", F.concat(F.col("name"), F.lit(", "), F.col("name"))), ["sid"], [])),
    "SELECT DISTINCT name FROM subjects",
)
add(
    "position_file",
    "variants",
    lambda v: select.points(v, lists.positions(v.sparkSession, _text(v.where("vid % 3 = 0").withColumn("value", F.concat_ws(",", "chrom", "pos")), ["vid"], ["# no"]))).select("vid"),
    "SELECT vid FROM variants WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM variants WHERE vid % 3 = 0)",
)
add("contig_arrival", "calls subjects variants", lambda c, s, v: _arrival(c, s, v), "SELECT chrom, CAST(row_number() OVER (ORDER BY min(cidx)) AS INTEGER) AS place FROM calls GROUP BY chrom")


def _arrival(c, s, v):
    """Contigs in the order in which a written file has them."""
    path = folder(c.sparkSession) + "/a.vcf"
    _vcf(c, s, path, False)
    read = vcf.read_sites(c.sparkSession, path, _known(v))  # cells are not looked at
    return vcf.deep_contigs(read).select("chrom", F.row_number().over(Window.partitionBy().orderBy("first")).alias("place"))
