"""Variant files as a source and a sink of long call tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import alleles, codec, stats

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``value`` and ``arrival`` (which orders lines as the files have them) of every
    line; folders are read through, and only files that look like variant files (plain or
    gzip, which is not split) or like the parts that :func:`write` leaves.  Parts of a
    folder are one file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.vcf*,part-*}")
    path = F.col("_metadata.file_path")
    file = F.regexp_replace(path, "/part-[^/]*$", "")
    arrival = F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return reader.text(paths).select(file.alias("file"), "value", arrival.alias("arrival"))


def headers(text: DataFrame) -> DataFrame:
    """Subjects by file, in file order: ``file``, ``names``."""
    head = text.where(F.col("value").startswith("#CHROM"))
    return head.select("file", F.slice(F.split("value", "\t"), len(FIXED) + 1, 1 << 24).alias("names"))


def contigs(text: DataFrame) -> DataFrame:
    """Contigs that header lines declare."""
    return text.where(F.col("value").startswith("##contig")).select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("chrom"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("value", "length=([0-9]+)", 1), F.lit("")), F.lit("9999999999")), F.lit(0)).cast("long").alias("length")).distinct()


def deep_contigs(sites: DataFrame) -> DataFrame:
    """Contigs in order of appearance (``arrival`` of read lines, else the number of the
    site), two copies each, length unknown."""
    if "arrival" in sites.columns:
        # The least of structs would sort all rows; numbers by stretch of a file do not.
        stretch = sites.groupBy("chrom", F.col("arrival.path").alias("path"), F.col("arrival.block").alias("block")).agg(F.min("arrival.row").alias("row"))
        seen = stretch.groupBy("chrom").agg(F.min(F.struct("path", "block", "row")).alias("first"))
    else:
        seen = sites.groupBy("chrom").agg(F.min("vid").alias("first"))
    return seen.select("chrom", "first", F.lit(2).alias("ploidy"), F.lit(0).cast("long").alias("length"))


def read_sites(spark: SparkSession, paths: str | list[str], known: DataFrame) -> DataFrame:
    """The lines of :func:`read` before their cells are told apart: ``names`` and ``cells``, arrays
    of the same length, in place of what is read from cells.  Lines stay where they are read:
    ``known`` and the lists of subjects, a row a file, are broadcast."""
    text = lines(spark, paths)
    names = headers(text)
    w = F.max(F.struct(F.size("names"), "file", "names"))
    master = names.agg(w.alias("m")).select(F.col("m.names").alias("_master"))  # one row
    checked = names.join(F.broadcast(master), F.lit(True))
    unknown = F.size(F.array_except("names", "_master")) > 0
    checked = checked.where(F.when(unknown, F.raise_error(F.lit("a file has subjects that the largest file lacks"))).otherwise(F.lit(True)))
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("f", F.split("value", "\t"))
    # Where each of the master's subjects stands in the file's list, once a file.
    at = F.when(F.col("names") != F.col("_master"), F.transform("_master", lambda n: F.array_position("names", n).cast("int") - 1))
    joined = body.join(F.broadcast(checked.select("file", "_master", at.alias("at"))), "file")
    chrom = F.regexp_replace(F.col("f")[0], "^chr", "")
    site = joined.select(
        "file", "arrival", "_master", "at", chrom.alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.col("f")[5].alias("qual"), F.col("f")[7].alias("info"), F.get("f", F.lit(8)).alias("format"), F.slice("f", F.lit(10), F.size("_master")).alias("cells"),
    ).join(F.broadcast(known.select("chrom", "cidx", "ploidy")), "chrom")
    # A file with the master's list has its cells in place already.
    placed = F.when(F.col("at").isNull(), F.col("cells")).otherwise(F.transform("at", lambda i: F.when(i >= 0, F.get("cells", i))))
    return site.withColumns({"vid": F.xxhash64("arrival"), "names": F.col("_master"), "cells": placed}).drop("_master", "at")


def read(spark: SparkSession, paths: str | list[str], known: DataFrame) -> DataFrame:
    """Long calls: ``file``, site columns, ``arrival``, ``qual``, ``info``, ``format``, ``sid``, subject
    ``name``, ``a0``, ``a1``, ``gq``, ``dp``.  Rows on contigs that ``known`` (chrom, cidx,
    ploidy) lacks are left out; a ``chr`` prefix goes.

    Subjects of several files are united by name: the file with the most is the master
    and must have all names of the others.  ``sid`` is the place in the master's list, and
    calls of subjects that a file lacks are missing.  Every line is a site of its own.
    """
    # An inner explode would add a filter on the array's size, and so work out the array twice.
    held = F.posexplode_outer(F.arrays_zip("names", "cells")).alias("sid", "c")
    long = read_sites(spark, paths, known).select("*", held).where(F.col("sid").isNotNull())
    keys = F.split("format", ":")
    field = lambda key: F.get(F.split("c.cells", ":"), F.array_position(keys, key).cast("int") - 1)
    number = lambda key: F.when(F.array_position(keys, key) > 0, F.floor(F.when(field(key).rlike(r"^[0-9]+([.][0-9]+)?$"), field(key).cast("double"))).cast("int"))
    return long.select("file", "vid", "cidx", "chrom", "pos", "ploidy", "ref", "alt", "arrival", "qual", "info", "format", "sid", F.col("c.names").alias("name"), codec.parse(F.col("c.cells")).alias("g"), number("GQ").alias("gq"), number("DP").alias("dp")).select("*", "g.a0", "g.a1").drop("g")


def info_field(ac: Column, an: Column) -> Column:
    af = F.when(an == 0, F.lit(".")).otherwise(F.format_string("%.6f", stats.frequency(ac, an)))
    return F.concat(F.lit("AC="), ac.cast("string"), F.lit(";AN="), an.cast("string"), F.lit(";AF="), af)


def site_columns(info: Column | None) -> list[Column]:
    dot = F.lit(".")
    return [F.col("chrom"), F.col("pos").cast("string"), dot, F.col("ref"), F.col("alt"), dot, dot, dot if info is None else info]


def site_lines(calls: DataFrame) -> DataFrame:
    """Lines without sample columns."""
    s = stats.site_stats(calls)
    return s.select("vid", "cidx", "pos", F.concat_ws("\t", *site_columns(info_field(F.col("ac"), F.col("an")))).alias("line"))


def call_lines(calls: DataFrame, phased: bool = True, with_info: bool = True) -> DataFrame:
    """Full lines, samples in order of sid."""
    # A cell travels as one number, as in ``stats.to_wide``, and its text is looked up a row.
    code = codec.encode(F.col("a0"), F.when(F.col("ploidy") == 1, F.col("a0")).otherwise(F.col("a1")))
    cell = F.shiftleft(F.col("sid").cast("long"), 8).bitwiseOR(code.cast("long"))
    s = calls.groupBy(*stats.SITE).agg(stats.ac().alias("ac"), stats.an().alias("an"), F.sort_array(F.collect_list(cell)).alias("cells"))
    info = info_field(F.col("ac"), F.col("an")) if with_info else None
    texts = lambda ploidy: F.transform("cells", lambda c: F.get(codec.texts(ploidy, phased), c.bitwiseAND(255).cast("int")))
    cells = F.array_join(F.when(F.col("ploidy") == 1, texts(1)).otherwise(texts(2)), "\t")
    return s.select("vid", "cidx", "pos", F.concat_ws("\t", *site_columns(info), F.lit("GT"), cells).alias("line"))


def header(reference: str, contig_rows: list[tuple[str, int]], names: list[str], with_calls: bool = True) -> list[str]:
    out = ["##fileformat=VCFv4.2", "##source=varloom", f"##reference={reference}"]
    out += ['##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count">', '##INFO=<ID=AN,Number=1,Type=Integer,Description="Allele number">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">']
    out += [f"##contig=<ID={c},length={n}>" if n else f"##contig=<ID={c}>" for c, n in contig_rows]
    if with_calls:
        out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    return [*out, "#" + "\t".join([*(FIXED if with_calls else FIXED[:8]), *(names if with_calls else [])])]


def write(lines_: DataFrame, path: str, head: list[str], compressed: bool = True) -> None:
    """A folder of part files in coordinate order, the header first."""
    spark = lines_.sparkSession
    # Dealt out first: ordering looks at all lines twice, and would make them twice.
    body = lines_.repartition("cidx", "pos", "vid").orderBy("cidx", "pos", "vid").select("line")
    top = spark.createDataFrame([(h,) for h in head], "line string").coalesce(1)
    top.unionByName(body).write.option("compression", "gzip" if compressed else "none").text(path)
