"""Row selection: contigs, ranges, points and blocks.  Contigs, ranges and block numbers
reach the scan as pushed filters and partition pruning; lists of points and blocks are
semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chroms(df: DataFrame, names: list[str], known: list[str] | None = None) -> DataFrame:
    """Rows of the named contigs; a name that ``known`` lacks is an error."""
    if known is not None and (unknown := sorted(set(names) - set(known))):
        raise ValueError(f"unknown contigs: {', '.join(unknown)}")
    return df.where(F.col("chrom").isin(list(names)))


def between(df: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends inclusive; an open end is None."""
    out = df.where(F.col("chrom") == chrom)
    if start is not None:
        out = out.where(F.col("pos") >= start)
    return out if end is None else out.where(F.col("pos") <= end)


def points(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at the coordinates (chrom, pos) of ``wanted``."""
    return df.join(wanted.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def blocks(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the blocks (chrom, block_id) of ``chosen``; a null id means the whole contig."""
    whole = chosen.where("block_id IS NULL").select("chrom").distinct()
    some = chosen.where("block_id IS NOT NULL").select("chrom", "block_id").distinct()
    in_whole = df.join(whole, "chrom", "left_semi")
    return in_whole.unionByName(df.join(whole, "chrom", "left_anti").join(some, ["chrom", "block_id"], "left_semi"))


def node_range(df: DataFrame, chrom: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows of a contig's blocks from ``start`` on, ``end`` exclusive."""
    out = df.where((F.col("chrom") == chrom) & (F.col("block_id") >= start))
    return out if end is None else out.where(F.col("block_id") < end)


def without_blocks(df: DataFrame, dropped: DataFrame) -> DataFrame:
    whole = dropped.where("block_id IS NULL").select("chrom").distinct()
    some = dropped.where("block_id IS NOT NULL").select("chrom", "block_id").distinct()
    return df.join(whole, "chrom", "left_anti").join(some, ["chrom", "block_id"], "left_anti")


def seek(df: DataFrame, cidx: int, pos: int) -> DataFrame:
    """Everything from the first site at or after a coordinate; past a contig's end the
    next contig follows."""
    return df.where((F.col("cidx") > cidx) | ((F.col("cidx") == cidx) & (F.col("pos") >= pos)))


def _place() -> list[Column]:
    """Reading order: contig, position, two-allele sites first, allele text length."""
    return [F.col("cidx"), F.col("pos"), F.size(F.split("alt", ",")) > 1, F.length("ref") + 1 + F.length("alt"), F.col("vid")]


def ordered(df: DataFrame) -> DataFrame:
    """Rows in reading order."""
    return df.orderBy(*_place())


def tell(df: DataFrame) -> tuple | None:
    """Where a reader of ``df`` stands when it has read all its rows; None for no rows."""
    last = df.agg(F.max(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_place())))).alias("at")).first().at
    return None if last is None else tuple(last)


def resume(df: DataFrame, pointer: tuple | None) -> DataFrame:
    """What follows a place that :func:`tell` gave; all rows from the start (None).  The
    contig and position reach the scan as filters."""
    if pointer is None:
        return df
    cidx, pos, *_ = pointer
    here = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_place())))
    there = F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(pointer)))
    return seek(df, cidx, pos).where(here > there)


def skip(df: DataFrame, n: int) -> DataFrame:
    return ordered(df).offset(n)


def at_coordinates(df: DataFrame) -> DataFrame:
    """A row for each coordinate with the sites that share it, in order."""
    site = F.struct("vid", "ref", "alt")
    return df.groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(site)).alias("sites"))


def subjects(calls: DataFrame, sids: list[int]) -> DataFrame:
    return calls.where(F.col("sid").isin(list(dict.fromkeys(sids))))


def subjects_wide(wide: DataFrame, sids: list[int]) -> DataFrame:
    """Wide rows of some subjects in the order given, once each; an unknown one is an error."""
    chosen = list(dict.fromkeys(sids))
    kind = wide.schema["sids"].dataType.elementType
    at = F.transform(F.array(*(F.lit(s).cast(kind) for s in chosen)), lambda s: F.array_position("sids", s).cast("int"))
    known = F.when(F.array_contains(at, 0), F.raise_error(F.lit("unknown subject"))).otherwise(at)
    rows = wide.withColumn("_at", known)
    moved = lambda c: F.transform("_at", lambda i: F.get(c, i - 1))
    return rows.withColumns({"sids": moved("sids"), "gt": moved("gt")}).drop("_at")


def resolve(names: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Names to a dimension's rows; an unknown name fails the query when it runs."""
    joined = names.join(dimension.withColumn("_known", F.lit(True)), on, "left")
    return joined.where(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown name: "), F.col(on)))).otherwise(F.lit(True))).drop("_known")
