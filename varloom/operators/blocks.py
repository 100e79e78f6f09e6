"""Blocks of consecutive sites, their statistics, and edits on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.ranks import numbered

#: Block sizes are 2^7 to 2^14 sites, by the most subjects for each.
LIMITS = {16384: 131071, 8192: 262143, 4096: 524287, 2048: 1048575, 1024: 2097151, 512: 4194303, 256: 8388607, 128: 16777215}


def block_size(subjects: int, wanted: int | None = None) -> int:
    """A block may hold 2^31 cells at most; without a wish it is a quarter of that."""
    if wanted is not None:
        if wanted not in LIMITS or subjects > LIMITS[wanted]:
            raise ValueError(f"no blocks of {wanted} sites for {subjects} subjects")
        return wanted
    return next((size for size, most in LIMITS.items() if subjects <= most // 4), 128)


def form(sites: DataFrame, size: int) -> DataFrame:
    """``block_id``: every ``size`` sites of a contig by position."""
    return numbered(sites, "cidx", "pos", ["vid"], "_row").withColumn("block_id", F.floor(F.col("_row") / size)).drop("_row")


def stats(sites: DataFrame) -> DataFrame:
    many = F.col("alt").contains(",")
    return sites.groupBy("cidx", "chrom", "block_id").agg(F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.count_if(~many).alias("biallelic"), F.count_if(many).alias("multiallelic"))


def by_chrom(block_table: DataFrame) -> DataFrame:
    return block_table.groupBy("chrom").agg(F.min("min_pos").alias("min_pos"), F.max("max_pos").alias("max_pos"), F.count("*").alias("blocks"), F.sum(F.col("biallelic") + F.col("multiallelic")).cast("long").alias("variants"))


def decoded_bytes(block_table: DataFrame, subjects: int) -> DataFrame:
    """The largest block once its cells are unpacked, a byte a cell."""
    return block_table.agg(F.max((F.col("biallelic") + F.col("multiallelic")) * subjects).alias("most_bytes"))


def is_ordered(block_table: DataFrame) -> DataFrame:
    """Per contig, whether each block ends at or before the next one's start."""
    w = Window.partitionBy("chrom").orderBy("block_id")
    return block_table.withColumn("_next", F.lead("min_pos").over(w)).groupBy("chrom").agg(F.bool_and(F.col("_next").isNull() | (F.col("max_pos") <= F.col("_next"))).alias("ordered"))


def unique(block_table: DataFrame) -> DataFrame:
    """Blocks of equal description once."""
    return block_table.dropDuplicates(["chrom", "min_pos", "max_pos", "biallelic", "multiallelic"])


def find(block_table: DataFrame, chrom: str, pos: int) -> DataFrame:
    return block_table.where((F.col("chrom") == chrom) & (F.col("min_pos") <= pos) & (F.col("max_pos") >= pos))


def intersects(block_table: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return block_table.where((F.col("chrom") == chrom) & (F.col("min_pos") <= end) & (F.col("max_pos") >= start))


def concat(*tables: DataFrame) -> DataFrame:
    """Tables of equal columns one after another, repeated sites once."""
    first, *rest = tables
    for t in rest:
        if t.schema != first.schema:
            raise ValueError("tables to concatenate have different columns")
        first = first.unionByName(t)
    return first.dropDuplicates()


def rename_subjects(subjects: DataFrame, names: DataFrame) -> DataFrame:
    """New names by sid: as many as there are subjects, and no name twice."""
    joined = subjects.drop("name").join(names, "sid", "full_outer")
    times = F.count("*").over(Window.partitionBy("name"))
    checked = joined.withColumn("_n", times)
    return checked.where(F.when(F.col("name").isNull() | (F.col("_n") > 1), F.raise_error(F.lit("subject names must be given once for each"))).otherwise(F.lit(True))).select("sid", "name")


def reset_contigs(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contig numbers of another contig table, by name; names it lacks are dropped."""
    new = contigs.select("chrom", F.col("cidx").alias("_cidx"))
    return sites.join(new, "chrom").withColumn("cidx", F.col("_cidx")).drop("_cidx")


def similarity_order(wide: DataFrame, width: int = 8) -> DataFrame:
    """Sites of a block in an order that puts alike genotypes together: two-allele sites
    first by falling, others by rising features.  A feature is the sum of a stretch of
    codes, each weighted by its place from the stretch's end."""
    size = F.size("gt")
    each = F.ceil(size / width).cast("int")
    feature = lambda k: F.aggregate(F.sequence(F.lit(0), each - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.coalesce(F.get("gt", k * each + j), F.lit(0)) * (each - j))
    features = wide.withColumn("_f", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), feature)).withColumn("_many", F.col("alt").contains(","))
    falling = F.transform("_f", lambda v: -v)
    w = Window.partitionBy("cidx", "block_id").orderBy("_many", F.when(F.col("_many"), F.col("_f")).otherwise(falling), "vid")
    return features.withColumn("rank", F.row_number().over(w)).drop("_f", "_many")
