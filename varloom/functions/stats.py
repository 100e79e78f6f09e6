"""Per-site statistics over the subjects of long call tables.

One partial aggregate and at most one shuffle on the site's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles, codec

SITE = ["vid", "cidx", "chrom", "pos", "ploidy", "ref", "alt"]


def alternatives(ploidy: Column, a0: Column, a1: Column) -> Column:
    """Non-reference alleles of a cell; a haploid cell counts once."""
    return F.when(a0.isNull(), 0).when(ploidy == 1, (a0 > 0).cast("int")).otherwise((a0 > 0).cast("int") + (a1 > 0).cast("int"))


def ac() -> Column:
    return F.sum(alternatives(F.col("ploidy"), F.col("a0"), F.col("a1"))).cast("long")


def an() -> Column:
    return F.sum(F.when(F.col("a0").isNotNull(), F.col("ploidy")).otherwise(0)).cast("long")


def frequency(ac_: Column, an_: Column) -> Column:
    """0 where nothing was called."""
    return F.when(an_ == 0, F.lit(0.0)).otherwise(ac_ / F.nullif(an_, F.lit(0)))


def site_stats(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """``ac``, ``an``, ``af``, ``missing`` and ``subjects`` of each site."""
    out = calls.groupBy(*keys).agg(ac().alias("ac"), an().alias("an"), F.count_if(F.col("a0").isNull()).alias("missing"), F.count("*").alias("subjects"))
    return out.withColumn("af", frequency(F.col("ac"), F.col("an")))


def allele_counts(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """A row for each allele of a site, the unused ones too: ``allele``, ``n``, ``an``."""
    used = calls.groupBy(*keys).agg(
        an().alias("an"),
        *(F.sum(F.when(F.col("a0").isNull(), 0).when(F.col("ploidy") == 1, (F.col("a0") == k).cast("int")).otherwise((F.col("a0") == k).cast("int") + (F.col("a1") == k).cast("int"))).cast("long").alias(f"_n{k}") for k in range(codec.MOST_ALLELES)),
    )
    counts = F.slice(F.array(*(F.col(f"_n{k}") for k in range(codec.MOST_ALLELES))), F.lit(1), alleles.count(F.col("alt")))
    return used.select(*keys, "an", F.posexplode(counts).alias("allele", "n"))


def minor_frequency(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """Two alleles: the smaller of af and 1 - af.  More: the second largest share."""
    per = allele_counts(calls, keys).groupBy(*keys, "an").agg(F.array_sort(F.collect_list("n")).alias("ns"), F.sum(F.when(F.col("allele") > 0, F.col("n")).otherwise(0)).alias("ac"))
    af = frequency(F.col("ac"), F.col("an"))
    second = F.element_at(F.col("ns"), -2)
    return per.select(*keys, F.when(F.size("ns") == 2, F.least(af, 1 - af)).otherwise(frequency(second, F.col("an"))).alias("maf"))


def genotype_counts(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    return calls.withColumn("code", codec.encode(F.col("a0"), F.col("a1"))).groupBy(*keys, "code").agg(F.count("*").alias("n"))


def to_wide(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """One row a site, ``gt`` with a code for each subject in order of ``sid``."""
    # A cell travels as one number, subject and code, so that sorting needs no comparisons of structs.
    cell = F.shiftleft(F.col("sid").cast("long"), 8).bitwiseOR(codec.encode(F.col("a0"), F.col("a1")).cast("long"))
    packed = calls.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    sid = calls.schema["sid"].dataType
    return packed.select(*keys, F.transform("cells", lambda c: F.shiftright(c, 8).cast(sid)).alias("sids"), F.transform("cells", lambda c: c.bitwiseAND(255).cast("smallint")).alias("gt"))


def to_long(wide: DataFrame, keys: list[str] = SITE) -> DataFrame:
    # An inner explode would add a filter on the array's size, and so work out the cells twice.
    cell = F.explode_outer(F.arrays_zip("sids", "gt")).alias("c")
    out = wide.select(*keys, cell).where(F.col("c").isNotNull()).select(*keys, F.col("c.sids").alias("sid"), codec.decode(F.col("c.gt").cast("int")).alias("g"))
    return out.select(*keys, "sid", "g.a0", "g.a1")


def wide(table: DataFrame) -> DataFrame:
    """Wide rows of a table in either layout; stored ones are taken as they are."""
    return table.select(*SITE, "sids", "gt") if "gt" in table.columns else to_wide(table)


def subjects(table: DataFrame, name: str = "sids") -> DataFrame:
    """One row: a table's subjects, rising.  Cells are not gathered for it."""
    listed = F.max("sids") if "gt" in table.columns else F.sort_array(F.collect_set("sid"))
    return table.agg(listed.alias(name))


def _alternatives_by_code(ploidy: int) -> Column:
    """What each code adds to AC, from the rule of the codes."""
    out = [0] * (codec.MOST_ALLELES**2 + 1)
    for i in range(codec.MOST_ALLELES):
        for j in range(codec.MOST_ALLELES):
            code = (i + 1) ** 2 - j if i >= j else j**2 + i + 1
            out[code] = int(i > 0) if ploidy == 1 else int(i > 0) + int(j > 0)
    return F.array(*map(F.lit, out))


def wide_ac(gt: Column, ploidy: Column) -> Column:
    """AC of a wide row, without a shuffle: a look-up for each cell."""
    total = lambda n: F.aggregate(gt, F.lit(0).cast("long"), lambda acc, c: acc + F.get(_alternatives_by_code(n), c.cast("int")))
    return F.when(ploidy == 1, total(1)).otherwise(total(2))


def wide_an(gt: Column, ploidy: Column) -> Column:
    return (F.size(F.filter(gt, lambda c: c != 0)) * ploidy).cast("long")
