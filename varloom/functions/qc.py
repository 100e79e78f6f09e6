"""Quality predicates: Columns that are true for what is kept.

An explicit threshold wins over a default.  ``tighten`` combines two ranges into
their intersection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles, stats


def ac_between(low: int = 0, high: int = 2**31 - 1) -> Column:
    return F.col("ac").between(low, high)


def af_between(low: float = 0.0, high: float = 1.0) -> Column:
    """By products, so a site without calls passes."""
    return (F.col("ac") >= F.col("an") * low) & (F.col("ac") <= F.col("an") * high)


def an_between(low: int = 0, high: int = 2**31 - 1) -> Column:
    return F.col("an").between(low, high)


def tighten(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    return max(a[0], b[0]), min(a[1], b[1])


def genotypes(calls: DataFrame, gq: int = 20, dp: int = 4) -> DataFrame:
    """Cells below the thresholds become missing and rows stay; a cell whose format is
    GT alone is not judged, an absent value counts as 0."""
    bad = (F.col("format") != "GT") & ((F.coalesce("gq", F.lit(0)) < gq) | (F.coalesce("dp", F.lit(0)) < dp))
    return calls.withColumns({c: F.when(~bad, F.col(c)) for c in ("a0", "a1")})


def info_value(info: Column, key: str) -> Column:
    """A numeric INFO field cut to its whole part; null where absent or ".", -2 where
    negative."""
    raw = F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1)
    number = F.when(raw.rlike(r"^-?[0-9]+([.][0-9]*)?([eE][-+]?[0-9]+)?$"), raw.cast("double"))
    return F.when(number < 0, F.lit(-2)).otherwise(F.floor(number))


def qual_at_least(least: int = 30) -> Column:
    number = F.when(F.col("qual") != ".", F.col("qual").cast("double"))
    return number.isNull() | (F.floor(number) >= least)


def info_at_least(key: str, least: int) -> Column:
    value = info_value(F.col("info"), key)
    return value.isNull() | (value >= least)


def alleles_at_most(most: int = 15) -> Column:
    return alleles.count(F.col("alt")) <= most


def variants(df: DataFrame, qual: int = 30, dp: int = 0, mq: int = 20, most_alleles: int = 15, enabled: bool = True) -> DataFrame:
    """Site rules; without quality control only the allele limit holds."""
    keep = alleles_at_most(min(15, most_alleles) if enabled else 15)
    if enabled:
        keep = keep & qual_at_least(qual) & info_at_least("MQ", mq)
        if dp > 0:
            keep = keep & info_at_least("DP", dp)
    return df.where(keep)


def sites(calls: DataFrame, *predicates: Column) -> DataFrame:
    """Sites whose statistics satisfy all predicates (any Column over ac, an, af)."""
    out = stats.site_stats(calls)
    for p in predicates:
        out = out.where(p)
    return out
