"""Strand errors between two tables: checkers, and the relabelling they decide.

A checker says whether two sites agree, from their REF and ALT counts.  Its
``reverse`` form is asked with side 2's counts exchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import codec
from varloom.functions.alleles import complement
from varloom.operators import ld


def critical_value(alpha: float) -> float:
    """Chi-square with one degree of freedom: P(X > value) = alpha, by bisection of the
    complementary error function."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > alpha else (low, mid)
    return round(low, 9)


@dataclass(frozen=True)
class Counts:
    """REF and ALT counts of both sides."""

    ref1: Column
    alt1: Column
    ref2: Column
    alt2: Column

    def turned(self) -> Counts:
        return Counts(self.ref1, self.alt1, self.alt2, self.ref2)


def minor(ref: Column, alt: Column) -> Column:
    return F.least(ref, alt) / F.nullif(ref + alt, F.lit(0))


class Checker:
    def equal(self, c: Counts, reverse: bool = False) -> Column:
        """Null means no."""
        raise NotImplementedError

    def __or__(self, other: Checker) -> Checker:
        return Either(self, other)


@dataclass(frozen=True)
class Either(Checker):
    one: Checker
    two: Checker

    def equal(self, c: Counts, reverse: bool = False) -> Column:
        return F.coalesce(self.one.equal(c, reverse), F.lit(False)) | F.coalesce(self.two.equal(c, reverse), F.lit(False))


def chi_square(c: Counts) -> Column:
    """With Yates' correction where a cell is below 5 or all are below 40."""
    n = (c.ref1 + c.alt1 + c.ref2 + c.alt2).cast("double")
    x = (c.ref1 * c.alt2 - c.alt1 * c.ref2).cast("double")
    small = (n < 40) | (F.least(c.ref1, c.alt1, c.ref2, c.alt2) < 5)
    x = F.when(small, F.abs(x) - n / 2).otherwise(x)
    den = (c.ref1 + c.alt1).cast("double") * (c.ref1 + c.ref2) * (c.alt1 + c.alt2) * (c.ref2 + c.alt2)
    return n * x * x / F.nullif(den, F.lit(0.0))


@dataclass(frozen=True)
class ChiSquare(Checker):
    """Rare variants whose counts do not differ beyond chance."""

    maf: float = 0.05
    alpha: float = 0.05

    def equal(self, c: Counts, reverse: bool = False) -> Column:
        return (minor(c.ref1, c.alt1) <= self.maf) & (minor(c.ref2, c.alt2) <= self.maf) & (chi_square(c) < critical_value(self.alpha))


@dataclass(frozen=True)
class FrequencyGap(Checker):
    """Rare variants whose frequencies lie close together."""

    maf: float = 0.05
    gap: float = 0.05

    def equal(self, c: Counts, reverse: bool = False) -> Column:
        f1, f2 = c.alt1 / F.nullif(c.ref1 + c.alt1, F.lit(0)), c.alt2 / F.nullif(c.ref2 + c.alt2, F.lit(0))
        return (minor(c.ref1, c.alt1) <= self.maf) & (minor(c.ref2, c.alt2) <= self.maf) & (F.abs(f1 - f2) < self.gap)


@dataclass(frozen=True)
class LinkSigns(Checker):
    """Common variants whose links to neighbours have the same signs in both tables.
    ``agree`` and ``kept`` name columns that :func:`link_signs` gives, over neighbours
    within ``window`` whose r reaches ``min_r`` on both sides."""

    maf: float = 0.05
    alpha: float = 0.8
    window: int = 10_000
    min_r: float = 0.8
    agree: str = "agree"
    kept: str = "kept"

    def equal(self, c: Counts, reverse: bool = False) -> Column:
        same = F.col(self.kept) - F.col(self.agree) if reverse else F.col(self.agree)
        common = (minor(c.ref1, c.alt1) > self.maf) & (minor(c.ref2, c.alt2) > self.maf)
        return common & (F.col(self.kept) > 0) & (same >= self.alpha * F.col(self.kept))


def strongest(calls: DataFrame, window: int) -> DataFrame:
    """For each site and each other coordinate within the window, r of largest size."""
    sites = ld.planes(calls, 0.0)
    forward = ld.genotype(ld.neighbours(sites, sites, window)).select("chrom1", "vid1", "pos2", "vid2", "pos1", "r")
    every = forward.select(F.col("vid1").alias("vid"), F.col("chrom1").alias("chrom"), F.col("pos2").alias("pos"), F.col("vid2").alias("other"), "r").unionByName(
        forward.select(F.col("vid2").alias("vid"), F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), F.col("vid1").alias("other"), "r")
    )
    best = F.max_by("r", F.struct(F.round(F.abs("r"), 9), -F.col("other")))
    return every.groupBy("vid", "chrom", "pos").agg(best.alias("r"))


def link_signs(a: DataFrame, b: DataFrame, pairs: DataFrame, window: int = 10_000, min_r: float = 0.8) -> DataFrame:
    """``pairs`` (vid1, vid2) with ``kept``, the neighbours strongly linked in both
    tables, and ``agree``, those of them whose sign is the same."""
    one = strongest(a, window).select(F.col("vid").alias("vid1"), "chrom", "pos", F.col("r").alias("r1"))
    two = strongest(b, window).select(F.col("vid").alias("vid2"), "chrom", "pos", F.col("r").alias("r2"))
    strong = lambda c: F.round(F.abs(c), 9) >= min_r
    both = pairs.select("vid1", "vid2").join(one, "vid1").join(two, ["vid2", "chrom", "pos"]).where(strong("r1") & strong("r2"))
    counts = both.groupBy("vid1", "vid2").agg(F.count("*").alias("kept"), F.count_if(F.col("r1") * F.col("r2") > 0).alias("agree"))
    return pairs.join(counts, ["vid1", "vid2"], "left").fillna(0, ["kept", "agree"])


def checker(no_ld: bool = False, freq_gap: bool = False, maf: float = 0.05, alpha: float = 0.05, gap: float = 0.05, agreeing: float = 0.8, window: int = 10_000, min_r: float = 0.8) -> Checker:
    """The four choices of checker, with their limits."""
    rare: Checker = FrequencyGap(maf, gap) if freq_gap else ChiSquare(maf, alpha)
    return rare if no_ld else rare | LinkSigns(maf, agreeing, window, min_r)


def links_in(check: Checker) -> LinkSigns | None:
    """The part of a checker that asks for links, which must be counted first."""
    if isinstance(check, Either):
        return links_in(check.one) or links_in(check.two)
    return check if isinstance(check, LinkSigns) else None


def relabelled(ref1: Column, alt1: Column, ref2: Column, alt2: Column, c: Counts, check: Checker) -> Column:
    """Labels of two sites of one coordinate once strand errors are undone: struct ``alt1``,
    ``ref2``, ``alt2``.  Codes never change, only names do; the first rule that holds
    decides.  A side whose ALT nobody carries takes its ALT's name from the other side.
    Where a side has several alternatives, all names of side 2 are complemented or none;
    counts then are of the reference and of all alternatives together."""
    eq = F.coalesce(check.equal(c, False), F.lit(False))
    eqr = F.coalesce(check.equal(c.turned(), True), F.lit(False))
    facts = F.struct(ref1.alias("ref1"), alt1.alias("alt1"), ref2.alias("ref2"), alt2.alias("alt2"), eq.alias("eq"), eqr.alias("eqr"), (c.alt1 == 0).alias("none1"), (c.alt2 == 0).alias("none2"))
    return codec.bound(facts, lambda f: _decided(*(f[k] for k in ("ref1", "alt1", "ref2", "alt2", "eq", "eqr", "none1", "none2"))))


def _decided(ref1: Column, alt1: Column, ref2: Column, alt2: Column, eq: Column, eqr: Column, none1: Column, none2: Column) -> Column:
    comp = complement
    out = lambda a1, r2, a2: F.struct(a1.alias("alt1"), r2.alias("ref2"), a2.alias("alt2"))
    neither = F.when(ref1 == ref2, out(alt1, ref2, alt1)).when(ref1 == comp(ref2), out(alt1, ref1, alt1)).otherwise(out(ref2, ref2, ref1))
    only1 = (
        F.when((ref1 == ref2) & (ref1 == comp(alt2)) & eqr, out(alt2, alt2, ref1))
        .when(ref1 == ref2, out(alt2, ref2, alt2))
        .when((ref1 == alt2) & (ref1 == comp(ref2)) & eq, out(ref2, ref1, ref2))
        .when(ref1 == alt2, out(ref2, ref2, alt2))
        .when((ref1 == comp(ref2)) & eq, out(comp(alt2), ref1, comp(alt2)))
        .when((ref1 == comp(alt2)) & eqr, out(comp(ref2), comp(ref2), ref1))
        .otherwise(out(ref2, ref2, alt2))
    )
    only2 = (
        F.when((ref2 == ref1) & (ref2 == comp(alt1)) & eqr, out(alt1, alt1, ref1))
        .when(ref2 == ref1, out(alt1, ref2, alt1))
        .when((ref2 == alt1) & (ref2 == comp(ref1)) & eq, out(alt1, ref1, alt1))
        .when(ref2 == alt1, out(alt1, ref2, ref1))
        .when((ref2 == comp(ref1)) & eq, out(alt1, ref1, alt1))
        .when((ref2 == comp(alt1)) & eqr, out(alt1, alt1, ref1))
        .otherwise(out(alt1, ref2, ref1))
    )
    pair = F.when((ref1 == comp(ref2)) & (alt1 == comp(alt2)) & eq, out(alt1, ref1, alt1)).when((ref1 == comp(alt2)) & (alt1 == comp(ref2)) & eqr, out(alt1, alt1, ref1)).otherwise(out(alt1, ref2, alt2))
    two1, two2 = ~alt1.contains(","), ~alt2.contains(",")
    opposite = ref1 == comp(ref2)
    crossed = F.when(two1, alt1 == comp(ref2)).when(two2, alt2 == comp(ref1)).otherwise(F.lit(False))
    many = F.when((opposite & eq) | (~opposite & crossed & eqr), out(alt1, comp(ref2), comp(alt2))).otherwise(out(alt1, ref2, alt2))
    return F.when(none1 & none2, neither).when(none1, only1).when(none2, only2).when(two1 & two2, pair).otherwise(many)
