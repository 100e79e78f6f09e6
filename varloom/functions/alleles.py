"""Allele lists as Column expressions.  ``alt`` is comma-separated text, "." for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(alt: Column) -> Column:
    """Alleles of a site; a "." counts as one alternative."""
    return F.size(F.split(alt, ",")) + 1


def listed(ref: Column, alt: Column) -> Column:
    return F.concat(F.array(ref), F.split(alt, ","))


def nth(ref: Column, alt: Column, i: Column) -> Column:
    return F.get(listed(ref, alt), i)


def index_of(ref: Column, alt: Column, allele: Column) -> Column:
    """-1 for an allele that the site does not have."""
    return (F.array_position(listed(ref, alt), allele) - 1).cast("int")


def complement(bases: Column) -> Column:
    """Each base's partner, in place (no reversal)."""
    return F.translate(bases, "ACGT", "TGCA")


def alt_text(alts: Column) -> Column:
    return F.when(F.size(alts) == 0, F.lit(".")).otherwise(F.array_join(alts, ","))


def alternatives(new: Column, most: int = 15) -> Column:
    """ALT of an allele list; a list that codes cannot number is an error."""
    return F.when(F.size(new) > most, F.raise_error(F.concat(F.lit("more alleles than a site may have: "), F.array_join(new, ",")))).otherwise(
        alt_text(F.slice(new, F.lit(2), F.greatest(F.size(new) - 1, F.lit(0))))
    )


def rebase(old: Column, new: Column, a: Column) -> Column:
    """An allele's index in the list ``new``, from its index in ``old``; null stays, and
    so does an allele that ``new`` lacks become null."""
    at = F.array_position(new, F.get(old, a))
    return F.when(a.isNotNull() & (at > 0), at - 1).cast("int")
