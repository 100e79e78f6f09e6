"""Genotype codes as Column expressions.

A cell is a pair of allele indices (at most fifteen alleles), a code its number:
``(i + 1)^2 - j`` for i >= j, else ``j^2 + i + 1``; 0 is a missing cell.  In long
tables missing is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ALLELES = 15


def encode(i: Column, j: Column) -> Column:
    code = F.when(i >= j, (i + 1) * (i + 1) - j).otherwise(j * j + i + 1)
    return F.when(i.isNull() | j.isNull(), F.lit(0)).otherwise(code).cast("int")


def decode(code: Column) -> Column:
    """Struct ``a0``, ``a1``; both null for a missing cell."""
    m = F.ceil(F.sqrt(code.cast("double"))).cast("int") - 1
    flat = code <= m * m + m
    i = F.when(code == 0, F.lit(None)).when(flat, code - m * m - 1).otherwise(m)
    j = F.when(code == 0, F.lit(None)).when(flat, m).otherwise((m + 1) * (m + 1) - code)
    return F.struct(i.cast("int").alias("a0"), j.cast("int").alias("a1"))


def _numbers(values: list[int]) -> Column:
    # One literal, folded by the optimizer: hundreds of them would slow down every plan.
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def by_code(value: Callable[[int, int], int]) -> Column:
    """``value`` of the alleles of each code, and -1 for a missing cell, as an array.  For the
    cells of wide rows: a look-up costs a fraction of :func:`decode`, which they would interpret."""
    out = [-1] * (MOST_ALLELES**2 + 1)
    for i in range(MOST_ALLELES):
        for j in range(MOST_ALLELES):
            out[(i + 1) ** 2 - j if i >= j else j**2 + i + 1] = value(i, j)
    return _numbers(out)


def sides(code: Column) -> tuple[Column, Column]:
    """The alleles of a wide row's cell by look-up; -1 for a missing one."""
    return F.get(by_code(lambda i, j: i), code.cast("int")), F.get(by_code(lambda i, j: j), code.cast("int"))


def encoded(i: Column, j: Column) -> Column:
    """:func:`encode` by look-up."""
    n = range(MOST_ALLELES)
    codes = _numbers([(a + 1) ** 2 - b if a >= b else b**2 + a + 1 for a in n for b in n])
    return F.coalesce(F.get(codes, i * MOST_ALLELES + j), F.lit(0))


def unphase(a0: Column, a1: Column) -> tuple[Column, Column]:
    missing = a0.isNull() | a1.isNull()
    return F.when(~missing, F.least(a0, a1)), F.when(~missing, F.greatest(a0, a1))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def used(gt: Column) -> Column:
    """The indices of alleles that some cell of a wide row holds, rising."""
    held = F.transform(F.filter(F.array_distinct(gt), lambda c: c != 0), lambda c: F.array(*sides(c)))
    return F.sort_array(F.array_distinct(F.flatten(held)))


def recode(gt: Column, old: Column, new: Column) -> Column:
    """A wide row's codes on another allele list, by a table of all codes of the old one.
    Cells of alleles that ``new`` lacks become missing."""

    def table(at: Column) -> Column:
        def code(c: Column) -> Column:
            i, j = (F.get(at, a) for a in sides(c))
            return F.when((c == 0) | (i < 0) | (j < 0), F.lit(0)).otherwise(encoded(i, j)).cast("smallint")

        return F.transform(F.sequence(F.lit(0), F.size(at) * F.size(at)), code)

    places = F.transform(old, lambda a: (F.array_position(new, a) - 1).cast("int"))
    moved = bound(bound(places, table), lambda t: F.transform(gt, lambda c: F.get(t, c.cast("int"))))
    return F.when(old == new, gt).otherwise(moved)


def carriers(gt: Column, n_alleles: Column, allele: Column) -> Column:
    """A wide row's codes where ``allele`` is 1 and every other allele 0."""
    is_it = lambda a: (a == allele).cast("int")

    def code(c: Column) -> Column:
        g = decode(c)
        return F.when(c == 0, F.lit(0)).otherwise(encode(is_it(g["a0"]), is_it(g["a1"]))).cast("smallint")

    table = F.transform(F.sequence(F.lit(0), n_alleles * n_alleles), code)
    return bound(table, lambda t: F.transform(gt, lambda c: F.get(t, c.cast("int"))))


def swap(code: Column, phased: bool = True) -> Column:
    """The code after REF and ALT of a biallelic site change places."""
    table = [0, 3, 4, 1, 2] if phased else [0, 3, 2, 1]
    return F.get(F.array(*map(F.lit, table)), code)


def text(a0: Column, a1: Column, ploidy: Column, phased: bool = True) -> Column:
    """The cell as variant files write it."""
    mark = "|" if phased else "/"
    return (
        F.when(a0.isNull() & (ploidy == 1), F.lit("."))
        .when(a0.isNull(), F.lit(f".{mark}."))
        .when(ploidy == 1, a0.cast("string"))
        .otherwise(F.concat_ws(mark, a0.cast("string"), a1.cast("string")))
    )


def texts(ploidy: int, phased: bool = True) -> Column:
    """What :func:`text` gives for each code."""
    mark = "|" if phased else "/"
    out = ["." if ploidy == 1 else f".{mark}."] * (MOST_ALLELES**2 + 1)
    for i in range(MOST_ALLELES):
        for j in range(MOST_ALLELES):
            out[(i + 1) ** 2 - j if i >= j else j**2 + i + 1] = str(i) if ploidy == 1 else f"{i}{mark}{j}"
    return F.array(*map(F.lit, out))


def parse(cell: Column) -> Column:
    """Struct ``a0``, ``a1`` from a cell's text; a side that is missing makes the whole
    cell missing, one number stands for both sides."""
    gt = F.substring_index(cell, ":", 1)
    # Codes number alleles 0 to 14; a cell beyond them is missing.
    whole = gt.rlike(r"^0*([0-9]|1[0-4])([/|]0*([0-9]|1[0-4]))?$")
    side = lambda n: F.when(whole, F.substring_index(F.translate(gt, "/", "|"), "|", n).cast("int"))
    return F.struct(side(1).alias("a0"), side(-1).alias("a1"))


def pack_groups(codes: Column, phased: bool = True) -> Column:
    """Biallelic codes packed three (base 5) or four (base 4) to a byte; a short last
    group is filled with its last code."""
    base, each = (5, 3) if phased else (4, 4)

    def packed(held: Column) -> Column:
        size = F.size(held)
        digit = lambda g, k: F.get(held, F.least(g * each + k, size - 1))
        one = lambda g: reduce(lambda acc, k: acc * base + digit(g, k), range(1, each), digit(g, 0))
        return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(size / each).cast("int") - 1), one))

    # Bound, as ``codes`` would be worked out again for each digit.
    return bound(codes, packed)


def unpack_groups(packed: Column, count: Column, phased: bool = True) -> Column:
    base, each = (5, 3) if phased else (4, 4)
    digit = lambda i: F.floor(F.get(packed, F.floor(i / each).cast("int")) / F.pow(F.lit(base), F.lit(each - 1) - i % each)).cast("int") % base
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), digit))


def pack_two_bits(codes: Column, table: list[int]) -> Column:
    """Cells looked up in ``table`` (values 0 to 3), sixteen to a 32-bit word from the
    lowest bits on; the last word is filled with ``table[0]``."""
    lookup = F.array(*(F.lit(x).cast("long") for x in table))

    def packed(values: Column) -> Column:
        size = F.size(values)
        value = lambda i: F.coalesce(F.get(values, i), F.lit(table[0]).cast("long"))
        word = lambda w: reduce(lambda acc, k: acc.bitwiseOR(F.shiftleft(value(w * 16 + k), 2 * k)), range(1, 16), value(w * 16))
        return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(size / 16).cast("int") - 1), word))

    # Bound: each cell is looked up once.
    return bound(F.transform(codes, lambda c: F.get(lookup, c)), packed)
