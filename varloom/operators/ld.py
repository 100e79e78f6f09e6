"""Linkage disequilibrium of neighbouring sites.

Each site is one row with bit planes over its subjects, made by row from wide tables and
by an aggregate that shuffles 64 subjects a word from long ones.  Pairs come from an
equi-join on (contig, bin of the window's width) with the right side in its own bin and
the one before, so there is no cartesian product.  Sums are popcounts of ANDs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64  # subjects in a word of a plane


@dataclass(frozen=True)
class Options:
    window: int = 10_000
    maf: float = 0.05
    min_r2: float = 0.2


def _planes_of(wide: DataFrame) -> DataFrame:
    """Bit planes of wide rows, without a shuffle."""

    def plane(bit: Callable[[Column], Column]) -> Column:
        words = F.sequence(F.lit(0), F.ceil(F.size("gt") / WORD).cast("int") - 1)
        word = lambda w: F.aggregate(F.transform(F.slice("gt", w * WORD + 1, F.lit(WORD)), lambda c, k: F.when(bit(c.cast("int")), _one(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v))
        return F.transform(words, word)

    right, left = lambda c: (c == 2) | (c == 3), lambda c: (c == 4) | (c == 3)  # noqa: E731  0|1, 1|1; 1|0, 1|1
    return wide.select("vid", "chrom", "pos", "ploidy", plane(lambda c: c != 0).alias("valid"), plane(left).alias("x"), plane(right).alias("y"))


def _one(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _planes_by_cell(calls: DataFrame) -> DataFrame:
    """Bit planes of long rows: words by subject, OR-ed by a partial aggregate, so what is
    shuffled is a word for ``WORD`` subjects.  All sites of a table have all its subjects,
    so words of the same place are of the same subjects."""
    word, bit = F.floor(F.col("sid") / WORD).cast("long").alias("w"), _one(F.pmod(F.col("sid"), F.lit(WORD)))
    held = lambda has: F.bit_or(F.when(has, bit).otherwise(F.lit(0).cast("long")))
    keys = ["vid", "chrom", "pos", "ploidy"]
    words = calls.groupBy(*keys, word).agg(held(F.col("a0").isNotNull()).alias("valid"), held(F.col("a0") == 1).alias("x"), held(F.col("a1") == 1).alias("y"))
    rows = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w", "valid", "x", "y"))).alias("ws"))
    return rows.select(*keys, *(F.col(f"ws.{c}").alias(c) for c in ("valid", "x", "y")))


def planes(calls: DataFrame, maf: float) -> DataFrame:
    """Two-allele sites whose both alleles reach ``maf``: ``valid``, and for the left and
    right side the carriers ``x`` and ``y``.  ``calls`` may be long or wide."""
    two = calls.where(~F.col("alt").contains(","))
    out = _planes_of(two) if "gt" in calls.columns else _planes_by_cell(two)
    ones = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, v: acc + F.bit_count(v))
    p = (ones("x") + ones("y")) / F.nullif(2 * ones("valid"), F.lit(0))
    return out.withColumn("p", p).where((F.col("p") >= maf) & (1 - F.col("p") >= maf))


def neighbours(left: DataFrame, right: DataFrame, window: int, names: tuple[str, str] = ("1", "2")) -> DataFrame:
    """Pairs of a contig whose second position is later by ``window`` at most."""
    one = left.select(*(F.col(c).alias(f"{c}{names[0]}") for c in left.columns)).withColumn("_bin", F.floor(F.col(f"pos{names[0]}") / window))
    here = F.floor(F.col(f"pos{names[1]}") / window)
    two = right.select(*(F.col(c).alias(f"{c}{names[1]}") for c in right.columns)).withColumn("_bin", F.explode(F.array(here, here - 1)))
    joined = one.join(two, (F.col(f"chrom{names[0]}") == F.col(f"chrom{names[1]}")) & (one["_bin"] == two["_bin"]))
    return joined.where((F.col(f"pos{names[0]}") < F.col(f"pos{names[1]}")) & (F.col(f"pos{names[1]}") - F.col(f"pos{names[0]}") <= window)).drop("_bin")


def _count(*planes_: str) -> Column:
    """Popcount of the AND of planes."""
    first, *rest = (F.col(p) for p in planes_)
    joined = first
    for p in rest:
        joined = F.zip_with(joined, p, lambda a, b: a.bitwiseAND(b))
    return F.aggregate(joined, F.lit(0).cast("long"), lambda acc, v: acc + F.bit_count(v))


def haplotype_sums(pairs: DataFrame) -> DataFrame:
    """``n`` haplotypes called at both sites, carriers ``na``, ``nb`` and both ``nab``."""
    return pairs.withColumns({
        "n": 2 * _count("valid1", "valid2"),
        "na": _count("x1", "valid2") + _count("y1", "valid2"),
        "nb": _count("x2", "valid1") + _count("y2", "valid1"),
        "nab": _count("x1", "x2") + _count("y1", "y2"),
    })


def haplotype(pairs: DataFrame, min_r2: float = 0.0) -> DataFrame:
    """D, D' and r2 over haplotypes; pairs with a fixed site or r2 below the limit go."""
    s = haplotype_sums(pairs)
    n = F.col("n").cast("double")
    s = s.where("n > 0").withColumns({"pa": F.col("na") / n, "pb": F.col("nb") / n, "pab": F.col("nab") / n})
    s = s.where("na > 0 AND nb > 0 AND na < n AND nb < n").withColumns({"qa": 1 - F.col("pa"), "qb": 1 - F.col("pb"), "d": F.col("pab") - F.col("pa") * F.col("pb")})
    s = s.withColumn("r2", F.col("d") * F.col("d") / (F.col("pa") * F.col("pb") * F.col("qa") * F.col("qb"))).where(F.col("r2") >= min_r2)
    limit = F.when(F.col("d") >= 0, F.least(F.col("qa") * F.col("pb"), F.col("pa") * F.col("qb"))).otherwise(F.least(F.col("qa") * F.col("qb"), F.col("pa") * F.col("pb")))
    n_chr = F.when(F.col("ploidy1") == 1, F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    return s.select("chrom1", "vid1", "vid2", "pos1", "pos2", n_chr.cast("long").alias("n_chr"), "d", (F.col("d") / limit).alias("d_prime"), "r2", (F.col("d") / F.sqrt(F.col("pa") * F.col("pb") * F.col("qa") * F.col("qb"))).alias("r"))


def genotype_sums(pairs: DataFrame) -> DataFrame:
    """Over subjects called at both sites, with dosages a and b of 0 to 2."""
    both = lambda k, o: _count(f"x{k}", f"y{k}", f"valid{o}")
    return pairs.withColumns({
        "n": _count("valid1", "valid2"),
        "sa": _count("x1", "valid2") + _count("y1", "valid2"),
        "sb": _count("x2", "valid1") + _count("y2", "valid1"),
        "sab": _count("x1", "x2") + _count("x1", "y2") + _count("y1", "x2") + _count("y1", "y2"),
        "_aa": both(1, 2), "_bb": both(2, 1),
    }).withColumns({"saa": F.col("sa") + 2 * F.col("_aa"), "sbb": F.col("sb") + 2 * F.col("_bb")})


def genotype(pairs: DataFrame, min_r2: float = 0.0) -> DataFrame:
    """Squared correlation of dosages, and r with its sign."""
    s = genotype_sums(pairs).where("n > 0")
    n = F.col("n").cast("double")
    num = F.col("sab") - F.col("sa") * F.col("sb") / n
    den = (F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n)
    s = s.withColumn("_num", num).withColumn("_den", den).where("_den > 0")
    s = s.withColumn("r2", F.col("_num") * F.col("_num") / F.col("_den")).where(F.col("r2") >= min_r2)
    return s.select("chrom1", "vid1", "vid2", "pos1", "pos2", F.col("n").alias("n_indv"), "r2", (F.col("_num") / F.sqrt("_den")).alias("r"))


#: The built-in models; any function of (pairs, min_r2) can stand beside them.
MODELS = {"haplotype": haplotype, "genotype": genotype}


def pairwise(calls: DataFrame, model: str | Callable[[DataFrame, float], DataFrame] | None = None, options: Options = Options(), phased: bool = True) -> DataFrame:
    """LD of all pairs of sites within the window; without a model by haplotypes where calls
    are phased, else by genotypes."""
    model = model or ("haplotype" if phased else "genotype")
    if isinstance(model, str) and model not in MODELS:
        raise ValueError(f"no such model: {model}")
    if options.window < 1 or not 0 <= options.maf <= 0.5 or not 0 <= options.min_r2 <= 1:
        raise ValueError("options out of range")
    f = MODELS[model] if isinstance(model, str) else model
    sites = planes(calls, options.maf)
    return f(neighbours(sites, sites, options.window), options.min_r2)


def write(pairs: DataFrame, path: str, compressed: bool = True) -> None:
    """Pairs as comma-separated files with a header, by contig and place."""
    ordered = pairs.orderBy("chrom1", "pos1", "vid1", "pos2", "vid2")
    ordered.write.option("header", True).option("compression", "gzip" if compressed else "none").csv(path)
