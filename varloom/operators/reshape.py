"""Sites split into two-allele sites, joined into many-allele ones, and re-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles, codec, stats

SITE = stats.SITE


def _new_list(calls: DataFrame, leading: Column) -> DataFrame:
    """Calls on the list that begins with ``leading`` (an array) and goes on with all other
    alleles in use, in their old order; an empty one keeps the reference.  Wide rows change
    one by one and stay wide."""
    rows = stats.wide(calls).withColumn("_old", alleles.listed(F.col("ref"), F.col("alt"))).withColumn("_leading", leading)
    held = F.transform(codec.used(F.col("gt")), lambda i: F.get(F.col("_old"), i))
    new = F.array_distinct(F.concat("_leading", held))
    rows = rows.withColumn("_new", F.when(F.size(new) == 0, F.array("ref")).otherwise(new))
    moved = rows.withColumns({"gt": codec.recode(F.col("gt"), F.col("_old"), F.col("_new")), "ref": F.col("_new")[0], "alt": alleles.alternatives(F.col("_new"))}).drop("_old", "_new", "_leading")
    return moved if "gt" in calls.columns else stats.to_long(moved)


def simplify(calls: DataFrame, keep_ref: bool = True) -> DataFrame:
    """Alternatives that no cell holds leave the list, and the reference too if it need not
    be kept."""
    return _new_list(calls, F.array("ref") if keep_ref else F.array().cast("array<string>"))


def reset_reference(calls: DataFrame, new_ref: Column, new_alts: Column | None = None) -> DataFrame:
    """Sites on another reference allele and, if given, alternatives (an array); other
    alleles in use follow in their old order."""
    return _new_list(calls, F.array(new_ref) if new_alts is None else F.concat(F.array(new_ref), new_alts))


def split_biallelic(calls: DataFrame) -> DataFrame:
    """A site for each alternative in use (``part`` from 1): its carriers have 1, all other
    alleles 0.  Without one the site keeps ALT "." and no call.  Two-allele sites stay.
    Wide rows split one by one and stay wide; of long tables only many-allele sites are packed."""
    two = ~F.col("alt").contains(",")
    copied = calls.where(two).withColumn("part", F.lit(1))
    rows = stats.wide(calls.where(~two)).withColumn("_old", alleles.listed(F.col("ref"), F.col("alt")))
    rows = rows.withColumn("part", F.explode_outer(F.filter(codec.used(F.col("gt")), lambda i: i > 0)))
    gt = F.when(F.col("part").isNull(), F.transform("gt", lambda c: F.lit(0).cast("smallint"))).otherwise(codec.carriers(F.col("gt"), F.size("_old"), F.col("part")))
    split = rows.withColumns({"gt": gt, "alt": F.coalesce(F.get("_old", F.col("part")), F.lit(".")), "part": F.coalesce("part", F.lit(1))}).drop("_old")
    if "gt" not in calls.columns:
        split = stats.to_long(split, [*SITE, "part"])
        copied = copied.select(*split.columns)
    return copied.select(*split.columns).unionByName(split)


def _fold(x: Column, y: Column) -> Column:
    """Two codes of a subject, phased: each side keeps the first allele that is not the
    reference.  A missing cell gives way to the other."""
    first = (F.when(a > 0, a).otherwise(b) for a, b in zip(codec.sides(x), codec.sides(y)))
    return F.when((x == 0) | (x == 1) & (y != 0), y).when((y == 0) | (y == 1), x).otherwise(codec.encoded(*first))


def _fold_unphased(x: Column, y: Column) -> Column:
    """Unphased: the left, then the right of ``y`` goes to the first side of ``x`` that still
    is the reference.  ``x`` is what :func:`_alone` or this gave: its left is the reference only
    if its right is."""
    free = F.get(codec.by_code(lambda i, j: i if i and not j else -1), x.cast("int"))  # the left, where the right is free
    leading = F.get(codec.by_code(lambda i, j: i or j), y.cast("int"))
    return F.when(y == 0, x).when((x == 0) | (x == 1), _alone(y)).when(free < 0, x).otherwise(codec.encoded(free, leading))


def _alone(code: Column) -> Column:
    """The first cell of an unphased fold: a reference on the left goes to the right."""
    turned = codec.by_code(lambda i, j: (j + 1) ** 2 if i == 0 else (i + 1) ** 2 - j if i >= j else j**2 + i + 1)
    return F.when(code == 0, code).otherwise(F.get(turned, code.cast("int")))


def join_multiallelic(calls: DataFrame, phased: bool = True, most: int = codec.MOST_ALLELES) -> DataFrame:
    """All sites of a coordinate as one: the first site's reference, then the alleles in
    use by reading order.  Per subject the sites' calls are folded in that order.  All sites
    of a table have all its subjects.  What meets by coordinate is wide rows, a few a
    coordinate; wide tables stay wide."""
    coordinate = ["cidx", "chrom", "pos", "ploidy"]
    order = F.struct((F.size(F.split("alt", ",")) > 1).alias("many"), (F.length("ref") + F.length("alt")).alias("length"), F.col("vid"))
    rows = stats.wide(calls).withColumn("old", alleles.listed(F.col("ref"), F.col("alt")))
    site = F.struct(order.alias("o"), "old", F.transform(codec.used(F.col("gt")), lambda i: F.get("old", i)).alias("names"), "gt")
    met = rows.groupBy(*coordinate).agg(F.array_sort(F.collect_list(site)).alias("sites"), F.first("sids").alias("sids"))
    met = met.withColumn("new", F.array_distinct(F.concat(F.array(F.col("sites")[0]["old"][0]), F.flatten("sites.names"))))
    met = met.withColumn("alt", alleles.alternatives(F.col("new"), most)).withColumn("moved", F.transform("sites", lambda s: codec.recode(s["gt"], s["old"], F.col("new"))))
    fold = _fold if phased else _fold_unphased
    first = F.col("moved")[0] if phased else F.transform(F.col("moved")[0], lambda c: _alone(c).cast("smallint"))
    later = F.slice("moved", F.lit(2), F.size("moved"))
    folded = F.when(F.size("moved") == 1, first).otherwise(F.aggregate(later, first, lambda acc, gt: F.zip_with(acc, gt, lambda x, y: fold(x, y).cast("smallint"))))
    out = met.select(F.col("sites")[0]["o"]["vid"].alias("vid"), *coordinate, F.col("new")[0].alias("ref"), "alt", "sids", folded.alias("gt"))
    return out if "gt" in calls.columns else stats.to_long(out)


def unify_subjects(calls: DataFrame, master: DataFrame) -> DataFrame:
    """Calls for every subject of ``master``, missing where a file lacks the subject."""
    sites = calls.select(*SITE).distinct()
    sids = master.agg(F.array_sort(F.collect_set("sid")).alias("_sids"))  # one row; a table's subjects are its width
    grid = sites.join(F.broadcast(sids), F.lit(True)).withColumn("sid", F.explode("_sids")).drop("_sids")
    return grid.join(calls.select("vid", "sid", "a0", "a1"), ["vid", "sid"], "left").select(*SITE, "sid", "a0", "a1")
