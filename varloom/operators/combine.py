"""Tables of different subjects merged by coordinate, and aligned to a template.

All work is on wide rows, one a site: sides meet in one exchange by coordinate, allele
lists are settled by row, and a side's codes move to the new list by a table of codes.
Long tables are packed first, by one aggregate on the site's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import alleles, codec, stats
from varloom.operators import reshape, strand

KEY = ["chrom", "pos"]


def shared_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinates of both tables, once each.  One aggregate, which drops a site's repeats
    before its exchange: no side is joined, so none can be broadcast."""
    sides = a.select(*KEY, F.lit(1).alias("_side")).unionByName(b.select(*KEY, F.lit(2).alias("_side")))
    return sides.groupBy(*KEY).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")).where("_low < _high").select(*KEY)


def match(a: DataFrame, b: DataFrame, how: str = "intersection") -> DataFrame:
    """Pairs of sites (``vid1``, ``vid2``) at equal coordinates; one side may be null.

    Sites whose REF and ALT are equal or swapped pair first, in order; what is left of
    both sides pairs by place, and the rest stays alone.  Under intersection only
    coordinates of both tables stay.
    """
    if how not in ("intersection", "union"):
        raise ValueError(how)
    kind = lambda d: F.array_join(F.array_sort(F.array("ref", "alt")), ">")
    sides = []
    for n, t in ((1, a), (2, b)):
        s = t.select(F.col("vid").alias(f"vid{n}"), *KEY, kind(t).alias("kind")).distinct()
        sides.append(s.withColumn("turn", F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy(f"vid{n}"))))
    one, two = sides
    alike = one.join(two, [*KEY, "kind", "turn"], "full_outer").select(*KEY, "vid1", "vid2")
    alone = alike.where("vid1 IS NULL OR vid2 IS NULL")
    place = lambda n: Window.partitionBy(*KEY).orderBy(f"vid{n}")
    left = alone.where("vid2 IS NULL").select(*KEY, "vid1").withColumn("place", F.row_number().over(place(1)))
    right = alone.where("vid1 IS NULL").select(*KEY, "vid2").withColumn("place", F.row_number().over(place(2)))
    rest = left.join(right, [*KEY, "place"], "full_outer").select(*KEY, "vid1", "vid2")
    pairs = alike.where("vid1 IS NOT NULL AND vid2 IS NOT NULL").unionByName(rest)
    return pairs if how == "union" else pairs.join(shared_positions(a, b), KEY, "left_semi")


def _beside(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """One row for each pair of :func:`match`, from wide rows: structs ``one`` and ``two``
    (null where a side has none).  The sides meet in one exchange by coordinate, which the
    windows and the last aggregate share."""
    if how not in ("intersection", "union"):
        raise ValueError(how)
    sides = [t.select(F.lit(n).alias("side"), *stats.SITE, "gt") for n, t in ((1, a), (2, b))]
    rows = sides[0].unionByName(sides[1]).repartition(*KEY)
    if how == "intersection":
        here = Window.partitionBy(*KEY)
        rows = rows.withColumn("both", F.min("side").over(here) < F.max("side").over(here)).where("both").drop("both")
    rows = rows.withColumn("kind", F.array_join(F.array_sort(F.array("ref", "alt")), ">"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*KEY, "kind", "side").orderBy("vid")))
    rows = rows.withColumn("alike", F.count("*").over(Window.partitionBy(*KEY, "kind", "turn")) == 2)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY, "side", "alike").orderBy("vid")))
    slot = F.when(F.col("alike"), F.concat_ws(":", "kind", "turn")).otherwise(F.concat_ws(":", F.lit(""), "place"))
    site = F.struct(*(c for c in stats.SITE if c not in KEY), "gt")
    held = lambda n: F.first(F.when(F.col("side") == n, site), ignorenulls=True)
    return rows.groupBy(*KEY, slot.alias("slot")).agg(held(1).alias("one"), held(2).alias("two")).drop("slot")


def _checked(pairs: DataFrame, a: DataFrame, b: DataFrame, check: strand.Checker | None) -> DataFrame:
    """``pairs`` with ``alt1``, ``ref2`` and ``alt2``, the labels after strand errors are undone."""
    labels = {"alt1": F.col("one.alt"), "ref2": F.col("two.ref"), "alt2": F.col("two.alt")}
    if check is None:
        return pairs.withColumns(labels)
    links = strand.links_in(check)
    if links is not None:
        ids = pairs.where("one IS NOT NULL AND two IS NOT NULL").select(F.col("one.vid").alias("vid1"), F.col("two.vid").alias("vid2"))
        found = strand.link_signs(a, b, ids, links.window, links.min_r)
        pairs = pairs.join(found, (F.col("one.vid") == F.col("vid1")) & (F.col("two.vid") == F.col("vid2")), "left")
    alts = [stats.wide_ac(F.col(f"{s}.gt"), F.col(f"{s}.ploidy")) for s in ("one", "two")]
    called = [stats.wide_an(F.col(f"{s}.gt"), F.col(f"{s}.ploidy")) for s in ("one", "two")]
    pairs = pairs.withColumns({"ac1": alts[0], "ac2": alts[1], "an1": called[0], "an2": called[1]})
    counts = strand.Counts(F.col("an1") - F.col("ac1"), F.col("ac1"), F.col("an2") - F.col("ac2"), F.col("ac2"))
    new = strand.relabelled(F.col("one.ref"), F.col("one.alt"), F.col("two.ref"), F.col("two.alt"), counts, check)
    both = F.col("one").isNotNull() & F.col("two").isNotNull()
    pairs = pairs.withColumn("labels", F.when(both, new))
    return pairs.withColumns({c: F.coalesce(F.col(f"labels.{c}"), old) for c, old in labels.items()}).drop("labels", "ac1", "ac2", "an1", "an2")


def _used_names(side: str, old: Column) -> Column:
    return F.transform(codec.used(F.col(f"{side}.gt")), lambda i: F.get(old, i))


def merge_wide(a: DataFrame, b: DataFrame, how: str = "intersection", check: strand.Checker | None = None) -> DataFrame:
    """:func:`merge`, giving wide rows."""
    subjects = [stats.subjects(t, f"sids{n}") for n, t in ((1, a), (2, b))]
    a, b = stats.wide(a), stats.wide(b)
    pairs = _checked(_beside(a, b, how), a, b, check)
    old1, old2 = alleles.listed(F.col("one.ref"), F.col("alt1")), alleles.listed(F.col("ref2"), F.col("alt2"))
    pairs = pairs.withColumns({"old1": old1, "old2": old2})
    all_used = F.array_distinct(F.concat(F.array("one.ref"), _used_names("one", F.col("old1")), _used_names("two", F.col("old2"))))
    new = F.when(F.col("one").isNull(), F.col("old2")).when(F.col("two").isNull() | (F.col("old1") == F.col("old2")), F.col("old1")).otherwise(all_used)
    pairs = pairs.withColumn("new", new)
    for t in subjects:  # one row, as wide as a table's subject list
        pairs = pairs.crossJoin(F.broadcast(t))
    gts = [F.when(F.col(s).isNull(), F.array_repeat(F.lit(0).cast("smallint"), F.size(f"sids{n}"))).otherwise(codec.recode(F.col(f"{s}.gt"), F.col(f"old{n}"), F.col("new"))) for n, s in ((1, "one"), (2, "two"))]
    first = lambda c: F.coalesce(F.col(f"one.{c}"), F.col(f"two.{c}")).alias(c)
    return pairs.select(first("vid"), first("cidx"), *KEY, first("ploidy"), F.col("new")[0].alias("ref"), alleles.alternatives(F.col("new")).alias("alt"), F.concat("sids1", "sids2").alias("sids"), F.concat(*gts).alias("gt"))


def merge(a: DataFrame, b: DataFrame, how: str = "intersection", check: strand.Checker | None = None) -> DataFrame:
    """Calls of both tables' subjects on merged sites; a side that lacks the site gives
    missing calls.  ``vid`` is side 1's where it has the site.

    A merged site has side 1's alleles as they are where both sides' are equal, else its
    reference, its used alternatives and the used alleles of side 2.  With a checker the
    labels of a pair are first freed of strand errors (see :func:`strand.relabelled`).
    Tables may be long or wide.
    """
    return stats.to_long(merge_wide(a, b, how, check))


def merge_all(tables: list[tuple[DataFrame, int]], how: str = "intersection", largest_first: bool = False, check: strand.Checker | None = None) -> DataFrame:
    """Several (table, number of subjects), merged by rising or falling size."""
    order = sorted(tables, key=lambda t: t[1], reverse=largest_first)
    return stats.to_long(reduce(lambda x, y: merge_wide(x, y, how, check), [t for t, _ in order]))


def merge_biallelic(a: DataFrame, b: DataFrame, how: str = "intersection", check: strand.Checker | None = None) -> DataFrame:
    split = reshape.split_biallelic(merge_wide(a, b, how, check))
    return stats.to_long(split, [*stats.SITE, "part"])


def align(df: DataFrame, template: DataFrame, how: str = "intersection", check: strand.Checker | None = None) -> DataFrame:
    """Calls of ``df`` on the reference alleles of ``template``.  Sites of the template alone
    never appear; those of ``df`` alone stay under union.  Only the template's sites are
    read, unless a checker asks for its calls."""
    rows = stats.wide(df)
    if check is None:
        goal = template.select(*stats.SITE).distinct().withColumn("gt", F.lit(None).cast("array<smallint>"))
    else:
        goal = stats.wide(template)
    pairs = _checked(_beside(goal, rows, how).where("two IS NOT NULL"), goal, rows, check)
    pairs = pairs.withColumn("old", alleles.listed(F.col("ref2"), F.col("alt2")))
    based = F.array_distinct(F.concat(F.array("one.ref"), _used_names("two", F.col("old"))))
    new = F.when(F.col("one").isNull() | (F.col("one.ref") == F.col("ref2")), F.col("old")).otherwise(based)
    pairs = pairs.withColumn("new", new).crossJoin(F.broadcast(stats.subjects(df)))
    moved = pairs.select("two.vid", "two.cidx", *KEY, "two.ploidy", F.col("new")[0].alias("ref"), alleles.alternatives(F.col("new")).alias("alt"), "sids", codec.recode(F.col("two.gt"), F.col("old"), F.col("new")).alias("gt"))
    return stats.to_long(moved)
