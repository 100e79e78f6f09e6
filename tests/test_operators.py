"""Properties and edge cases of the genotype operators."""

import math

import pytest
from pyspark.sql import functions as F

from varloom.functions import qc, stats
from varloom.operators import blocks, combine, ld, ranks, reshape, select, strand
from varloom.sources.fixtures import SHARE, dealt, derive

SF = "/root/testdata/sf0.001"
SCHEMA = "vid long, cidx int, chrom string, pos long, ploidy int, ref string, alt string, sid long, a0 int, a1 int"


def calls(spark, sites):
    """sites: (vid, pos, ref, alt, cells); a cell is a pair or None."""
    rows = [(v, 0, "1", p, 2, r, a, s, *(c or (None, None))) for v, p, r, a, cells in sites for s, c in enumerate(cells)]
    return spark.createDataFrame(rows, SCHEMA)


def cells_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.vid, r.ref, r.alt), {})[r.sid] = None if r.a0 is None else (r.a0, r.a1)
    return {k: [v[s] for s in sorted(v)] for k, v in out.items()}


def test_statistics(spark):
    c = calls(spark, [(1, 10, "A", "C", [(0, 1), (1, 1), None]), (2, 20, "A", "C,G", [(1, 2), (2, 2), (0, 2)]), (3, 30, "A", "C", [None] * 3)])
    s = {r.vid: r for r in stats.site_stats(c).collect()}
    assert [(s[v].ac, s[v].an, s[v].missing) for v in (1, 2, 3)] == [(3, 4, 1), (5, 6, 0), (0, 0, 3)]
    assert s[3].af == 0 and all(r.ac <= r.an for r in s.values())
    maf = {r.vid: r.maf for r in stats.minor_frequency(c).collect()}
    assert maf[1] == pytest.approx(0.25) and maf[2] == pytest.approx(1 / 6) and maf[3] == 0
    assert sorted((r.vid, r.allele, r.n) for r in stats.allele_counts(c).where("vid = 2").collect()) == [(2, 0, 1), (2, 1, 1), (2, 2, 4)]


def test_filter_edges(spark):
    df = spark.createDataFrame([(5, 100), (6, 100), (0, 0)], "ac long, an long")
    assert [r.ac for r in df.where(qc.af_between(0.05, 0.05)).collect()] == [5, 0]
    assert qc.tighten((1, 9), (3, 20)) == (3, 9)


def test_quality_rules(spark):
    rows = [("40", "MQ=3.7e1;DP=10", "C"), ("29.9", "MQ=40", "C"), (".", ".", "C"), ("30", "XMQ=1", "C"), ("30", "MQ=-5", "C"), ("30", "MQ=.", "C"), ("99", "MQ=19.99", "C"), ("99", "", ",".join("C" * 15))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vid long, qual string, info string, alt string")
    assert sorted(r.vid for r in qc.variants(df).collect()) == [0, 2, 3, 5]
    assert sorted(r.vid for r in qc.variants(df, enabled=False).collect()) == list(range(7))
    cells = spark.createDataFrame([("GT", 0, 0, 1, 1), ("GT:GQ:DP", 20, 4, 1, 1), ("GT:GQ:DP", 19, 9, 1, 1), ("GT:GQ", 50, None, 1, 1)], "format string, gq int, dp int, a0 int, a1 int")
    assert [r.a0 for r in qc.genotypes(cells).collect()] == [1, 1, None, None]


def test_split_and_join(spark):
    full = calls(spark, [(1, 10, "A", "C,G", [(0, 1), (2, 1), (2, 2)])])
    split = reshape.split_biallelic(full)
    assert cells_of(split) == {(1, "A", "C"): [(0, 1), (0, 1), (0, 0)], (1, "A", "G"): [(0, 0), (1, 0), (1, 1)]}
    sites = split.withColumn("vid", F.col("part").cast("long")).drop("part")
    assert list(cells_of(reshape.join_multiallelic(sites)).items()) == [((1, "A", "C,G"), [(0, 1), (2, 1), (2, 2)])]
    unused = calls(spark, [(1, 10, "A", "C,G", [(0, 0), None])])
    assert cells_of(reshape.split_biallelic(unused)) == {(1, "A", "."): [None, None]}
    assert cells_of(reshape.simplify(unused)) == {(1, "A", "."): [(0, 0), None]}


def test_split_and_join_of_wide_rows(spark):
    c = derive(spark, SF, "calls").where("vid < 60").drop("idx")
    c = spark.createDataFrame(c.collect(), c.schema)
    wide = stats.to_wide(c)
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    key = [*stats.SITE, "sid", "a0", "a1"]
    same = lambda x, y, cols: sorted(map(repr, x.select(cols).collect())) == sorted(map(repr, y.select(cols).collect()))
    split = reshape.split_biallelic(wide)
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    assert same(stats.to_long(split, [*stats.SITE, "part"]), reshape.split_biallelic(c), [*key, "part"])
    for phased in (True, False):
        joined = reshape.join_multiallelic(wide, phased)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
        assert same(stats.to_long(joined), reshape.join_multiallelic(c, phased), key)


def fold_unphased(cells):
    """Plain form of the unphased fold."""
    left = right = None
    for a, b in (c for c in cells if c):
        if not left:
            left = a
            if left == 0:
                left = b
                right = 0 if right is None else right
            else:
                right = b
        elif right == 0:
            right = a if a else b
    return None if left is None else (left, right)


def test_unphased_join(spark):
    import itertools

    options = [None, (0, 0), (0, 1), (1, 1)]
    combos = list(itertools.product(options, repeat=3))
    sites = [(k + 1, 10, "A", b, [c[k] for c in combos]) for k, b in enumerate("CGT")]
    got = cells_of(reshape.join_multiallelic(calls(spark, sites), phased=False))[(1, "A", "C,G,T")]
    for c, cell in zip(combos, got):
        renamed = [x and tuple(k + 1 if a else 0 for a in x) for k, x in enumerate(c)]
        assert cell == fold_unphased(renamed), c


def test_folds_look_codes_up(spark):
    """Folding works out no code per cell, and gives what the plain forms give for all codes."""
    from varloom.functions import codec

    wide = stats.to_wide(calls(spark, [(1, 10, "A", "C", [(0, 1)]), (2, 10, "A", "G", [(1, 1)])]))
    for phased in (True, False):
        assert "SQRT" not in reshape.join_multiallelic(wide, phased)._jdf.queryExecution().optimizedPlan().toString()
    codes = spark.range(226).select(F.col("id").cast("smallint").alias("x"))
    g = lambda c: codec.decode(c.cast("int"))
    fold = codes.crossJoin(codes.withColumnRenamed("x", "y")).select(g(F.col("x")).alias("x"), g(F.col("y")).alias("y"), g(reshape._fold(F.col("x"), F.col("y"))).alias("p"), g(reshape._fold_unphased(reshape._alone(F.col("x")), F.col("y"))).alias("u"))
    cell = lambda r: None if r.a0 is None else (r.a0, r.a1)
    rows = [tuple(map(cell, r)) for r in fold.collect()]
    assert len(rows) == 226 * 226
    for x, y, p, u in rows:
        assert u == fold_unphased([x, y]), (x, y)
        assert p == (tuple(a or b for a, b in zip(x, y)) if x and y else x or y), (x, y)


def test_too_many_alleles(spark):
    sites = [(k, 10, "A", "A" * (k + 2), [(1, 1)]) for k in range(15)]
    with pytest.raises(Exception, match="more alleles"):
        reshape.join_multiallelic(calls(spark, sites)).collect()


def test_merge(spark):
    a = calls(spark, [(1, 10, "A", "C", [(0, 1)]), (2, 20, "A", "C", [(1, 1)]), (3, 30, "A", "G", [(0, 1)])])
    b = calls(spark, [(4, 10, "C", "A", [(0, 1)]), (5, 30, "A", "T", [(0, 1)]), (6, 40, "A", "T", [(1, 0)])]).withColumn("sid", F.col("sid") + 100)
    inner = cells_of(combine.merge(a, b))
    assert inner == {(1, "A", "C"): [(0, 1), (1, 0)], (3, "A", "G,T"): [(0, 1), (0, 2)]}
    outer = cells_of(combine.merge(a, b, "union"))
    assert outer == inner | {(2, "A", "C"): [(1, 1), None], (6, "A", "T"): [None, (1, 0)]}
    three = combine.merge_all([(a, 1), (b, 1), (b.withColumn("sid", F.col("sid") + 100), 1)], "intersection")
    assert {k: len(v) for k, v in cells_of(three).items()} == {(1, "A", "C"): 3, (3, "A", "G,T"): 3}


def test_matching_prefers_alike_alleles(spark):
    a = calls(spark, [(1, 10, "A", "C", [(0, 0)]), (2, 10, "A", "G", [(0, 0)]), (3, 10, "A", "T", [(0, 0)])])
    b = calls(spark, [(11, 10, "G", "A", [(0, 0)]), (12, 10, "A", "AA", [(0, 0)])])
    got = {(r.vid1, r.vid2) for r in combine.match(a, b).collect()}
    assert got == {(2, 11), (1, 12), (3, None)}


def test_align(spark):
    template = calls(spark, [(1, 10, "C", "A", [(0, 1)]), (2, 99, "A", "C", [(0, 1)])])
    mine = calls(spark, [(5, 10, "A", "C", [(0, 1), (1, 1)]), (6, 50, "A", "G", [(0, 1), None])])
    assert cells_of(combine.align(mine, template)) == {(5, "C", "A"): [(1, 0), (0, 0)]}
    assert cells_of(combine.align(mine, template, "union")) == {(5, "C", "A"): [(1, 0), (0, 0)], (6, "A", "G"): [(0, 1), None]}


def test_ld_against_plain_sums(spark):
    c = derive(spark, "/root/testdata/sf0.01", "calls").where("chrom IN ('3', 'Y') AND pos < 1500 AND alt NOT LIKE '%,%'").cache()
    rows = c.collect()
    site = {}
    for r in rows:
        site.setdefault((r.chrom, r.pos, r.vid), {})[r.sid] = None if r.a0 is None else r.a0 + r.a1
    got = {(r.vid1, r.vid2): r for r in ld.pairwise(c, "genotype", ld.Options(700, 0.05, 0.0)).collect()}

    def freq(v):
        known = [x for x in v.values() if x is not None]
        return sum(known) / (2 * len(known))

    keys = sorted(k for k, v in site.items() if 0.05 <= freq(v) <= 0.95)
    expected = {}
    for x in keys:
        for y in keys:
            if x[0] == y[0] and 0 < y[1] - x[1] <= 700:
                both = [(site[x][s], site[y][s]) for s in site[x] if site[x][s] is not None and site[y][s] is not None]
                n, sa, sb = len(both), sum(a for a, _ in both), sum(b for _, b in both)
                num = sum(a * b for a, b in both) - sa * sb / n
                den = (sum(a * a for a, _ in both) - sa * sa / n) * (sum(b * b for _, b in both) - sb * sb / n)
                if den > 0:
                    expected[(x[2], y[2])] = (n, num / math.sqrt(den))
    assert set(got) == set(expected)
    for k, (n, r) in expected.items():
        assert got[k].n_indv == n and got[k].r == pytest.approx(r) and 0 <= got[k].r2 <= 1 + 1e-9


def test_ld_plan_has_no_product(spark):
    c = derive(spark, SF, "calls")
    plan = ld.neighbours(ld.planes(c, 0.05), ld.planes(c, 0.05), 1000)._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join" in line][0]
    assert "_bin" in join and "chrom" in join
    with pytest.raises(ValueError):
        ld.pairwise(c, "genotype", ld.Options(0))


def test_checkers(spark):
    assert strand.critical_value(0.05) == pytest.approx(3.841458821, abs=1e-6)
    df = spark.createDataFrame([(97, 3, 96, 4), (97, 3, 60, 40), (20, 0, 3, 1), (0, 0, 5, 5)], "r1 long, a1 long, r2 long, a2 long")
    c = strand.Counts(*(F.col(x) for x in ("r1", "a1", "r2", "a2")))
    chi = [r.x for r in df.select(strand.chi_square(c).alias("x")).collect()]
    n, x = 200, abs(97 * 4 - 3 * 96) - 100
    assert chi[0] == pytest.approx(n * x * x / (100 * 193 * 7 * 100)) and chi[3] is None
    equal = [bool(r.x) for r in df.select(strand.ChiSquare().equal(c).alias("x")).collect()]
    assert equal == [True, False, False, False]
    gap = strand.FrequencyGap(0.5, 0.05) | strand.ChiSquare()
    assert [r.x for r in df.select(gap.equal(c).alias("x")).collect()][:2] == [True, False]
    assert isinstance(strand.checker(no_ld=True, freq_gap=True), strand.FrequencyGap) and isinstance(strand.checker(), strand.Either)


class Fixed(strand.Checker):
    def __init__(self, direct, turned):
        self.answers = (direct, turned)

    def equal(self, c, reverse=False):
        return F.lit(self.answers[int(reverse)])


@pytest.mark.parametrize(
    "labels, counts, answers, expected",
    [
        (("A", "C", "T", "G"), (5, 5, 5, 5), (True, False), ("C", "A", "C")),
        (("A", "C", "T", "G"), (5, 5, 5, 5), (False, False), ("C", "T", "G")),
        (("A", "T", "A", "T"), (5, 5, 5, 5), (True, True), ("T", "T", "A")),
        (("A", "T", "A", "T"), (5, 5, 5, 5), (True, False), ("T", "A", "T")),
        (("A", "C", "A", "G"), (5, 0, 5, 0), (False, False), ("C", "A", "C")),
        (("A", "C", "T", "G"), (5, 0, 5, 0), (False, False), ("C", "A", "C")),
        (("A", "C", "G", "T"), (5, 0, 5, 0), (False, False), ("G", "G", "A")),
        (("A", "C", "A", "G"), (5, 0, 5, 5), (False, False), ("G", "A", "G")),
        (("A", "C", "A", "T"), (5, 0, 5, 5), (False, True), ("T", "T", "A")),
        (("A", "C", "G", "A"), (5, 0, 5, 5), (False, False), ("G", "G", "A")),
        (("A", "C", "T", "G"), (5, 0, 5, 5), (True, False), ("C", "A", "C")),
        (("A", "C", "T", "G"), (5, 5, 5, 0), (True, False), ("C", "A", "C")),
        (("A", "C", "A", "G"), (5, 5, 5, 0), (False, False), ("C", "A", "C")),
        (("A", "C", "G", "T"), (5, 5, 5, 0), (False, False), ("C", "G", "A")),
    ],
)
def test_strand_ladder(spark, labels, counts, answers, expected):
    df = spark.createDataFrame([(*labels, *counts)], "r1 string, l1 string, r2 string, l2 string, a int, b int, c int, d int")
    out = strand.relabelled(*(F.col(x) for x in ("r1", "l1", "r2", "l2")), strand.Counts(*(F.col(x) for x in "abcd")), Fixed(*answers))
    assert tuple(df.select(out.alias("o")).first().o) == expected


def test_ranks_over_stretches(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 500, i) for i in range(300)], "cidx int, pos long, vid long")
    rows = ranks.numbered(df, "cidx", "pos", ["vid"], stretch=37).collect()
    for c in range(3):
        mine = sorted((r.pos, r.vid, r.row) for r in rows if r.cidx == c)
        assert [r for *_, r in mine] == list(range(100))


def test_block_edits(spark):
    v = blocks.form(derive(spark, "/root/testdata/sf0.01", "variants"), 16).cache()
    pick = lambda *ids: v.where(F.col("block_id").isin(list(ids)))
    one = sorted(r.vid for r in blocks.concat(pick(0), pick(1)).collect())
    assert one == sorted(r.vid for r in pick(0, 1).collect())
    chosen = v.where("chrom = '1' AND block_id = 0").select("chrom", "block_id")
    assert select.blocks(v, chosen).count() + select.without_blocks(v, chosen).count() == v.count()
    assert all(r.ordered for r in blocks.is_ordered(blocks.stats(v)).collect())
    with pytest.raises(ValueError):
        blocks.concat(v, v.drop("alt"))
    with pytest.raises(ValueError):
        select.chroms(v, ["nope"], ["1", "2"])
    assert blocks.block_size(1000) == 16384 and blocks.block_size(10**7) == 128
    with pytest.raises(ValueError):
        blocks.block_size(10**9, 128)


def test_names_must_fit(spark):
    s = spark.createDataFrame([(0, "a"), (1, "b")], "sid int, name string")
    with pytest.raises(Exception, match="once for each"):
        blocks.rename_subjects(s, spark.createDataFrame([(0, "x"), (1, "x")], "sid int, name string")).collect()
    with pytest.raises(Exception, match="unknown name"):
        select.resolve(spark.createDataFrame([("zzz",)], "name string"), s, "name").collect()


def test_sites_of_more_alleles_than_codes(spark):
    """Fifteen alleles are merged and re-based, sixteen are an error and never cut."""
    names = [chr(66 + k) * 2 for k in range(20)]
    sites = lambda a, b: (
        calls(spark, [(1, 10, "A", ",".join(names[:a]), [(k, k) for k in range(a + 1)])]),
        calls(spark, [(1, 10, "A", ",".join(names[a : a + b]), [(k, 0) for k in range(b + 1)])]).withColumn("sid", F.col("sid") + 100),
    )
    got = cells_of(combine.merge(*sites(9, 5), "union"))
    assert got == {(1, "A", ",".join(names[:14])): [(k, k) for k in range(10)] + [(0, 0)] + [(9 + k, 0) for k in range(1, 6)]}
    for f in (lambda: combine.merge(*sites(9, 6), "union"), lambda: combine.merge(*sites(10, 10))):
        with pytest.raises(Exception, match="more alleles than a site may have"):
            f().collect()
    full, _ = sites(14, 1)
    with pytest.raises(Exception, match="more alleles than a site may have"):
        reshape.reset_reference(full, F.lit("T")).collect()
    with pytest.raises(Exception, match="more alleles than a site may have"):
        combine.align(full, calls(spark, [(5, 10, "T", "C", [(0, 0)])])).collect()


def test_wide_rows_in_wide_rows_out(spark):
    """Stored wide rows give what long ones do, over 1,500 subjects."""
    cells = lambda v, n: [None if (v * s) % 17 == 3 else ((v + s) % 3 % 2, (v * s) % 5 % 3 % 2) for s in range(n)]
    a = calls(spark, [(v, 10 * (v // 2), "A", "CG"[v % 2], cells(v, 1500)) for v in range(12)])
    b = calls(spark, [(v + 50, 10 * (v // 2), "ACA"[v % 3], "GAC"[v % 3], cells(v + 1, 700)) for v in range(12)]).withColumn("sid", F.col("sid") + 5000)
    wa, wb = (spark.createDataFrame(stats.to_wide(t).collect(), stats.to_wide(t).schema) for t in (a, b))
    check = strand.ChiSquare(0.5, 0.5)
    for how in ("intersection", "union"):
        for f in (lambda x, y: combine.merge(x, y, how), lambda x, y: combine.merge(x, y, how, check), lambda x, y: combine.align(x, y, how, check)):
            assert cells_of(f(a, b)) == cells_of(f(wa, wb))
    options = ld.Options(30, 0.0, 0.0)
    pairs = [sorted((r.vid1, r.vid2, r.n_indv, round(r.r2, 9)) for r in ld.pairwise(t, "genotype", options).collect()) for t in (a, wa)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 20
    plan = ld.planes(wa, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert cells_of(stats.to_long(reshape.simplify(wa))) == cells_of(reshape.simplify(a))


def test_checker_options(spark):
    check = strand.checker(maf=0.2, agreeing=0.7, window=500, min_r=0.4)
    assert strand.links_in(check) == strand.LinkSigns(0.2, 0.7, 500, 0.4) and strand.links_in(strand.checker(no_ld=True)) is None
    a, b = derive(spark, SF, "merge_a"), derive(spark, SF, "merge_b").withColumn("vid", F.col("vid") + 1000)
    plain, checked = (combine.merge(a, b, "union", c).count() for c in (None, check))
    assert plain == checked


def test_defaults_and_cursor(spark):
    c = derive(spark, SF, "calls")
    options = ld.Options(1000, 0.1, 0.0)
    for phased, model in ((True, "haplotype"), (False, "genotype")):
        assert ld.pairwise(c, None, options, phased).count() == ld.pairwise(c, model, options).count()
    with pytest.raises(ValueError):
        ld.pairwise(c, "other")
    v = derive(spark, SF, "variants")
    assert select.tell(v.limit(0)) is None and select.resume(v, None).count() == v.count()
    assert select.resume(v, select.tell(v)).count() == 0
    wide = stats.to_wide(c)
    assert select.subjects_wide(wide, [5, 2, 5]).first().sids == [5, 2]
    with pytest.raises(Exception, match="unknown subject"):
        select.subjects_wide(wide, [10**6]).collect()


def test_shared_positions_join_nothing(spark):
    """Once each, nulls too, and no side that could be broadcast."""
    a, b = (spark.createDataFrame(rows, "chrom string, pos long, sid int") for rows in ([("1", 5, 1), ("1", 5, 2), (None, 3, 1), ("2", 5, 1)], [("1", 5, 3), (None, 3, 3), (None, 3, 4), ("1", 6, 3)]))
    got = combine.shared_positions(a, b)
    assert sorted(map(tuple, got.collect()), key=str) == [("1", 5), (None, 3)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_calls_keep_the_deal_of_their_variants(spark):
    """Grouping by site moves no cells, and tasks grow with the variants."""
    plan = stats.genotype_counts(derive(spark, SF, "calls"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert dealt(derive(spark, SF, "variants"), SHARE * 3 + 1).rdd.getNumPartitions() == 4
