"""Queries on pairs of neighbouring sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import ld, select, strand
from varloom.plans import files
from varloom.plans.merging import counts, two_allele_pairs
from varloom.plans.registry import registry

QUERIES, ORACLE_SQL, add = registry()
WINDOW = 1000


def _sums(table: str, where: str = "TRUE", maf: str = "0.05e0", tag: str = "") -> str:
    """Sums over subjects for pairs of two-allele sites, from long calls."""
    return f"""f{tag} AS (SELECT vid, chrom, pos, ploidy, CAST(sum(a0 + a1) AS DOUBLE) / nullif(2 * count(a0), 0) AS p FROM {table} WHERE alt NOT LIKE '%,%' AND {where} GROUP BY ALL HAVING p >= {maf} AND 1 - p >= {maf}),
 q{tag} AS (SELECT a.chrom, a.vid AS vid1, b.vid AS vid2, a.pos AS pos1, b.pos AS pos2, a.ploidy FROM f{tag} a JOIN f{tag} b ON a.chrom = b.chrom AND a.pos < b.pos AND b.pos - a.pos <= {WINDOW}),
 s{tag} AS (SELECT chrom, vid1, vid2, pos1, pos2, q.ploidy, count(*) AS n, CAST(sum(x.a0 + x.a1) AS BIGINT) AS sa, CAST(sum(y.a0 + y.a1) AS BIGINT) AS sb,
  CAST(sum((x.a0 + x.a1) * (y.a0 + y.a1)) AS BIGINT) AS sab, CAST(sum((x.a0 + x.a1) * (x.a0 + x.a1)) AS BIGINT) AS saa, CAST(sum((y.a0 + y.a1) * (y.a0 + y.a1)) AS BIGINT) AS sbb,
  CAST(sum(x.a0 * y.a0 + x.a1 * y.a1) AS BIGINT) AS hab
  FROM q{tag} q JOIN (SELECT vid, sid, a0, a1 FROM {table} WHERE {where}) x ON x.vid = q.vid1 JOIN (SELECT vid, sid, a0, a1 FROM {table} WHERE {where}) y ON y.vid = q.vid2 AND y.sid = x.sid
  WHERE x.a0 IS NOT NULL AND y.a0 IS NOT NULL GROUP BY ALL)"""


def _geno(tag: str = "") -> str:
    d = "CAST(n AS DOUBLE)"
    return f"""g{tag} AS (SELECT *, sab - sa * sb / {d} AS num, (saa - sa * sa / {d}) * (sbb - sb * sb / {d}) AS den FROM s{tag})"""


HAPLO = """h AS (SELECT *, sa / CAST(2 * n AS DOUBLE) AS pa, sb / CAST(2 * n AS DOUBLE) AS pb, hab / CAST(2 * n AS DOUBLE) AS pab FROM s WHERE sa > 0 AND sb > 0 AND sa < 2 * n AND sb < 2 * n),
 d AS (SELECT *, 1 - pa AS qa, 1 - pb AS qb, pab - pa * pb AS d FROM h),
 r AS (SELECT *, d * d / (pa * pb * qa * qb) AS r2, d / CASE WHEN d >= 0 THEN least(qa * pb, pa * qb) ELSE least(qa * qb, pa * pb) END AS dp, d / sqrt(pa * pb * qa * qb) AS r FROM d)"""
PAIR = ["vid1", "vid2", "pos1", "pos2"]


def _options(maf=0.05, min_r2=0.2):
    return ld.Options(WINDOW, maf, min_r2)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


GENOTYPE_SQL = f"WITH {_sums('calls')}, {_geno()} SELECT vid1, vid2, pos1, pos2, n AS n_indv, round(num * num / den, 6) AS r2 FROM g WHERE den > 0 AND num * num / den >= 0.2"
add("ld_genotype", "calls", lambda c: ld.pairwise(c, "genotype", _options()).select(*PAIR, "n_indv", _r("r2")), GENOTYPE_SQL)
add("ld_wide", "calls", lambda c: ld.pairwise(stats.to_wide(c), "genotype", _options()).select(*PAIR, "n_indv", _r("r2")), GENOTYPE_SQL)
add("ld_files", "calls", lambda c: files.through_csv(ld.pairwise(c, "genotype", _options()).select("chrom1", *PAIR, "n_indv", _r("r2"))).drop("chrom1"), GENOTYPE_SQL)
add(
    "ld_haplotype",
    "calls",
    lambda c: ld.pairwise(c, "haplotype", _options()).select(*PAIR, "n_chr", _r("d"), _r("d_prime"), _r("r2")),
    f"WITH {_sums('calls')}, {HAPLO} SELECT vid1, vid2, pos1, pos2, CAST(CASE WHEN ploidy = 1 THEN n ELSE 2 * n END AS BIGINT) AS n_chr, round(d, 6) AS d, round(dp, 6) AS d_prime, round(r2, 6) AS r2 FROM r WHERE r2 >= 0.2",
)
add(
    "ld_signed_r",
    "calls",
    lambda c: ld.pairwise(c, "genotype", _options(0.1, 0.0)).select("vid1", "vid2", _r("r")),
    f"WITH {_sums('calls', maf='0.1e0')}, {_geno()} SELECT vid1, vid2, round(num / sqrt(den), 6) AS r FROM g WHERE den > 0",
)
add("ld_haplotype_r", "calls", lambda c: ld.pairwise(c, "haplotype", _options(0.1, 0.0)).select("vid1", "vid2", _r("r")), f"WITH {_sums('calls', maf='0.1e0')}, {HAPLO} SELECT vid1, vid2, round(r, 6) AS r FROM r")
add("ld_bitplane", "calls", lambda c: ld.genotype_sums(ld.neighbours(*(2 * (ld.planes(c, 0.05),)), WINDOW)).select("vid1", "vid2", "n", "sa", "sb", "sab", "saa", "sbb"), f"WITH {_sums('calls')} SELECT vid1, vid2, n, sa, sb, sab, saa, sbb FROM s")
add(
    "ld_range",
    "calls",
    lambda c: ld.pairwise(select.subjects(select.between(c, "7", 1017, 4017), list(range(0, 40))), "genotype", _options()).select(*PAIR, "n_indv", _r("r2")),
    f"WITH {_sums('calls', where="chrom = '7' AND pos BETWEEN 1017 AND 4017 AND sid < 40")}, {_geno()} SELECT vid1, vid2, pos1, pos2, n AS n_indv, round(num * num / den, 6) AS r2 FROM g WHERE den > 0 AND num * num / den >= 0.2",
)


def _signs(a, b):
    signed = strand.link_signs(a, b, two_allele_pairs(a, b), WINDOW, 0.3)
    check = strand.LinkSigns(0.05, 0.8)
    return signed.select("vid", "kept", "agree", F.coalesce(check.equal(counts()), F.lit(False)).alias("equal"), F.coalesce(check.equal(counts().turned(), True), F.lit(False)).alias("reversed"))


ALT_COUNT = "CASE WHEN a0 IS NULL THEN 0 WHEN ploidy = 1 THEN CAST(a0 > 0 AS INT) ELSE CAST(a0 > 0 AS INT) + CAST(a1 > 0 AS INT) END"


def _signs_sql():
    parts = []
    for n, t in ((1, "merge_a"), (2, "merge_b")):
        parts += [
            _sums(t, maf="0", tag=str(n)),
            _geno(str(n)),
            f"e{n} AS (SELECT chrom, vid1 AS vid, pos2 AS pos, vid2 AS o, num / sqrt(den) AS r FROM g{n} WHERE den > 0 UNION ALL SELECT chrom, vid2, pos1, vid1, num / sqrt(den) FROM g{n} WHERE den > 0)",
            f"b{n} AS (SELECT vid, chrom, pos, r FROM (SELECT *, row_number() OVER (PARTITION BY vid, chrom, pos ORDER BY round(abs(r), 9) DESC, o) AS k FROM e{n}) WHERE k = 1 AND round(abs(r), 9) >= 0.3e0)",
            f"c{n} AS (SELECT vid, CAST(sum({ALT_COUNT}) AS BIGINT) AS ac, CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an FROM {t} WHERE alt NOT LIKE '%,%' GROUP BY vid)",
        ]
    common = " AND ".join(f"CAST(least(c{n}.ac, c{n}.an - c{n}.ac) AS DOUBLE) / nullif(c{n}.an, 0) > 0.05e0" for n in (1, 2))
    return f"""WITH {', '.join(parts)}, k AS (SELECT b1.vid, count(*) AS kept, count(*) FILTER (WHERE b1.r * b2.r > 0) AS agree FROM b1 JOIN b2 ON b1.vid = b2.vid AND b1.chrom = b2.chrom AND b1.pos = b2.pos GROUP BY b1.vid)
 SELECT c1.vid, coalesce(kept, 0) AS kept, coalesce(agree, 0) AS agree, coalesce({common} AND kept > 0 AND agree >= 0.8e0 * kept, FALSE) AS equal, coalesce({common} AND kept > 0 AND kept - agree >= 0.8e0 * kept, FALSE) AS reversed
 FROM c1 JOIN c2 ON c1.vid = c2.vid LEFT JOIN k ON k.vid = c1.vid"""


add("check_ld_sign", "merge_a merge_b", _signs, _signs_sql())
