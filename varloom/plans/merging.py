"""Queries that combine two tables: merges, alignment and strand repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import qc, stats
from varloom.operators import combine, strand
from varloom.plans.registry import registry

QUERIES, ORACLE_SQL, add = registry()
CALL = ["vid", "chrom", "pos", "ref", "alt", "sid", "a0", "a1"]


def _side(n: int, table: str) -> str:
    return f"""s{n} AS (SELECT vid AS vid{n}, chrom, pos, array_to_string(list_sort([ref, alt]), '>') AS kind, ref, alt FROM (SELECT DISTINCT vid, chrom, pos, ref, alt FROM {table}) t),
 t{n} AS (SELECT vid{n}, chrom, pos, kind, row_number() OVER (PARTITION BY chrom, pos, kind ORDER BY vid{n}) AS turn FROM s{n})"""


def match_sql(one: str, two: str, how: str) -> str:
    within = "WHERE EXISTS (SELECT 1 FROM s1 WHERE s1.chrom = p.chrom AND s1.pos = p.pos) AND EXISTS (SELECT 1 FROM s2 WHERE s2.chrom = p.chrom AND s2.pos = p.pos)" if how == "intersection" else ""
    return f"""{_side(1, one)}, {_side(2, two)},
 j AS (SELECT coalesce(t1.chrom, t2.chrom) AS chrom, coalesce(t1.pos, t2.pos) AS pos, vid1, vid2 FROM t1 FULL JOIN t2 ON t1.chrom = t2.chrom AND t1.pos = t2.pos AND t1.kind = t2.kind AND t1.turn = t2.turn),
 l AS (SELECT chrom, pos, vid1, row_number() OVER (PARTITION BY chrom, pos ORDER BY vid1) AS place FROM j WHERE vid2 IS NULL),
 r AS (SELECT chrom, pos, vid2, row_number() OVER (PARTITION BY chrom, pos ORDER BY vid2) AS place FROM j WHERE vid1 IS NULL),
 p AS (SELECT chrom, pos, vid1, vid2 FROM j WHERE vid1 IS NOT NULL AND vid2 IS NOT NULL
  UNION ALL SELECT coalesce(l.chrom, r.chrom), coalesce(l.pos, r.pos), vid1, vid2 FROM l FULL JOIN r ON l.chrom = r.chrom AND l.pos = r.pos AND l.place = r.place),
 m AS (SELECT p.* FROM p {within})"""


def _used(n: int, table: str) -> str:
    return f"""u{n} AS (SELECT vid, list(a ORDER BY a) AS used FROM (SELECT DISTINCT vid, a FROM (SELECT vid, a0 AS a FROM {table} UNION ALL SELECT vid, a1 FROM {table}) WHERE a IS NOT NULL) GROUP BY vid),
 o{n} AS (SELECT s.vid{n}, s.ref AS ref{n}, s.alt AS alt{n}, list_prepend(s.ref, string_split(s.alt, ',')) AS old{n}, list_transform(coalesce(u.used, []), lambda i: list_prepend(s.ref, string_split(s.alt, ','))[i + 1]) AS used{n} FROM s{n} s LEFT JOIN u{n} u ON u.vid = s.vid{n})"""


def merge_sql(how: str) -> str:
    cells = "\n UNION ALL ".join(
        f"""SELECT coalesce(k.vid1, k.vid2) AS vid, k.chrom, k.pos, k.new[1] AS ref, CASE WHEN len(k.new) = 1 THEN '.' ELSE array_to_string(k.new[2:], ',') END AS alt, d.sid,
 CAST(list_position(k.new, k.old{n}[c.a0 + 1]) - 1 AS INT) AS a0, CAST(list_position(k.new, k.old{n}[c.a1 + 1]) - 1 AS INT) AS a1
 FROM k CROSS JOIN (SELECT DISTINCT sid FROM {t}) d LEFT JOIN {t} c ON c.vid = k.vid{n} AND c.sid = d.sid"""
        for n, t in ((1, "merge_a"), (2, "merge_b"))
    )
    return f"""WITH {match_sql('merge_a', 'merge_b', how)}, {_used(1, 'merge_a')}, {_used(2, 'merge_b')},
 w AS (SELECT m.*, o1.ref1, o1.alt1, o1.old1, o2.ref2, o2.alt2, o2.old2, flatten([[o1.ref1], o1.used1, o2.used2]) AS long FROM m LEFT JOIN o1 ON o1.vid1 = m.vid1 LEFT JOIN o2 ON o2.vid2 = m.vid2),
 k AS (SELECT chrom, pos, vid1, vid2, old1, old2, CASE WHEN vid1 IS NULL THEN old2 WHEN vid2 IS NULL OR (ref1 = ref2 AND alt1 = alt2) THEN old1 ELSE list_filter(long, lambda x, i: list_position(long, x) = i) END AS new FROM w),
 g AS ({cells})"""


for how in ("intersection", "union"):
    add(f"merge_{how}", "merge_a merge_b", lambda a, b, h=how: combine.merge(a, b, h).select(*CALL), merge_sql(how) + " SELECT * FROM g")
add("merge_multirow", "merge_a merge_b", lambda a, b: combine.match(a, b, "union").select("chrom", "pos", "vid1", "vid2"), f"WITH {match_sql('merge_a', 'merge_b', 'union')} SELECT * FROM m")
add("shared_positions", "merge_a merge_b", lambda a, b: combine.shared_positions(a, b), "SELECT chrom, pos FROM merge_a INTERSECT SELECT chrom, pos FROM merge_b")


def _merge_split(a, b):
    c = combine.merge_biallelic(a, b, "intersection")
    return qc.sites(c.drop("part").withColumn("cidx", F.lit(0)), qc.ac_between(1)).select("vid", "chrom", "pos", "ref", "alt", "ac", "an")


add(
    "merge_biallelic",
    "merge_a merge_b variants",
    lambda a, b, v: _merge_split(a, b),
    merge_sql("intersection")
    + """, z AS (SELECT g.*, v.ploidy, string_split(g.alt, ',') AS alts FROM g JOIN variants v ON v.vid = g.vid),
 x AS (SELECT *, unnest(range(1, len(alts) + 1)) AS k FROM z WHERE alt <> '.' UNION ALL SELECT *, 0 AS k FROM z WHERE alt = '.'),
 q AS (SELECT vid, chrom, pos, ref, CASE WHEN k = 0 THEN '.' ELSE alts[k] END AS alt, ploidy, CASE WHEN len(alts) = 1 THEN a0 ELSE CAST(a0 = k AS INT) END AS a0, CASE WHEN len(alts) = 1 THEN a1 ELSE CAST(a1 = k AS INT) END AS a1 FROM x)
 SELECT vid, chrom, pos, ref, alt, CAST(sum(CASE WHEN a0 IS NULL THEN 0 WHEN ploidy = 1 THEN CAST(a0 > 0 AS INT) ELSE CAST(a0 > 0 AS INT) + CAST(a1 > 0 AS INT) END) AS BIGINT) AS ac,
 CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an FROM q GROUP BY ALL HAVING ac >= 1""",
)
for how, keep in (("intersection", "vid1 IS NOT NULL AND vid2 IS NOT NULL OR vid2 IS NOT NULL"), ("union", "vid2 IS NOT NULL")):
    add(
        "align_template" if how == "intersection" else "align_template_union",
        "merge_b merge_a",
        lambda b, a, h=how: combine.align(b, a, h).select(*CALL),
        f"""WITH {match_sql('merge_a', 'merge_b', how)}, {_used(2, 'merge_b')},
 w AS (SELECT o2.*, s1.ref AS rt FROM m JOIN o2 ON o2.vid2 = m.vid2 LEFT JOIN s1 ON s1.vid1 = m.vid1 WHERE {keep.replace('vid1', 'm.vid1').replace('vid2', 'm.vid2')}),
 k AS (SELECT vid2, old2, CASE WHEN rt IS NULL OR rt = ref2 THEN old2 ELSE list_prepend(rt, list_filter(used2, lambda x: x <> rt)) END AS new FROM w)
 SELECT c.vid, c.chrom, c.pos, k.new[1] AS ref, CASE WHEN len(k.new) = 1 THEN '.' ELSE array_to_string(k.new[2:], ',') END AS alt, c.sid,
 CAST(list_position(k.new, k.old2[c.a0 + 1]) - 1 AS INT) AS a0, CAST(list_position(k.new, k.old2[c.a1 + 1]) - 1 AS INT) AS a1 FROM merge_b c JOIN k ON k.vid2 = c.vid""",
    )


def two_allele_pairs(a, b):
    """Pairs of two-allele sites of the same variant, with the counts of both sides."""
    one = stats.site_stats(a.where(~F.col("alt").contains(","))).select("vid", "chrom", "pos", *(F.col(c).alias(f"{c}1") for c in ("ref", "alt", "ac", "an")))
    two = stats.site_stats(b.where(~F.col("alt").contains(","))).select(F.col("vid").alias("v"), *(F.col(c).alias(f"{c}2") for c in ("ref", "alt", "ac", "an")))
    return one.join(two, F.col("vid") == F.col("v")).drop("v").withColumn("vid1", F.col("vid")).withColumn("vid2", F.col("vid"))


def counts() -> strand.Counts:
    return strand.Counts(F.col("an1") - F.col("ac1"), F.col("ac1"), F.col("an2") - F.col("ac2"), F.col("ac2"))


ALT_COUNT = "CASE WHEN a0 IS NULL THEN 0 WHEN ploidy = 1 THEN CAST(a0 > 0 AS INT) ELSE CAST(a0 > 0 AS INT) + CAST(a1 > 0 AS INT) END"
PAIRS = "WITH " + ", ".join(
    f"c{n} AS (SELECT vid, chrom, pos, ref AS ref{n}, alt AS alt{n}, CAST(sum({ALT_COUNT}) AS BIGINT) AS ac{n}, CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an{n} FROM {t} WHERE alt NOT LIKE '%,%' GROUP BY ALL)"
    for n, t in ((1, "merge_a"), (2, "merge_b"))
) + """,
 pr AS (SELECT c1.*, ref2, alt2, ac2, an2, an1 - ac1 AS rc1, an2 - ac2 AS rc2 FROM c1 JOIN c2 ON c1.vid = c2.vid)"""


def _chi_sql(r1="rc1", a1="ac1", r2="rc2", a2="ac2"):
    n = f"CAST({r1} + {a1} + {r2} + {a2} AS DOUBLE)"
    x = f"CAST({r1} * {a2} - {a1} * {r2} AS DOUBLE)"
    small = f"({n} < 40 OR least({r1}, {a1}, {r2}, {a2}) < 5)"
    yates = f"(CASE WHEN {small} THEN abs({x}) - {n} / 2 ELSE {x} END)"
    return f"({n} * {yates} * {yates} / nullif(CAST({r1} + {a1} AS DOUBLE) * ({r1} + {r2}) * ({a1} + {a2}) * ({r2} + {a2}), 0))"


def _minor_sql(r, a):
    return f"(CAST(least({r}, {a}) AS DOUBLE) / nullif({r} + {a}, 0))"


def _eq_sql(maf, r2="rc2", a2="ac2"):
    critical = strand.critical_value(0.05)
    return f"coalesce({_minor_sql('rc1', 'ac1')} <= {maf}e0 AND {_minor_sql(r2, a2)} <= {maf}e0 AND {_chi_sql(r2=r2, a2=a2)} < {critical}e0, FALSE)"


add(
    "check_chi2",
    "merge_a merge_b",
    lambda a, b: two_allele_pairs(a, b).select("vid", F.round(strand.chi_square(counts()), 6).alias("chi2"), F.coalesce(strand.ChiSquare(0.4).equal(counts()), F.lit(False)).alias("equal")),
    f"{PAIRS} SELECT vid, round({_chi_sql()}, 6) AS chi2, {_eq_sql(0.4)} AS equal FROM pr",
)
add(
    "check_freq_gap",
    "merge_a merge_b",
    lambda a, b: two_allele_pairs(a, b).select("vid", F.coalesce(strand.FrequencyGap(0.4, 0.1).equal(counts()), F.lit(False)).alias("equal")),
    f"{PAIRS} SELECT vid, coalesce({_minor_sql('rc1', 'ac1')} <= 0.4e0 AND {_minor_sql('rc2', 'ac2')} <= 0.4e0 AND abs(CAST(ac1 AS DOUBLE) / nullif(rc1 + ac1, 0) - CAST(ac2 AS DOUBLE) / nullif(rc2 + ac2, 0)) < 0.1e0, FALSE) AS equal FROM pr",
)


def _fixed(a, b):
    p = two_allele_pairs(a, b)
    new = strand.relabelled(F.col("ref1"), F.col("alt1"), F.col("ref2"), F.col("alt2"), counts(), strand.ChiSquare(0.5))
    return p.select("vid", new.alias("n")).select("vid", F.col("n.alt1").alias("new_alt1"), F.col("n.ref2").alias("new_ref2"), F.col("n.alt2").alias("new_alt2"))


def _ladder_sql():
    c = lambda x: f"translate({x}, 'ACGT', 'TGCA')"
    eq, eqr = _eq_sql(0.5), _eq_sql(0.5, "ac2", "rc2")
    row = lambda a1, r2, a2: f"{{'a': {a1}, 'b': {r2}, 'c': {a2}}}"
    return f"""CASE WHEN ac1 = 0 AND ac2 = 0 THEN CASE WHEN ref1 = ref2 THEN {row('alt1', 'ref2', 'alt1')} WHEN ref1 = {c('ref2')} THEN {row('alt1', 'ref1', 'alt1')} ELSE {row('ref2', 'ref2', 'ref1')} END
 WHEN ac1 = 0 THEN CASE WHEN ref1 = ref2 AND ref1 = {c('alt2')} AND {eqr} THEN {row('alt2', 'alt2', 'ref1')} WHEN ref1 = ref2 THEN {row('alt2', 'ref2', 'alt2')}
  WHEN ref1 = alt2 AND ref1 = {c('ref2')} AND {eq} THEN {row('ref2', 'ref1', 'ref2')} WHEN ref1 = alt2 THEN {row('ref2', 'ref2', 'alt2')}
  WHEN ref1 = {c('ref2')} AND {eq} THEN {row(c('alt2'), 'ref1', c('alt2'))} WHEN ref1 = {c('alt2')} AND {eqr} THEN {row(c('ref2'), c('ref2'), 'ref1')} ELSE {row('ref2', 'ref2', 'alt2')} END
 WHEN ac2 = 0 THEN CASE WHEN ref2 = ref1 AND ref2 = {c('alt1')} AND {eqr} THEN {row('alt1', 'alt1', 'ref1')} WHEN ref2 = ref1 THEN {row('alt1', 'ref2', 'alt1')}
  WHEN ref2 = alt1 AND ref2 = {c('ref1')} AND {eq} THEN {row('alt1', 'ref1', 'alt1')} WHEN ref2 = alt1 THEN {row('alt1', 'ref2', 'ref1')}
  WHEN ref2 = {c('ref1')} AND {eq} THEN {row('alt1', 'ref1', 'alt1')} WHEN ref2 = {c('alt1')} AND {eqr} THEN {row('alt1', 'alt1', 'ref1')} ELSE {row('alt1', 'ref2', 'ref1')} END
 WHEN alt1 LIKE '%,%' OR alt2 LIKE '%,%' THEN CASE WHEN ref1 = {c('ref2')} AND {eq} OR ref1 <> {c('ref2')} AND {eqr} AND (alt1 NOT LIKE '%,%' AND alt1 = {c('ref2')} OR alt1 LIKE '%,%' AND alt2 NOT LIKE '%,%' AND alt2 = {c('ref1')}) THEN {row('alt1', c('ref2'), c('alt2'))} ELSE {row('alt1', 'ref2', 'alt2')} END
 WHEN ref1 = {c('ref2')} AND alt1 = {c('alt2')} AND {eq} THEN {row('alt1', 'ref1', 'alt1')} WHEN ref1 = {c('alt2')} AND alt1 = {c('ref2')} AND {eqr} THEN {row('alt1', 'alt1', 'ref1')} ELSE {row('alt1', 'ref2', 'alt2')} END"""


add("merge_strand_fix", "merge_a merge_b", _fixed, f"{PAIRS}, n AS (SELECT vid, {_ladder_sql()} AS n FROM pr) SELECT vid, n.a AS new_alt1, n.b AS new_ref2, n.c AS new_alt2 FROM n")


CHECK = strand.ChiSquare(0.5)
#: Tables of unlike row names, with more strand errors and many-allele sites than merge_b.
TURNED = """t AS (SELECT 100000 + vid AS vid, cidx, chrom, ploidy, idx, pos, CASE WHEN vid % 3 = 0 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
 CASE WHEN vid % 3 = 0 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt, sid, a0, a1 FROM merge_b)"""


def _turned(b):
    comp = lambda c: F.when(F.col("vid") % 3 == 0, F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    return b.withColumns({"ref": comp("ref"), "alt": comp("alt")}).withColumn("vid", F.col("vid") + 100000)


def checked_sql(how: str, align: bool = False) -> str:
    """Pairs by coordinate, their labels by the ladder, then the lists and cells."""
    stat = ", ".join(f"c{n} AS (SELECT vid, CAST(sum({ALT_COUNT}) AS BIGINT) AS ac{n}, CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an{n} FROM {t} GROUP BY ALL)" for n, t in ((1, "merge_a"), (2, "t")))
    if align:
        new = "CASE WHEN vid1 IS NULL OR ref1 = r2 THEN old2 ELSE list_prepend(ref1, list_filter(list_transform(used2, lambda i: old2[i + 1]), lambda x: x <> ref1)) END"
        sides, keep = ((2, "t"),), "WHERE vid2 IS NOT NULL"
    else:
        new = "CASE WHEN vid1 IS NULL THEN old2 WHEN vid2 IS NULL OR old1 = old2 THEN old1 ELSE list_filter(long, lambda x, i: list_position(long, x) = i) END"
        sides, keep = ((1, "merge_a"), (2, "t")), ""
    vid = "k.vid2" if align else "coalesce(k.vid1, k.vid2)"
    cells = "\n UNION ALL ".join(
        f"""SELECT {vid} AS vid, k.chrom, k.pos, k.new[1] AS ref, CASE WHEN len(k.new) = 1 THEN '.' ELSE array_to_string(k.new[2:], ',') END AS alt, d.sid,
 CAST(list_position(k.new, k.old{n}[c.a0 + 1]) - 1 AS INT) AS a0, CAST(list_position(k.new, k.old{n}[c.a1 + 1]) - 1 AS INT) AS a1
 FROM k CROSS JOIN (SELECT DISTINCT sid FROM {t}) d LEFT JOIN {t} c ON c.vid = k.vid{n} AND c.sid = d.sid"""
        for n, t in sides
    )
    return f"""WITH {TURNED}, {match_sql('merge_a', 't', how)}, {_used(1, 'merge_a')}, {_used(2, 't')}, {stat},
 pr AS (SELECT m.*, s1.ref AS ref1, s1.alt AS alt1, s2.ref AS ref2, s2.alt AS alt2, ac1, ac2, an1 - ac1 AS rc1, an2 - ac2 AS rc2, coalesce(u1.used, []) AS used1, coalesce(u2.used, []) AS used2
  FROM m LEFT JOIN s1 ON s1.vid1 = m.vid1 LEFT JOIN s2 ON s2.vid2 = m.vid2 LEFT JOIN c1 ON c1.vid = m.vid1 LEFT JOIN c2 ON c2.vid = m.vid2 LEFT JOIN u1 ON u1.vid = m.vid1 LEFT JOIN u2 ON u2.vid = m.vid2 {keep.replace('vid2', 'm.vid2')}),
 n AS (SELECT *, CASE WHEN vid1 IS NULL OR vid2 IS NULL THEN {{'a': alt1, 'b': ref2, 'c': alt2}} ELSE {_ladder_sql()} END AS n FROM pr),
 o AS (SELECT *, n.b AS r2, list_prepend(ref1, string_split(n.a, ',')) AS old1, list_prepend(n.b, string_split(n.c, ',')) AS old2 FROM n),
 w AS (SELECT *, flatten([[ref1], list_transform(used1, lambda i: old1[i + 1]), list_transform(used2, lambda i: old2[i + 1])]) AS long FROM o),
 k AS (SELECT chrom, pos, vid1, vid2, old1, old2, {new} AS new FROM w)
 {cells}"""


for how in ("intersection", "union"):
    add("merge_checked" if how == "intersection" else "merge_checked_union", "merge_a merge_b", lambda a, b, h=how: combine.merge(a, _turned(b), h, CHECK).select(*CALL), checked_sql(how))
    add("align_checked" if how == "intersection" else "align_checked_union", "merge_b merge_a", lambda b, a, h=how: combine.align(_turned(b), a, h, CHECK).select(*CALL), checked_sql(how, True))
