"""Queries on cells and sites: statistics, codecs, allele lists, renderings, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import alleles, codec, qc, stats
from varloom.operators import reshape, select
from varloom.plans.registry import registry
from varloom.sources import vcf

QUERIES, ORACLE_SQL, add = registry()
K = ["vid", "chrom", "pos"]


def _numbered(rows, place, value):
    """``vid``, and the elements of ``p`` with their places.  An inner explode would add a filter
    on the array's size, and so work out the array twice."""
    return rows.select("vid", F.posexplode_outer("p").alias(place, value)).where(F.col(place).isNotNull())


# Pieces of oracle text.
ALTS = "CASE WHEN a0 IS NULL THEN 0 WHEN ploidy = 1 THEN (CASE WHEN a0 > 0 THEN 1 ELSE 0 END) ELSE (CASE WHEN a0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN a1 > 0 THEN 1 ELSE 0 END) END"
SITES = f"""SELECT vid, cidx, chrom, pos, ploidy, ref, alt,
 CAST(sum({ALTS}) AS BIGINT) AS ac, CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an,
 count(*) FILTER (WHERE a0 IS NULL) AS missing, count(*) AS subjects
 FROM calls GROUP BY ALL"""
AF = "CASE WHEN an = 0 THEN 0.0 ELSE CAST(ac AS DOUBLE) / an END"
CODE = "CASE WHEN a0 IS NULL THEN 0 WHEN a0 >= a1 THEN (a0 + 1) * (a0 + 1) - a1 ELSE a1 * a1 + a0 + 1 END"
ALLELES = """SELECT vid, chrom, pos, ploidy, s.alleles, unnest(range(len(s.alleles))) AS allele FROM (SELECT *, list_prepend(ref, string_split(alt, ',')) AS alleles FROM variants) s"""
COUNTS = f"""al AS ({ALLELES}),
 cells AS (SELECT vid, a0 AS a, ploidy FROM calls UNION ALL SELECT vid, a1, ploidy FROM calls WHERE ploidy = 2),
 held AS (SELECT vid, a, count(*) AS n FROM cells WHERE a IS NOT NULL GROUP BY ALL),
 an AS (SELECT vid, CAST(sum(CASE WHEN a0 IS NOT NULL THEN ploidy ELSE 0 END) AS BIGINT) AS an FROM calls GROUP BY vid),
 ac AS (SELECT al.vid, al.chrom, al.pos, CAST(al.allele AS INT) AS allele, CAST(coalesce(held.n, 0) AS BIGINT) AS n, an.an FROM al LEFT JOIN held ON al.vid = held.vid AND al.allele = held.a JOIN an ON al.vid = an.vid)"""

add("site_ac_an_af", "calls", lambda c: stats.site_stats(c).select(*K, "ac", "an", "af"), f"SELECT vid, chrom, pos, ac, an, {AF} AS af FROM ({SITES})")
add("allele_counts", "calls", lambda c: stats.allele_counts(c).select(*K, "allele", "n"), f"WITH {COUNTS} SELECT vid, chrom, pos, allele, n FROM ac")
add(
    "allele_freqs",
    "calls",
    lambda c: stats.allele_counts(c).select(*K, "allele", (F.col("n") / F.nullif("an", F.lit(0))).alias("freq")),
    f"WITH {COUNTS} SELECT vid, chrom, pos, allele, CAST(n AS DOUBLE) / nullif(an, 0) AS freq FROM ac",
)
add(
    "maf",
    "calls",
    lambda c: stats.minor_frequency(c).select(*K, "maf"),
    f"""WITH {COUNTS}, r AS (SELECT vid, chrom, pos, an, list_sort(list(n)) AS ns, CAST(sum(n) FILTER (WHERE allele > 0) AS BIGINT) AS ac FROM ac GROUP BY ALL)
 SELECT vid, chrom, pos, CASE WHEN len(ns) = 2 THEN least({AF}, 1 - {AF}) WHEN an = 0 THEN 0.0 ELSE CAST(ns[len(ns) - 1] AS DOUBLE) / an END AS maf FROM r""",
)
add(
    "missing_stats",
    "calls",
    lambda c: stats.site_stats(c).select(*K, "missing", (F.col("missing") > 0).alias("any_missing")),
    f"SELECT vid, chrom, pos, missing, missing > 0 AS any_missing FROM ({SITES})",
)
add("genotype_counts", "calls", lambda c: stats.genotype_counts(c).select(*K, "code", "n"), f"SELECT vid, chrom, pos, CAST({CODE} AS INT) AS code, count(*) AS n FROM calls GROUP BY ALL")
add("encode_codes", "calls", lambda c: c.select("vid", "sid", codec.encode(F.col("a0"), F.col("a1")).alias("code")), f"SELECT vid, sid, CAST({CODE} AS INT) AS code FROM calls")
add(
    "decode_codes",
    "part",
    lambda p: p.where("p_partkey <= 225").select(F.col("p_partkey").alias("code"), codec.decode(F.col("p_partkey").cast("int")).alias("g")).select("code", "g.a0", "g.a1"),
    """SELECT p_partkey AS code, CAST(i AS INT) AS a0, CAST(j AS INT) AS a1 FROM part
 LEFT JOIN (SELECT i, j, CASE WHEN i >= j THEN (i + 1) * (i + 1) - j ELSE j * j + i + 1 END AS c FROM range(15) t(i), range(15) u(j)) m ON m.c = p_partkey WHERE p_partkey <= 225""",
)


def _unphase(c):
    low, high = codec.unphase(F.col("a0"), F.col("a1"))
    return c.select("vid", "sid", low.alias("a0"), high.alias("a1"))


add("unphase", "calls", _unphase, "SELECT vid, sid, least(a0, a1) AS a0, greatest(a0, a1) AS a1 FROM calls")
add(
    "swap_ref_alt",
    "calls",
    lambda c: c.where(~F.col("alt").contains(",")).select("vid", "sid", codec.swap(codec.encode(F.col("a0"), F.col("a1"))).alias("code")),
    f"SELECT vid, sid, CAST({CODE} AS INT) AS code FROM (SELECT vid, sid, 1 - a0 AS a0, 1 - a1 AS a1 FROM calls WHERE alt NOT LIKE '%,%')",
)


def _packed(phased):
    def build(c):
        low, high = (F.col("a0"), F.col("a1")) if phased else codec.unphase(F.col("a0"), F.col("a1"))
        wide = stats.to_wide(c.where(~F.col("alt").contains(",")).withColumns({"a0": low, "a1": high}))
        packed = wide.select("vid", codec.pack_groups(F.transform("gt", lambda x: x.cast("int")), phased).alias("p"))
        return _numbered(packed, "grp", "packed")

    return build


def _packed_sql(phased):
    base, each = (5, 3) if phased else (4, 4)
    low, high = ("a0", "a1") if phased else ("least(a0, a1)", "greatest(a0, a1)")
    picks = " + ".join(f"coalesce(max(code) FILTER (WHERE k % {each} = {d}), max_by(code, k)) * {base ** (each - 1 - d)}" for d in range(each))
    code = CODE.replace("a0", "x").replace("a1", "y")
    return f"""WITH b AS (SELECT vid, sid, {low} AS x, {high} AS y FROM calls WHERE alt NOT LIKE '%,%'),
 c AS (SELECT vid, {code} AS code, row_number() OVER (PARTITION BY vid ORDER BY sid) - 1 AS k FROM b)
 SELECT vid, CAST(floor(k / {each}) AS INT) AS grp, CAST({picks} AS INT) AS packed FROM c GROUP BY vid, CAST(floor(k / {each}) AS INT)"""


add("group_pack_phased", "calls", _packed(True), _packed_sql(True))
add("group_pack_unphased", "calls", _packed(False), _packed_sql(False))


def _unpacked(c):
    wide = stats.to_wide(c.where(~F.col("alt").contains(",")))
    codes = F.transform("gt", lambda x: x.cast("int"))
    # The array of one keeps the packed form from being worked out for each element.
    back = F.transform(F.array(codec.pack_groups(codes)), lambda p: codec.unpack_groups(p, F.size("gt")))[0]
    return wide.select("vid", "sids", back.alias("b")).select("vid", F.explode(F.arrays_zip("sids", "b")).alias("z")).select("vid", F.col("z.sids").alias("sid"), F.col("z.b").alias("code"))


add("group_unpack_phased", "calls", _unpacked, f"SELECT vid, sid, CAST({CODE} AS INT) AS code FROM calls WHERE alt NOT LIKE '%,%'")
add(
    "two_bit_pack",
    "calls",
    lambda c: _numbered(stats.to_wide(c.where(~F.col("alt").contains(","))).select("vid", codec.pack_two_bits(F.transform("gt", lambda x: x.cast("int")), [0, 0, 1, 3, 2]).alias("p")), "word", "bits"),
    f"""WITH c AS (SELECT vid, {CODE} AS code, row_number() OVER (PARTITION BY vid ORDER BY sid) - 1 AS k FROM calls WHERE alt NOT LIKE '%,%')
 SELECT vid, CAST(floor(k / 16) AS INT) AS word, CAST(sum((CASE code WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 0 END) * CAST(pow(4, k % 16) AS BIGINT)) AS BIGINT) AS bits FROM c GROUP BY ALL""",
)
add("haplotype_accessor", "calls", lambda c: c.where("sid = 7").select("vid", F.col("a0").alias("left_allele"), F.col("a1").alias("right_allele")), "SELECT vid, a0 AS left_allele, a1 AS right_allele FROM calls WHERE sid = 7")
add("complement_alleles", "variants", lambda v: v.select("vid", alleles.complement(F.col("ref")).alias("ref"), alleles.complement(F.col("alt")).alias("alt")), "SELECT vid, translate(ref, 'ACGT', 'TGCA') AS ref, translate(alt, 'ACGT', 'TGCA') AS alt FROM variants")
add("nth_allele", "variants", lambda v: v.select("vid", alleles.nth(F.col("ref"), F.col("alt"), F.lit(2)).alias("allele")), "SELECT vid, list_prepend(ref, string_split(alt, ','))[3] AS allele FROM variants")
add("allele_index", "variants", lambda v: v.select("vid", alleles.index_of(F.col("ref"), F.col("alt"), F.lit("G")).alias("i")), "SELECT vid, CAST(coalesce(list_position(list_prepend(ref, string_split(alt, ',')), 'G'), 0) - 1 AS INT) AS i FROM variants")
add("n_alleles", "variants", lambda v: v.select("vid", alleles.count(F.col("alt")).alias("n")), "SELECT vid, CAST(length(alt) - length(replace(alt, ',', '')) + 2 AS INT) AS n FROM variants")

USED = """u AS (SELECT DISTINCT vid, a FROM (SELECT vid, a0 AS a FROM calls UNION ALL SELECT vid, a1 FROM calls) WHERE a IS NOT NULL),
 old AS (SELECT vid, ref, alt, list_prepend(ref, string_split(alt, ',')) AS al FROM variants),
 us AS (SELECT vid, list(a ORDER BY a) AS used FROM u GROUP BY vid)"""


def _rebased(first: str) -> str:
    """The used alleles after ``first``, in old order, and cells by their new places."""
    return _listed(f"[{first}]")


def _listed(leading: str) -> str:
    """``leading`` and the other used alleles, in old order, and cells by their new places."""
    return f"""WITH {USED},
 n0 AS (SELECT old.vid, al, {leading} AS head, list_transform(coalesce(us.used, []), lambda i: al[i + 1]) AS names FROM old LEFT JOIN us ON old.vid = us.vid),
 n1 AS (SELECT vid, al, list_concat(head, list_filter(names, lambda x: NOT list_contains(head, x))) AS new FROM n0),
 n AS (SELECT vid, al, CASE WHEN len(new) = 0 THEN [al[1]] ELSE new END AS new FROM n1)
 SELECT c.vid, c.sid, n.new[1] AS ref, CASE WHEN len(n.new) = 1 THEN '.' ELSE array_to_string(n.new[2:], ',') END AS alt,
 CAST(list_position(n.new, n.al[c.a0 + 1]) - 1 AS INT) AS a0, CAST(list_position(n.new, n.al[c.a1 + 1]) - 1 AS INT) AS a1
 FROM calls c JOIN n ON c.vid = n.vid"""


CALL = ["vid", "sid", "ref", "alt", "a0", "a1"]
add("simplify_alleles", "calls", lambda c: reshape.simplify(c).select(*CALL), _rebased("al[1]"))
add("reset_alleles", "calls", lambda c: reshape.reset_reference(c, F.split("alt", ",")[0]).select(*CALL), _rebased("al[2]"))
add("simplify_alleles_all", "calls", lambda c: reshape.simplify(c, False).select(*CALL), _listed("CAST([] AS VARCHAR[])"))
add("reset_alleles_with_alts", "calls", lambda c: reshape.reset_reference(c, F.split("alt", ",")[0], F.array(F.lit("TT"), F.col("ref"))).select(*CALL), _listed("[al[2], 'TT', al[1]]"))
add(
    "subject_order",
    "calls",
    lambda c: select.subjects_wide(stats.to_wide(c), [7, 3, 5, 3, 1]).select("vid", F.posexplode(F.arrays_zip("sids", "gt")).alias("k", "c")).select("vid", "k", F.col("c.sids").alias("sid"), F.col("c.gt").cast("int").alias("code")),
    f"SELECT vid, CAST(CASE sid WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS INT) AS k, sid, CAST({CODE} AS INT) AS code FROM calls WHERE sid IN (7, 3, 5, 1)",
)
add("subject_subset", "calls", lambda c: stats.site_stats(select.subjects(c, [31, 3, 14, 15, 9, 3, 26])).select(*K, "ac", "an"), f"SELECT vid, chrom, pos, ac, an FROM ({SITES.replace('GROUP BY', 'WHERE sid IN (3, 9, 14, 15, 26, 31) GROUP BY')})")
add("site_only", "variants", lambda v: v.select("vid", "chrom", "pos", "ref", "alt"), "SELECT vid, chrom, pos, ref, alt FROM variants")

INFO = "'AC=' || ac || ';AN=' || an || ';AF=' || CASE WHEN an = 0 THEN '.' ELSE printf('%.6f', CAST(ac AS DOUBLE) / an) END"
CELL = "CASE WHEN a0 IS NULL THEN CASE WHEN ploidy = 1 THEN '.' ELSE '.|.' END WHEN ploidy = 1 THEN CAST(a0 AS STRING) ELSE a0 || '|' || a1 END"
add(
    "vcf_lines",
    "calls",
    lambda c: vcf.call_lines(c).select("vid", "line"),
    f"""WITH s AS ({SITES}), g AS (SELECT vid, string_agg({CELL}, chr(9) ORDER BY sid) AS cells FROM calls GROUP BY vid)
 SELECT s.vid, concat_ws(chr(9), chrom, pos, '.', ref, alt, '.', '.', {INFO}, 'GT', cells) AS line FROM s JOIN g ON s.vid = g.vid""",
)
add("vcf_site_lines", "calls", lambda c: vcf.site_lines(c).select("vid", "line"), f"WITH s AS ({SITES}) SELECT vid, concat_ws(chr(9), chrom, pos, '.', ref, alt, '.', '.', {INFO}) AS line FROM s")
add(
    "vcf_plain_lines",
    "calls",
    lambda c: vcf.call_lines(c, phased=False, with_info=False).select("vid", "line"),
    f"""WITH s AS ({SITES}), g AS (SELECT vid, string_agg({CELL.replace('|', '/').replace("'/'", "'@'").replace(' // ', ' || ').replace('@', '/')}, chr(9) ORDER BY sid) AS cells FROM calls GROUP BY vid)
 SELECT s.vid, concat_ws(chr(9), chrom, pos, '.', ref, alt, '.', '.', '.', 'GT', cells) AS line FROM s JOIN g ON s.vid = g.vid""",
)


def _listing(c):
    # Calls are read once: a site's sums are those of its codes.
    by_code = c.where(F.col("vid").isNotNull()).withColumn("code", codec.encode(F.col("a0"), F.col("a1"))).groupBy(*stats.SITE, "code").agg(F.count("*").alias("n"), stats.ac().alias("ac"), stats.an().alias("an"))
    sites = by_code.groupBy(*stats.SITE).agg(F.sum("ac").alias("ac"), F.sum("an").alias("an"), F.sort_array(F.collect_list(F.struct("code", "n"))).alias("g"))
    text = F.array_join(F.transform("g", lambda x: F.concat_ws("=", x["code"].cast("string"), x["n"].cast("string"))), ";")
    af = stats.frequency(F.col("ac"), F.col("an"))
    head = F.concat(F.lit("AC="), F.col("ac"), F.lit(";AF="), F.format_string("%.8f", af), F.lit(";AN="), F.col("an"))
    return sites.select(*K, F.concat_ws(";", head, text).alias("listing"))


add(
    "site_listing_gt",
    "calls",
    _listing,
    f"""WITH s AS ({SITES}), n AS (SELECT vid, {CODE} AS code, count(*) AS n FROM calls GROUP BY ALL), g AS (SELECT vid, string_agg(code || '=' || n, ';' ORDER BY code) AS g FROM n GROUP BY vid)
 SELECT s.vid, chrom, pos, 'AC=' || ac || ';AF=' || printf('%.8f', {AF}) || ';AN=' || an || ';' || g AS listing FROM s JOIN g ON s.vid = g.vid""",
)
for name, predicate, sql in (
    ("filter_ac", lambda: qc.ac_between(1, 20), "ac BETWEEN 1 AND 20"),
    ("filter_af", lambda: qc.af_between(0.05, 0.5), "ac >= an * CAST(0.05 AS DOUBLE) AND ac <= an * CAST(0.5 AS DOUBLE)"),
    ("filter_an", lambda: qc.an_between(110, 118), "an BETWEEN 110 AND 118"),
    ("filter_custom", lambda: (F.col("ac") % 2 == 0) & (F.col("an") > 100), "ac % 2 = 0 AND an > 100"),
):
    add(name, "calls", lambda c, p=predicate: qc.sites(c, p()).select(*K, "ac", "an"), f"SELECT vid, chrom, pos, ac, an FROM ({SITES}) WHERE {sql}")
add(
    "qc_genotype",
    "calls_qc",
    lambda c: qc.genotypes(c).select("vid", "sid", "a0", "a1"),
    "SELECT vid, sid, CASE WHEN format <> 'GT' AND (gq < 20 OR dp < 4) THEN NULL ELSE a0 END AS a0, CASE WHEN format <> 'GT' AND (gq < 20 OR dp < 4) THEN NULL ELSE a1 END AS a1 FROM calls_qc",
)
INFO_SQL = "CAST(nullif(regexp_extract(info, '(?:^|;){}=([^;]*)', 1), '') AS DOUBLE)"
add(
    "qc_variant",
    "calls_qc",
    lambda c: qc.variants(c.select("vid", "alt", "qual", "info").distinct(), qual=30, dp=50, mq=20, most_alleles=2).select("vid"),
    f"""WITH v AS (SELECT DISTINCT vid, alt, qual, info FROM calls_qc)
 SELECT vid FROM v WHERE (qual = '.' OR floor(CAST(nullif(qual, '.') AS DOUBLE)) >= 30) AND coalesce({INFO_SQL.format('DP')} >= 50, TRUE) AND coalesce({INFO_SQL.format('MQ')} >= 20, TRUE) AND alt NOT LIKE '%,%'""",
)
add("qc_disabled", "calls_qc", lambda c: qc.variants(c.select("vid", "alt", "qual", "info").distinct(), enabled=False).select("vid"), "SELECT DISTINCT vid FROM calls_qc")
add("wide_ac_an", "calls", lambda c: stats.to_wide(c).select("vid", stats.wide_ac(F.col("gt"), F.col("ploidy")).alias("ac"), stats.wide_an(F.col("gt"), F.col("ploidy")).alias("an")), f"SELECT vid, ac, an FROM ({SITES})")
add("wide_long_round_trip", "calls", lambda c: stats.to_long(stats.to_wide(c)).select("vid", "sid", "a0", "a1"), "SELECT vid, sid, a0, a1 FROM calls")
add(
    "md5_rows",
    "variants",
    lambda v: v.select("vid", F.md5(F.concat_ws("\t", "chrom", "pos", "ref", "alt")).alias("md5")),
    "SELECT vid, md5(concat_ws(chr(9), chrom, pos, ref, alt)) AS md5 FROM variants",
)
add(
    "distinct_variants",
    "calls",
    lambda c: stats.to_wide(c.unionByName(c.withColumn("vid", -F.col("vid") - 1))).dropDuplicates(["chrom", "pos", "ploidy", "ref", "alt", "gt"]).select("chrom", "pos", "ploidy", "ref", "alt", F.size("gt").alias("n")),
    f"WITH w AS (SELECT vid, chrom, pos, ploidy, ref, alt, list({CODE} ORDER BY sid) AS gt FROM calls GROUP BY ALL) SELECT chrom, pos, ploidy, ref, alt, CAST(len(gt) AS INT) AS n FROM (SELECT DISTINCT chrom, pos, ploidy, ref, alt, gt FROM w)",
)
add("distinct_sites", "variants", lambda v: v.dropDuplicates(["chrom", "pos", "ploidy", "ref", "alt"]).select("chrom", "pos", "ploidy", "ref", "alt"), "SELECT DISTINCT chrom, pos, ploidy, ref, alt FROM variants")
add(
    "split_biallelic",
    "calls",
    lambda c: reshape.split_biallelic(c).select("vid", "part", "alt", "sid", "a0", "a1"),
    f"""WITH {USED}, m AS (SELECT vid, list_filter(used, lambda i: i > 0) AS alts FROM us),
 p AS (SELECT old.vid, old.al, CASE WHEN alts IS NULL OR len(alts) = 0 THEN [NULL] ELSE alts END AS alts FROM old LEFT JOIN m ON old.vid = m.vid WHERE old.alt LIKE '%,%'),
 q AS (SELECT vid, al, unnest(alts) AS k FROM p)
 SELECT vid, CAST(1 AS INT) AS part, alt, sid, a0, a1 FROM calls WHERE alt NOT LIKE '%,%'
 UNION ALL SELECT c.vid, CAST(coalesce(k, 1) AS INT), coalesce(al[k + 1], '.'), sid, CAST(a0 = k AS INT), CAST(a1 = k AS INT) FROM calls c JOIN q ON c.vid = q.vid""",
)
JOIN_SQL = f"""WITH {USED},
 o AS (SELECT v.*, old.al, coalesce(us.used, []) AS used, row_number() OVER (PARTITION BY cidx, pos ORDER BY alt_many, length(v.ref) + length(v.alt), v.vid) AS o FROM (SELECT *, alt LIKE '%,%' AS alt_many FROM variants) v JOIN old ON v.vid = old.vid LEFT JOIN us ON v.vid = us.vid),
 g AS (SELECT cidx, chrom, pos, arg_min(vid, o) AS first_vid, arg_min(ref, o) AS first_ref, flatten(list(list_transform(used, lambda i: al[i + 1]) ORDER BY o)) AS names FROM o GROUP BY ALL),
 d AS (SELECT *, list_prepend(first_ref, names) AS long FROM g),
 n AS (SELECT cidx, chrom, pos, first_vid, list_filter(long, lambda x, i: list_position(long, x) = i) AS new FROM d),
 c AS (SELECT c.sid, o.o, n.*, list_position(n.new, o.al[c.a0 + 1]) - 1 AS b0, list_position(n.new, o.al[c.a1 + 1]) - 1 AS b1 FROM calls c JOIN o ON c.vid = o.vid JOIN n ON o.cidx = n.cidx AND o.pos = n.pos)
 SELECT first_vid AS vid, chrom, pos, sid, new[1] AS ref, CASE WHEN len(new) = 1 THEN '.' ELSE array_to_string(new[2:], ',') END AS alt,
 CAST(coalesce(arg_min(b0, o) FILTER (WHERE b0 > 0), min(b0)) AS INT) AS a0, CAST(coalesce(arg_min(b1, o) FILTER (WHERE b1 > 0), min(b1)) AS INT) AS a1
 FROM c GROUP BY first_vid, chrom, pos, sid, new"""
add("join_multiallelic", "calls", lambda c: reshape.join_multiallelic(c).select("vid", "chrom", "pos", "sid", "ref", "alt", "a0", "a1"), JOIN_SQL)
# The fold as a reduction over a list; -1 stands for "no call yet".
FILL = """CASE WHEN x.l <= 0 THEN {'l': CASE WHEN y.l = 0 THEN y.r ELSE y.l END, 'r': CASE WHEN y.l = 0 THEN greatest(x.r, 0) ELSE y.r END}
 ELSE {'l': x.l, 'r': CASE WHEN x.r = 0 THEN CASE WHEN y.l = 0 THEN y.r ELSE y.l END ELSE x.r END} END"""
UNPHASED_SQL = JOIN_SQL[: JOIN_SQL.index(" c AS (SELECT")] + f""" half AS (SELECT vid, sid, least(a0, a1) AS a0, greatest(a0, a1) AS a1 FROM calls),
 c AS (SELECT c.sid, o.o, n.*, CAST(list_position(n.new, o.al[c.a0 + 1]) - 1 AS INT) AS b0, CAST(list_position(n.new, o.al[c.a1 + 1]) - 1 AS INT) AS b1 FROM half c JOIN o ON c.vid = o.vid JOIN n ON o.cidx = n.cidx AND o.pos = n.pos),
 l AS (SELECT first_vid, chrom, pos, sid, new, list({{'l': b0, 'r': b1}} ORDER BY o) FILTER (b0 IS NOT NULL) AS cells FROM c GROUP BY ALL),
 f AS (SELECT *, list_reduce(list_prepend({{'l': CAST(-1 AS INT), 'r': CAST(-1 AS INT)}}, coalesce(cells, [])), lambda x, y: {FILL}) AS g FROM l)
 SELECT first_vid AS vid, chrom, pos, sid, new[1] AS ref, CASE WHEN len(new) = 1 THEN '.' ELSE array_to_string(new[2:], ',') END AS alt, CAST(nullif(g.l, -1) AS INT) AS a0, CAST(nullif(g.r, -1) AS INT) AS a1 FROM f"""
add("join_multiallelic_unphased", "calls", lambda c: reshape.join_multiallelic(c.withColumns(dict(zip(("a0", "a1"), codec.unphase(F.col("a0"), F.col("a1"))))), phased=False).select("vid", "chrom", "pos", "sid", "ref", "alt", "a0", "a1"), UNPHASED_SQL)
