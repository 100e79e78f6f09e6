"""Queries by coordinate: selection, order, blocks, and edits on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.operators import blocks, reshape, select
from varloom.plans.registry import registry
from varloom.sources import vcf

QUERIES, ORACLE_SQL, add = registry()
V = ["vid", "chrom", "pos"]
SIZE = 16  # sites of a block, here as in the derived view


def formed(v):
    return blocks.form(v, SIZE)


add("range_query", "variants", lambda v: select.between(v, "7", 1017, 5017).select(*V), "SELECT vid, chrom, pos FROM variants WHERE chrom = '7' AND pos BETWEEN 1017 AND 5017")
add("range_open_end", "variants", lambda v: select.between(v, "X", start=3017).select(*V), "SELECT vid, chrom, pos FROM variants WHERE chrom = 'X' AND pos >= 3017")
add("chrom_query", "variants", lambda v: select.chroms(v, ["3", "Y", "MT"]).select(*V), "SELECT vid, chrom, pos FROM variants WHERE chrom IN ('3', 'Y', 'MT')")
add("points_query", "variants", lambda v: select.points(v, v.where("vid % 37 = 0")).select(*V), "SELECT vid, chrom, pos FROM variants v WHERE EXISTS (SELECT 1 FROM variants w WHERE w.vid % 37 = 0 AND w.chrom = v.chrom AND w.pos = v.pos)")


def _chosen(v):
    return v.where("vid < 30").select("chrom", F.when(F.col("vid") % 3 == 0, F.lit(None)).otherwise(F.col("vid") % 2).cast("long").alias("block_id"))


CHOSEN = "chosen AS (SELECT chrom, CASE WHEN vid % 3 = 0 THEN NULL ELSE vid % 2 END AS block_id FROM variants WHERE vid < 30)"
HIT = "EXISTS (SELECT 1 FROM chosen c WHERE c.chrom = b.chrom AND (c.block_id IS NULL OR c.block_id = b.block_id))"
add("block_query", "variants blocks", lambda v, b: select.blocks(formed(v), _chosen(v)).select(*V, "block_id"), f"WITH {CHOSEN} SELECT vid, chrom, pos, block_id FROM blocks b WHERE {HIT}")
add("block_delete", "variants blocks", lambda v, b: select.without_blocks(formed(v), _chosen(v)).select(*V, "block_id"), f"WITH {CHOSEN} SELECT vid, chrom, pos, block_id FROM blocks b WHERE NOT {HIT}")
add("seek_first_ge", "variants", lambda v: select.ordered(select.seek(v, 4, 6950)).select(*V), "SELECT vid, chrom, pos FROM variants WHERE cidx > 4 OR (cidx = 4 AND pos >= 6950)")
add("node_range", "variants blocks", lambda v, b: select.node_range(formed(v), "3", 1, 3).select(*V, "block_id"), "SELECT vid, chrom, pos, block_id FROM blocks WHERE chrom = '3' AND block_id >= 1 AND block_id < 3")
add("cursor_resume", "variants", lambda v: select.resume(v, select.tell(select.ordered(v).limit(100))).select(*V), "SELECT vid, chrom, pos FROM (SELECT *, row_number() OVER (ORDER BY cidx, pos, alt LIKE '%,%', length(ref) + length(alt), vid) AS n FROM variants) WHERE n > 100")
add("skip_limit", "variants", lambda v: select.skip(v, 100).limit(50).select(*V), "SELECT vid, chrom, pos FROM variants ORDER BY cidx, pos, alt LIKE '%,%', length(ref) + length(alt), vid LIMIT 50 OFFSET 100")
add(
    "group_by_coordinate",
    "variants",
    lambda v: select.at_coordinates(v).select("chrom", "pos", "n", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["vid"].cast("string"), s["ref"], s["alt"])), ";").alias("sites")),
    "SELECT chrom, pos, count(*) AS n, string_agg(vid || ':' || ref || ':' || alt, ';' ORDER BY vid) AS sites FROM variants GROUP BY ALL",
)
add("sorted_scan", "variants", lambda v: select.ordered(v).select(*V, "alt"), "SELECT vid, chrom, pos, alt FROM variants ORDER BY cidx, pos, alt LIKE '%,%', length(ref) + length(alt), vid")
STATS = "bs AS (SELECT cidx, chrom, block_id, min(pos) AS min_pos, max(pos) AS max_pos, count(*) FILTER (WHERE alt NOT LIKE '%,%') AS biallelic, count(*) FILTER (WHERE alt LIKE '%,%') AS multiallelic FROM blocks GROUP BY ALL)"
add("form_blocks", "variants blocks", lambda v, b: formed(v).select("vid", "block_id"), "SELECT vid, block_id FROM blocks")
add("block_stats", "variants blocks", lambda v, b: blocks.stats(formed(v)), f"WITH {STATS} SELECT * FROM bs")
add("chrom_summary", "variants blocks", lambda v, b: blocks.by_chrom(blocks.stats(formed(v))), f"WITH {STATS} SELECT chrom, min(min_pos) AS min_pos, max(max_pos) AS max_pos, count(*) AS blocks, CAST(sum(biallelic + multiallelic) AS BIGINT) AS variants FROM bs GROUP BY chrom")
add(
    "file_summary",
    "variants subjects",
    lambda v, s: v.agg(F.count_distinct("chrom").alias("chroms"), F.count("*").alias("variants")).join(s.agg(F.count("*").alias("subjects")), F.lit(True)),
    "SELECT (SELECT count(DISTINCT chrom) FROM variants) AS chroms, (SELECT count(*) FROM variants) AS variants, (SELECT count(*) FROM subjects) AS subjects",
)
add("block_bytes", "variants blocks", lambda v, b: blocks.decoded_bytes(blocks.stats(formed(v)), 60), f"WITH {STATS} SELECT max((biallelic + multiallelic) * 60) AS most_bytes FROM bs")
add("ordered_check", "variants blocks", lambda v, b: blocks.is_ordered(blocks.stats(formed(v))), f"WITH {STATS}, n AS (SELECT chrom, max_pos, lead(min_pos) OVER (PARTITION BY chrom ORDER BY block_id) AS nx FROM bs) SELECT chrom, bool_and(nx IS NULL OR max_pos <= nx) AS ordered FROM n GROUP BY chrom")
add("find_block", "variants blocks", lambda v, b: blocks.find(blocks.stats(formed(v)), "5", 2017).select("chrom", "block_id"), f"WITH {STATS} SELECT chrom, block_id FROM bs WHERE chrom = '5' AND min_pos <= 2017 AND max_pos >= 2017")
add("range_blocks", "variants blocks", lambda v, b: blocks.intersects(blocks.stats(formed(v)), "5", 1000, 3000).select("chrom", "block_id"), f"WITH {STATS} SELECT chrom, block_id FROM bs WHERE chrom = '5' AND min_pos <= 3000 AND max_pos >= 1000")


def _similar(c, v):
    wide = stats.to_wide(c).join(formed(v).select("vid", "block_id"), "vid")
    return blocks.similarity_order(wide, 4).select("vid", F.col("rank").cast("long").alias("rank"))


CODE = "CASE WHEN a0 IS NULL THEN 0 WHEN a0 >= a1 THEN (a0 + 1) * (a0 + 1) - a1 ELSE a1 * a1 + a0 + 1 END"
add(
    "similarity_order",
    "calls variants blocks",
    lambda c, v, b: _similar(c, v),
    f"""WITH k AS (SELECT vid, {CODE} AS code, row_number() OVER (PARTITION BY vid ORDER BY sid) - 1 AS k, count(*) OVER (PARTITION BY vid) AS n FROM calls),
 e AS (SELECT vid, CAST(floor(k / ceil(n / 4)) AS INT) AS w, sum(code * (ceil(n / 4) - k % CAST(ceil(n / 4) AS BIGINT))) AS f FROM k GROUP BY ALL),
 fs AS (SELECT vid, list(CAST(f AS BIGINT) ORDER BY w) AS f FROM e GROUP BY vid),
 o AS (SELECT b.vid, b.cidx, b.block_id, alt LIKE '%,%' AS many, f FROM blocks b JOIN fs ON b.vid = fs.vid)
 SELECT vid, row_number() OVER (PARTITION BY cidx, block_id ORDER BY many, CASE WHEN many THEN f ELSE list_transform(f, lambda x: -x) END, vid) AS rank FROM o""",
)
add("contig_deep_scan", "variants", lambda v: vcf.deep_contigs(v), "SELECT chrom, min(vid) AS first, CAST(2 AS INT) AS ploidy, CAST(0 AS BIGINT) AS length FROM variants GROUP BY chrom")


def _contigs(v):
    return v.where("cidx % 4 <> 1").select("chrom", (100 - F.col("cidx")).cast("int").alias("cidx")).distinct()


add("reset_contig", "variants", lambda v: blocks.reset_contigs(v, _contigs(v)).select("vid", "cidx", "chrom"), "SELECT vid, CAST(100 - cidx AS INT) AS cidx, chrom FROM variants WHERE cidx % 4 <> 1")
add("concat", "variants", lambda v: blocks.concat(v.where("cidx <= 12"), v.where("cidx >= 10")).select("vid", "chrom", "pos", "ref", "alt"), "SELECT vid, chrom, pos, ref, alt FROM variants")
add("unique_blocks", "variants blocks", lambda v, b: blocks.unique(blocks.concat(blocks.stats(formed(v)), blocks.stats(formed(v)))).select("chrom", "min_pos", "max_pos", "biallelic", "multiallelic"), f"WITH {STATS} SELECT DISTINCT chrom, min_pos, max_pos, biallelic, multiallelic FROM bs")
add("rename_subjects", "subjects", lambda s: blocks.rename_subjects(s, s.select("sid", F.concat(F.lit("S"), F.col("sid")).alias("name"))), "SELECT sid, 'S' || sid AS name FROM subjects")
add("resolve_subjects", "subjects", lambda s: select.resolve(s.select("name"), s, "name").select("name", "sid"), "SELECT name, sid FROM subjects")
add("resolve_contigs", "variants", lambda v: select.resolve(v.select("vid", "chrom"), v.select("chrom", "cidx").distinct(), "chrom").select("vid", "cidx"), "SELECT vid, cidx FROM variants")
add(
    "unify_subjects",
    "calls subjects",
    lambda c, s: reshape.unify_subjects(c.where("(vid + sid) % 3 <> 0"), s).select("vid", "sid", "a0", "a1"),
    "SELECT v.vid, s.sid, c.a0, c.a1 FROM (SELECT DISTINCT vid FROM calls WHERE (vid + sid) % 3 <> 0) v CROSS JOIN subjects s LEFT JOIN (SELECT * FROM calls WHERE (vid + sid) % 3 <> 0) c ON c.vid = v.vid AND c.sid = s.sid",
)
add("contains_chrom", "variants", lambda v: v.groupBy("chrom").agg(F.count("*").alias("n")).where(F.col("chrom").isin("1", "X", "none")), "SELECT chrom, count(*) AS n FROM variants WHERE chrom IN ('1', 'X', 'none') GROUP BY chrom")
