"""Genotype tables derived from the driver's star schema by one SQL text that both
Spark and the oracle run: parts are variants, the first sixty suppliers subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v0": """SELECT p_partkey AS vid, CAST(p_partkey % 25 AS INT) AS cidx,
 CASE WHEN p_partkey % 25 < 22 THEN CAST(p_partkey % 25 + 1 AS STRING) WHEN p_partkey % 25 = 22 THEN 'X' WHEN p_partkey % 25 = 23 THEN 'Y' ELSE 'MT' END AS chrom,
 CAST(CASE WHEN p_partkey % 25 = 23 THEN 1 ELSE 2 END AS INT) AS ploidy,
 CAST(floor(p_partkey / 25) AS BIGINT) AS idx,
 CAST((floor(p_partkey / 25) - CASE WHEN CAST(floor(p_partkey / 25) AS BIGINT) % 9 = 8 THEN 1 ELSE 0 END) * 100 + 17 AS BIGINT) AS pos
FROM part""",
    "variants": """SELECT vid, cidx, chrom, ploidy, idx, pos,
 substr('ACGT', CAST(1 + (pos + cidx) % 4 AS INT), 1) AS ref,
 CASE WHEN vid % 10 = 0 THEN concat(substr('ACGT', CAST(1 + (pos + cidx + 1 + vid % 3) % 4 AS INT), 1), ',', substr('ACGT', CAST(1 + (pos + cidx + 1 + (vid + 1) % 3) % 4 AS INT), 1))
  ELSE substr('ACGT', CAST(1 + (pos + cidx + 1 + vid % 3) % 4 AS INT), 1) END AS alt
FROM v0""",
    "subjects": "SELECT s_suppkey AS sid, s_name AS name FROM supplier WHERE s_suppkey < 60",
    "calls": """SELECT vid, cidx, chrom, ploidy, idx, pos, ref, alt, s_suppkey AS sid,
 CASE WHEN (vid*31 + s_suppkey*17) % 23 = 0 THEN NULL ELSE CAST(a0 AS INT) END AS a0,
 CASE WHEN (vid*31 + s_suppkey*17) % 23 = 0 THEN NULL WHEN ploidy = 1 THEN CAST(a0 AS INT) ELSE CAST(a1 AS INT) END AS a1
FROM (SELECT v.*, s_suppkey,
 CASE WHEN vid % 12 = 11 THEN 0 WHEN vid % 12 = 5 THEN (CASE WHEN (s_suppkey + vid) % 30 = 0 THEN 1 ELSE 0 END)
  WHEN vid % 10 = 0 AND (vid + s_suppkey) % 7 = 0 THEN 2
  ELSE ((CASE WHEN (CAST(floor(idx / 8) AS BIGINT)*7 + s_suppkey*13) % 11 < 4 THEN 1 ELSE 0 END) + (CASE WHEN (vid*13 + s_suppkey*29) % 31 = 0 THEN 1 ELSE 0 END)) % 2 END AS a0,
 CASE WHEN vid % 12 IN (5, 11) THEN 0
  ELSE ((CASE WHEN (CAST(floor(idx / 8) AS BIGINT)*5 + s_suppkey*3) % 13 < 5 THEN 1 ELSE 0 END) + (CASE WHEN (vid*19 + s_suppkey*23) % 37 = 0 THEN 1 ELSE 0 END)) % 2 END AS a1
 FROM variants v CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 60) s) t""",
    "calls_qc": """SELECT vid, chrom, pos, ploidy, ref, alt, sid, a0, a1,
 CAST((vid*7 + sid*11) % 60 AS INT) AS gq, CAST((vid*3 + sid*5) % 20 AS INT) AS dp,
 CASE WHEN vid % 17 = 0 THEN '.' ELSE CAST(vid % 70 AS STRING) END AS qual,
 CASE WHEN vid % 19 = 0 THEN '.' WHEN vid % 5 = 0 THEN concat('AC=3;MQ=', CAST(vid % 45 AS STRING)) ELSE concat('DP=', CAST(vid % 300 AS STRING), ';MQ=', CAST(vid % 45 AS STRING), ';AN=8') END AS info,
 CASE WHEN vid % 13 = 0 THEN 'GT' ELSE 'GT:GQ:DP' END AS format
FROM calls""",
    "merge_a": "SELECT * FROM calls WHERE sid % 2 = 0 AND vid % 5 <> 4",
    "merge_b": """SELECT vid, cidx, chrom, ploidy, idx, pos,
 CASE WHEN alt LIKE '%,%' THEN ref WHEN vid % 4 = 1 THEN alt WHEN vid % 4 = 2 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
 CASE WHEN alt LIKE '%,%' THEN alt WHEN vid % 4 = 1 THEN ref WHEN vid % 4 = 2 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt,
 sid,
 CASE WHEN alt NOT LIKE '%,%' AND vid % 4 = 1 THEN 1 - a0 ELSE a0 END AS a0,
 CASE WHEN alt NOT LIKE '%,%' AND vid % 4 = 1 THEN 1 - a1 ELSE a1 END AS a1
FROM calls WHERE sid % 2 = 1 AND vid % 7 <> 6""",
    "blocks": """SELECT vid, cidx, chrom, ploidy, idx, pos, ref, alt,
 CAST(floor((row_number() OVER (PARTITION BY cidx ORDER BY pos, vid) - 1) / 16) AS BIGINT) AS block_id
FROM variants""",
}
NEEDS = {
    "v0": ["part"], "variants": ["v0"], "subjects": ["supplier"], "calls": ["variants", "supplier"], "calls_qc": ["calls"],
    "merge_a": ["calls"], "merge_b": ["calls"], "blocks": ["variants"],
}


#: Variants that a task turns into calls.  A file of parts is small, what comes of it sixty
#: times as many rows, so tasks are counted by variants and not by the file's size.
SHARE = 8192


def dealt(variants: DataFrame, rows: int) -> DataFrame:
    """Variants dealt by ``vid`` to as many tasks as ``rows`` asks for.  Calls keep the deal, so
    whatever is grouped by site needs no exchange of cells."""
    return variants.repartition(max(1, -(-rows // SHARE)), "vid")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame; nothing is registered in the catalog."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: derive(spark, sf_dir, n) for n in NEEDS[name]}
    if name == "calls":
        inputs["variants"] = dealt(inputs["variants"], derive(spark, sf_dir, "part").count())
        inputs["supplier"] = inputs["supplier"].hint("broadcast")  # sixty rows at most
    for n in inputs:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **inputs)


def with_views(names: list[str], sql: str) -> str:
    """The oracle's text: the views that ``names`` need, then ``sql``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in NEEDS[n]:
                visit(m)
            order.append(n)

    for n in names:
        visit(n)
    head, rest = ("WITH RECURSIVE ", sql[len("RECURSIVE ") :]) if sql.startswith("RECURSIVE ") else ("WITH ", sql)
    if not order:
        return sql
    return head + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + (",\n" + rest[len("WITH ") :] if rest.startswith("WITH ") else "\n" + rest)
