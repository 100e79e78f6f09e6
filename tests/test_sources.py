"""Variant files, stored tables, side inputs and the streaming append."""

import gzip

import pytest
from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.sources import lists, table, vcf
from varloom.sources.fixtures import derive
from varloom.streaming import append

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def calls(spark):
    return derive(spark, SF, "calls").cache()


def contig_rows(calls):
    return calls.select("chrom", "cidx", "ploidy").distinct()


def test_round_trip(spark, calls, tmp_path):
    subjects = [r.name for r in derive(spark, SF, "subjects").orderBy("sid").collect()]
    head = vcf.header("ref", [("1", 1000), ("X", 0)], subjects)
    vcf.write(vcf.call_lines(calls), f"{tmp_path}/out", head, compressed=False)
    parts = sorted((tmp_path / "out").glob("part-*.txt"))
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.vcf.gz", "wt") as f:
        f.write("".join(p.read_text() for p in parts))
    back = vcf.read(spark, f"{tmp_path}/in", contig_rows(calls))
    key = ["chrom", "pos", "ref", "alt", "name", "a0", "a1"]
    mine = calls.join(derive(spark, SF, "subjects"), "sid")
    assert sorted(map(tuple, back.select(key).collect()), key=str) == sorted(map(tuple, mine.select(key).collect()), key=str)
    assert {(r.chrom, r.length) for r in vcf.contigs(vcf.lines(spark, f"{tmp_path}/in")).collect()} == {("1", 1000), ("X", 0)}


def test_files_are_united(spark, tmp_path):
    top = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.vcf").write_text(top + "s1\ts2\tchr\nchr1\t5\t.\tA\tC\t40\t.\tDP=3\tGT:GQ:DP\t0|1:9:4\t1|1:30\t./.\n9999\t5\t.\tA\tC\t.\t.\t.\tGT\t0\t0\t0\n")
    (tmp_path / "sub" / "b.vcf").write_text(top + "s2\nX\t7\t.\tA\tG,T\t.\t.\t.\tGT\t2\n")
    (tmp_path / "notes.txt").write_text("no")
    known = spark.createDataFrame([("1", 0, 2), ("X", 22, 2)], "chrom string, cidx int, ploidy int")
    got = sorted(((r.chrom, r.pos, r.name, r.a0, r.a1, r.gq, r.dp) for r in vcf.read(spark, str(tmp_path), known).collect()), key=str)
    assert got == sorted([("1", 5, "chr", None, None, None, None), ("1", 5, "s1", 0, 1, 9, 4), ("1", 5, "s2", 1, 1, 30, None), ("X", 7, "s2", 2, 2, None, None), ("X", 7, "s1", None, None, None, None), ("X", 7, "chr", None, None, None, None)], key=str)
    assert sorted({(r.sid, r.name) for r in vcf.read(spark, str(tmp_path), known).collect()}) == [(0, "s1"), (1, "s2"), (2, "chr")]
    (tmp_path / "sub" / "b.vcf").write_text(top + "s2\nX\t7\t.\tA\tG,T\t.\t.\t.\tGT\t15\nX\t7\t.\tA\tG,T\t.\t.\t.\tGT\t15\n")
    twice = vcf.read(spark, str(tmp_path), known).where("chrom = 'X' AND name = 's2'").collect()
    assert len({r.vid for r in twice}) == 2 and all(r.a0 is None for r in twice)  # no code for allele 15
    assert [r.chrom for r in vcf.deep_contigs(vcf.read(spark, str(tmp_path), known)).orderBy("first").collect()] == ["1", "X"]
    (tmp_path / "c.vcf").write_text(top + "other\n")
    with pytest.raises(Exception, match="largest file lacks"):
        vcf.read(spark, str(tmp_path), known).collect()


def test_table(spark, calls, tmp_path):
    path = f"{tmp_path}/t"
    table.write(calls, derive(spark, SF, "subjects"), path, table.Properties(block_size=128, reference="r"))
    t = table.read(spark, path)
    assert t.properties.reference == "r" and t.properties.block_size == 128
    assert tuple(t.describe().first()) == (25, 200, 10)
    key = ["vid", "sid", "a0", "a1"]
    assert sorted(map(tuple, t.calls().select(key).collect()), key=str) == sorted(map(tuple, calls.select(key).collect()), key=str)
    plan = t.sites.where((F.col("chrom") == "7") & F.col("pos").between(100, 400)).select("vid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "PushedFilters: [IsNotNull(pos)" in plan and "gt" not in plan.split("ReadSchema")[1].splitlines()[0]
    table.replace(spark, path, lambda old, new: table.write(old.calls().where("chrom <> 'X'"), old.subjects, new, old.properties))
    assert table.read(spark, path).describe().first().chroms == 24
    assert all(len(r.md5) == 32 for r in table.checksums(spark, path).collect())


def test_lists(spark, tmp_path):
    (tmp_path / "contigs").write_text("##reference=x\n#chromosome,ploidy,length\n1,2,100\nY,1\nZ\n")
    assert [tuple(r) for r in lists.contigs(spark, f"{tmp_path}/contigs").select("chrom", "ploidy", "length", "cidx").collect()] == [("1", 2, 100, 0), ("Y", 1, 0, 1), ("Z", 2, 0, 2)]
    (tmp_path / "names").write_text("a,b\nc, a\n")
    assert sorted(r.name for r in lists.subject_list(spark, f"{tmp_path}/names").collect()) == ["a", "b", "c"]
    (tmp_path / "points").write_text("1,5\n1 5\nX\t9\n# no\n")
    assert sorted(map(tuple, lists.positions(spark, f"{tmp_path}/points").collect())) == [("1", 5), ("X", 9)]
    assert [r.name for r in lists.synthetic_subjects(spark, 3).collect()] == ["S1", "S2", "S3"]
    assert lists.block_selector("chrom=a,b;node=0,2") == [("a", 0), ("a", 2), ("b", 0), ("b", 2)] and lists.block_selector("chrom=a") == [("a", None)]
    with pytest.raises(ValueError):
        lists.block_selector("node=1")


def test_streaming_append(spark, calls, tmp_path):
    calls.where("cidx < 12").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")
    append.append(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    calls.where("cidx >= 12").write.mode("append").parquet(f"{tmp_path}/in")
    append.append(stream(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = stats.to_long(append.read(spark, f"{tmp_path}/out")).select("vid", "sid", "a0", "a1")
    assert got.exceptAll(calls.select("vid", "sid", "a0", "a1")).count() == 0 and got.count() == calls.count()


def test_concat_needs_equal_subjects(spark, calls, tmp_path):
    subjects = derive(spark, SF, "subjects")
    for name, some, properties in (("a", subjects, {}), ("b", subjects.withColumn("name", F.concat("name", F.lit("x"))), {}), ("c", subjects, {"phased": False})):
        table.write(calls.where("cidx < 3"), some, f"{tmp_path}/{name}", table.Properties(**properties))
    a, b, c = (table.read(spark, f"{tmp_path}/{n}") for n in "abc")
    assert table.concat(a, a).sites.count() == a.sites.count()
    for other in (b, c):
        with pytest.raises(ValueError):
            table.concat(a, other)


def test_lines_stay_where_they_are_read(spark, tmp_path):
    """Reading joins by broadcast alone; contigs by arrival and replaced tables leave cells alone."""
    from varloom.plans.catalog import QUERIES
    from varloom.sources import vcf
    from varloom.sources.fixtures import derive

    c, v = derive(spark, "/root/testdata/sf0.001", "calls"), derive(spark, "/root/testdata/sf0.001", "variants")
    vcf.write(vcf.call_lines(c), str(tmp_path / "a.vcf"), vcf.header("r", [("1", 0)], [r.name for r in derive(spark, "/root/testdata/sf0.001", "subjects").orderBy("sid").collect()]), False)
    plan = vcf.read(spark, str(tmp_path), v.select("chrom", "cidx", "ploidy").distinct())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 3
    seen = QUERIES["contig_arrival"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in seen and "row" in seen
