"""Every registered query against its oracle, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from varloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, connection, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = connection.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == expected


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_listing_reads_calls_once(spark, connection, tmp_path):
    """One pass over calls, no join of its results; null and repeated keys as the SQL has them."""
    connection.execute(f"COPY (SELECT * FROM part UNION ALL SELECT * REPLACE (NULL AS p_partkey) FROM part WHERE p_partkey = 3 UNION ALL SELECT * FROM part WHERE p_partkey = 7) TO '{tmp_path}/part.parquet'")
    connection.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    df = QUERIES["site_listing_gt"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("NestedLoopJoin") == 1
    odd = duckdb.connect()
    for name in ("part", "supplier"):
        odd.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    expected = odd.execute(f"SELECT vid, chrom, pos, listing FROM ({ORACLE_SQL['site_listing_gt']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
