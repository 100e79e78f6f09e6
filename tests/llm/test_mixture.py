"""The mix against a plain calculation of its targets and its words."""

import re
from collections import Counter

import pytest
from fixtures import empty, tricky
from pyspark.sql import functions as F

from varloom.llm import mixture


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: by source; sharing again until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        goal = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if goal[s] > most * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = Counter()
    for r in docs:
        by_source[r.source] += size(r.text)
    goal = brute_targets(dict(by_source))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, size(r.text)) for r in docs)
    source_of = {r.doc_id: r.source for r in docs}
    taken = Counter()
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == by_source[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 1


@pytest.mark.parametrize("block", [1024, 64])
def test_documents(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixture.mix(docs, s=mixture.Settings(block_words=block)).collect()
    check(got, docs.collect())
    assert sorted(got) == sorted(mixture.mix(docs.repartition(3), s=mixture.Settings(block_words=block)).collect())


def test_tricky(spark):
    docs = tricky(spark)
    check(mixture.mix(docs).collect(), docs.collect())


def test_one_source_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d", None), (2, "d", None), (3, None, "z")], "doc_id long, text string, source string")
    check(mixture.mix(docs).collect(), docs.collect())
    assert mixture.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixture.mix(blank).collect()] == [0, 0]


def test_schedule_is_even(spark):
    """In every stretch of the mix each source has nearly its share."""
    from varloom.llm.common import Scratch

    table = spark.createDataFrame([("a", 0, 1, 50000, 60000.0), ("b", 1, 1, 50000, 30000.0), ("c", 2, 1, 50000, 10000.0)], "source string, sid int, docs long, source_size long, target double")
    slots = mixture.schedule(Scratch(spark, "t"), table, mixture.Settings(block_words=100)).orderBy("slot").collect()
    assert [s.turn for s in slots if s.sid == 1] == list(range(300))
    for at in range(100, 1000, 50):
        some = Counter(s.sid for s in slots[:at])
        assert all(abs(some[k] - at * p) < 8 for k, p in enumerate((0.6, 0.3, 0.1)))


def test_repeat_does_not_depend_on_layout(spark, sf):
    """The same rows over 3 and 7 partitions, with columns of the operator's own names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, name in enumerate(("row", "row_", "id", "order", "copies", "times", "size", "__row", "sid")):
        docs = docs.withColumn(name, F.lit(k))
    docs = docs.withColumn("odd.name", F.col("doc_id"))
    runs = [mixture.repeat(docs.repartition(n, F.rand(n))) for n in (3, 7)]
    assert runs[0].columns == runs[1].columns == docs.columns
    a, b = (Counter(map(tuple, r.collect())) for r in runs)
    assert a == b and sum(a.values()) > docs.count() / 2
    odd = tricky(spark)
    assert set(map(tuple, mixture.repeat(odd).collect())) <= set(map(tuple, odd.collect()))
    assert mixture.repeat(empty(spark)).collect() == []
