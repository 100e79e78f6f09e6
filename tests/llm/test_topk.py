"""Top-k search against all products."""

import math
import random
from fractions import Fraction

import numpy as np
from fixtures import same
from pyspark.sql import functions as F

from varloom.llm import topk


def brute(rows, k=5, mod=3):
    """Every row but the query's own is a candidate; integers of any size."""
    exact = lambda x: math.floor(Fraction(x) * 256)
    vectors = [(i, [exact(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(vectors):
        if i is not None and i % mod == 0:
            sums = [(sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(vectors) if other != at and len(v) == len(q)]
            sums = sorted((-max(min(s, 2**63 - 1), -(2**63)), j is None, j) for s, j in sums)
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sums[:k])]
    return out


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score string")
    return list(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0).collect()))


def test_search(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 40)), 1).astype(np.float32)
    x[50:80] = x[0]  # ties
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows += [(900, None, 0, "x"), (903, [1.0, None] * 20, 0, "x"), (906, [float("nan")] * 40, 0, "x"), (909, [float("inf")] * 40, 0, "x"), (912, [1.0, 2.0], 0, "x"), (915, [2.0, 2.0], 0, "x")]
    rows += [(None, [1.0] * 40, 0, "x"), (3, x[3].tolist(), 0, "x"), (918, [3e38] * 40, 0, "x"), (921, [], 0, "x")]
    same(run(spark, rows), brute([(r[0], r[1]) for r in rows]))


def test_large_components_and_repeated_ids(spark):
    """Values beyond 2 ** 24 and beyond a long, rows of one id, candidates without one."""
    rng = random.Random(4)
    rows = [(3, [1.0, 2.0]), (4, [1e6, 0.0]), (5, [7e4, 0.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (6, [1e300, -1e300]), (7, [1e300, 1.0]), (8, [-1e17, 3.3e15])]
    rows += [(None, [9e5, 1.0]), (None, [1.0, 9e9]), (9, [2.0**53 + 2, -1.0]), (12, [1e6, 1e6])]
    rows += [(100 + k, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 8) for _ in range(2)]) for k in range(200)]
    same(run(spark, [(*r, 0, "x") for r in rows], "double"), brute(rows))


def test_shards_and_floors(spark, monkeypatch):
    for constant, value in (("SHARD_VALUES", 700), ("SAMPLE_VALUES", 400), ("STEP", 16), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(topk, constant, value)
    rng = np.random.default_rng(1)
    rows = [(i, (v + 3 * (i % 4)).tolist()) for i, v in enumerate(np.round(rng.normal(size=(300, 35)), 2))]
    same(run(spark, [(*r, 0, "x") for r in rows], "double"), brute(rows))


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0, 2.0], 0, "x")]) == []
    assert run(spark, [(3, [1.0, 2.0], 0, "x"), (4, [-1.0, 2.5], 0, "x")]) == [(3, 1, 4, -256 * 256 + 512 * 640)]


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(2)
    c = rng.integers(-500, 500, (3000, 64))
    c[:200] = c[0] + rng.integers(-3, 3, (200, 64))
    q = c[:20]
    best = topk.Best(20, 5)
    names = np.arange(3000)
    for a in range(0, 3000, 1000):
        part = slice(a, a + 1000)
        topk.search(best, np.full(20, -np.inf), topk.Block(names[:20], names[:20], q / 256), topk.Block(names[part], names[part], c[part] / 256))
    for j in range(20):
        s = c @ q[j]
        s[j] = -(10**15)
        order = np.lexsort((np.arange(3000), -s))[:5]
        assert (best.id[j] == order).all() and (best.score[j] == s[order]).all()
