"""Embedding links against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import embedding_dups
from varloom.llm.embedding_dups import Forest, Settings


def brute(rows, threshold=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, stack = set(), [i]
        while stack:
            k = stack.pop()
            if k not in group:
                group.add(k)
                stack += links[k]
        seen |= group
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(links[k]), least, rows[k][0] == least)
    return sorted(out, key=str)


def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[40:140] = x[0] + rng.normal(size=(100, 16)) * 0.05  # a dense group
    x[140:160] = x[1]  # copies
    x[160:170] = x[2] * 3  # same direction
    for i in range(171, 200):  # a chain
        x[i] = x[i - 1] + rng.normal(size=16) * 0.12
    rows = [(i, v.astype(np.float32).tolist(), int(i % 2 == 0 or i < 200), "x") for i, v in enumerate(x)]
    rows += [(400, None, 1, "x"), (401, [0.0] * 16, 1, "x"), (402, [None] + [1.0] * 15, 1, "x"), (403, [float("nan")] * 16, 1, "x"), (404, x[0].tolist(), None, "x")]
    rows += [(405, [], 1, "x"), (406, [1.0, 2.0], 1, "x"), (407, [1.0, 2.0], 1, "x"), (None, x[5].tolist(), 1, "x"), (0, x[0].tolist(), 1, "x"), (408, [3e38] * 16, 1, "x"), (409, [1e-38] * 16, 1, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


@pytest.mark.parametrize("chunk", [4096, 32])
def test_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dups, "CHUNK", chunk)
    df = spark.createDataFrame(sample(), SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    got = embedding_dups.find(df, s=Settings(leaf_rows=40, trees=6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert embedding_dups.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embedding_dups.unit(rng.normal(size=(4000, 64)))
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = embedding_dups.unit(x * 0.981 + embedding_dups.unit(side) * np.sqrt(1 - 0.981**2))
    forest = Forest(np.vstack([x, y]), 8000, Settings(leaf_rows=64))
    a, b = forest.cells(x), forest.cells(y)
    found = set(zip(*a)) & set(zip(*b))
    assert len({i for i, _ in found}) > 0.97 * len(x)


def test_crowded_leaves_are_split_again(spark, monkeypatch):
    """First trees of few, wide leaves: their own trees must thin them out, and lose no more
    than the trees may; a dense group stays whole."""
    monkeypatch.setattr(embedding_dups, "CHUNK", 128)
    monkeypatch.setattr(embedding_dups, "OWN_SAMPLE", 256)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[1500:2800] = x[:1300] + rng.normal(size=(1300, 32)) * 0.13  # near the threshold
    x[2800:] = x[0] + rng.normal(size=(200, 32)) * 0.02
    df = spark.createDataFrame([(i, v.tolist(), i % 2 if i < 100 else 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    sizes, dense = [], embedding_dups.unit(x[:1])[0]
    whole = embedding_dups.refine

    def most(placed):
        """Rows of the largest leaf without a row of the dense group."""
        leaves = {}
        for r in placed.collect():
            for c in r.cells:
                leaves.setdefault((r.label, c), []).append(np.dot(embedding_dups.unit(np.array([r.v]))[0], dense) > 0.95)
        return max(len(held) for held in leaves.values() if not any(held))

    def watched(scratch, placed, s):
        sizes.append(most(placed))
        placed, crowded = whole(scratch, placed, s)
        sizes.append(most(placed))
        counted = placed.selectExpr("label", "size(v) AS n", "explode(cells) AS cell").groupBy("label", "n", "cell").agg(F.count("*").alias("rows")).where("rows > 128")
        assert sorted(counted.collect()) == sorted(crowded.select(counted.columns).collect())
        return placed, crowded

    monkeypatch.setattr(embedding_dups, "refine", watched)
    got = {r.vec_id: r for r in embedding_dups.find(df, s=Settings(sample=32, leaf_rows=64)).collect()}
    u = embedding_dups.unit(x)
    label = np.array([i % 2 if i < 100 else 1 for i in range(len(x))])
    links = ((u @ u.T >= 0.98) & (label[:, None] == label[None])).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and links.sum() > 40_000
    single = links < 100
    assert links[single].sum() > 1000 and found[single].sum() >= 0.98 * links[single].sum() and found.sum() >= 0.999 * links.sum()
    assert sizes[0] > 300 and sizes[1] <= 128


def test_packed_trees_are_the_same():
    x = embedding_dups.unit(np.random.default_rng(1).normal(size=(500, 8)))
    tree = embedding_dups.Tree.grown(x, 20, 0.01, (1, 2, 3))
    again = embedding_dups.Tree.unpacked(tree.packed(), 8, 0.01, (1, 2, 3))
    assert len(tree.nodes) > 10 and all((a == b).all() for a, b in zip(tree.leaves_of(x), again.leaves_of(x)))
