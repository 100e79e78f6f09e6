"""SimHash clusters against all pairs."""

import re

import numpy as np
from fixtures import empty, same, tricky
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from varloom.llm import simhash
from varloom.llm.common import Scratch
from varloom.llm.components import connected_components


def brute_fingerprint(text, each=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    x = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= radius
    todo = set(label)
    while todo:
        group, stack = set(), [todo.pop()]
        while stack:
            i = stack.pop()
            group.add(i)
            stack += [int(j) for j in np.flatnonzero(near[i]) if int(j) not in group]
        todo -= group
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            label[i] = min(ids, default=None)
    return [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, label)]


def test_tricky(spark):
    docs = tricky(spark)
    same(simhash.digest(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(simhash.digest(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_block_keys_miss_nothing():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks()
    for _ in range(300):
        flips = rng.choice(64, 3, replace=False)
        assert any(all(not m >> int(k) & 1 for k in flips) for m in masks)


def test_trees_against_all_pairs():
    rng = np.random.default_rng(0)
    x = [0]
    for _ in range(600):
        x.append(x[int(rng.integers(len(x)))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    x = np.unique(np.array(x, dtype=np.uint64))
    group = np.sort(rng.integers(0, 3, len(x)))
    got = simhash.near_in_groups(group, x, 3)
    near = (np.bitwise_count(x[:, None] ^ x[None]) <= 3) & (group[:, None] == group[None])
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (got == label).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (139, 350)]
    got = {r.node: r.root for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 141), 350]}, **{i: 0 for i in range(30)}, 200: 200, 201: 200}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(Scratch(spark, "t"), none).collect() == []


def brute_kept(rows, similarity=0.8):
    """Ids that stay: the least of each group of texts alike by their sets of five words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = []
    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            s = len(sets[i] & sets[j]) / union if union else 1.0
            pairs.append((s, i, j))
            if s >= similarity:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(least.values()), [p for p in pairs if 0.74 < p[0] < 0.86]


def test_keep_one(spark):
    docs = tricky(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected, close = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert not close
    assert sorted(i for i in ids if i is not None) == expected and ids.count(None) == 1


def test_keep_one_of_planted_copies(spark, sf):
    """Copies with a word in forty changed go; documents unlike all others stay."""
    rng = np.random.default_rng(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for k in range(60):
        words = " ".join(f"w{rng.integers(500)}" for _ in range(rng.integers(60, 700))).split()
        docs.append((10_000 + k, " ".join(words)))
        copy = list(words)
        for at in range(int(rng.integers(40)), len(copy), 60):
            copy[at] = f"x{rng.integers(10**6)}"
        docs.append((20_000 + k, "  ".join(copy) + "\n"))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected, close = brute_kept(docs)
    ids = [d for d, _ in docs]
    unsure = {ids[i] for _, i, j in close} | {ids[j] for _, i, j in close}
    assert kept ^ set(expected) <= unsure
    assert {10_000 + k for k in range(60)} <= kept and len(kept & {20_000 + k for k in range(60)}) <= len(unsure)


def test_empty(spark):
    assert simhash.digest(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []


def test_crowded_shards(spark, monkeypatch):
    """A large group of near copies, cut into chunks, is still one group."""
    monkeypatch.setattr(simhash, "CROWD", 32)
    rng = np.random.default_rng(8)
    words = [f"w{rng.integers(900)}" for _ in range(400)]
    docs = []
    for k in range(300):
        copy = list(words)
        copy[int(rng.integers(400))] = f"x{k}"
        docs.append((k, " ".join(copy)))
    docs += [(1000 + k, " ".join(f"y{rng.integers(10**6)}" for _ in range(50))) for k in range(40)]
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == [0, *range(1000, 1040)]


def edited(rng, words, places, name):
    copy = list(words)
    for at in places:
        copy[int(at)] = f"{name}x{rng.integers(10**9)}"
    return " ".join(copy)


def star(rng, copies, name="o"):
    """An original and copies of it, alike to it by 0.8 but not to each other."""
    words = [f"{name}{rng.integers(10**6)}" for _ in range(300)]
    return " ".join(words), [edited(rng, words, np.arange(6) * 48 + 5 + rng.integers(0, 40), f"{name}{k}") for k in range(copies)]


def kept_ids(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    return sorted(r.doc_id for r in simhash.keep_one(df).collect())


def test_copies_alike_to_a_later_original_only(spark):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(4):
        original, copies = star(rng, 12, f"g{g}o")
        docs += [(100 * g + k, t) for k, t in enumerate([*copies, original])]
    expected, _ = brute_kept(docs)
    assert expected == [0, 100, 200, 300]
    assert kept_ids(spark, docs) == expected


def test_large_groups_of_copies_alike_to_few(spark, monkeypatch):
    """Groups of many chunks: two around an original, and a chain of texts that are alike
    to the next ones only."""
    for name, value in (("CROWD", 16), ("CHUNK", 8), ("WIDE", 12), ("HUBS", 2)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng = np.random.default_rng(4)
    original, copies = star(rng, 150)
    docs = [(k, t) for k, t in enumerate([*copies[:80], original, *copies[80:]])]
    words = [f"c{k}" for k in range(300)]
    for k in range(60):
        docs.append((1000 + (k * 37) % 60, " ".join(words)))
        for at in (k * 5 % 300, (k * 5 + 150) % 300):
            words[at] = f"n{k}x{at}"
    many, some = star(rng, 40, "p")
    docs += [(2000 + k, t) for k, t in enumerate([*some, many])]
    docs += [(3000 + k, " ".join(f"y{rng.integers(10**6)}" for _ in range(50))) for k in range(20)]
    expected, _ = brute_kept(docs)
    assert kept_ids(spark, docs) == expected


def test_long_texts_just_above_and_below(spark):
    """596 shingles each: 13 words changed leave 0.803 alike, 14 leave 0.790."""
    rng = np.random.default_rng(5)
    docs = []
    for k in range(40):
        words = [f"w{rng.integers(10**6)}" for _ in range(600)]
        docs += [(10 * k, " ".join(words)), (10 * k + 1, edited(rng, words, np.arange(13 + k % 2) * 42 + 7, f"e{k}"))]
    expected, _ = brute_kept(docs)
    assert len(expected) == 60
    assert kept_ids(spark, docs) == expected


def test_lines_repeated_more_or_less_often(spark):
    rng = np.random.default_rng(7)
    docs = []
    for k in range(16):
        prose = " ".join(f"w{rng.integers(10**6)}" for _ in range(304))
        line = " ".join(f"l{rng.integers(10**6)}" for _ in range(12))
        docs += [(10 * k + at, " ".join([prose, *[line] * times])) for at, times in enumerate((2, 40))]
    assert kept_ids(spark, docs) == [10 * k for k in range(16)]


def test_keep_one_with_any_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    for k, name in enumerate(("row", "row_", "id", "of", "group", "root", "best", "__row", "odd.name")):
        docs = docs.withColumn(name, F.lit(k))
    got = simhash.keep_one(docs.repartition(7, F.rand(1)))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == expected


def test_hot_block_keys(spark, monkeypatch):
    """Many fingerprints that agree in most blocks, over more than one part of a shard."""
    monkeypatch.setattr(simhash, "CROWD", 50)
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 12, 600).astype(np.int64) << 40)
    scratch = simhash.Scratch(spark, "test")
    points = scratch.table(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(scratch, points).collect():
        parent[root(r.a)] = root(r.b)
    for i, x in enumerate(fps.tolist()):
        for y in fps[i + 1 :].tolist():
            if bin(x ^ y).count("1") <= 3:
                assert root(x) == root(y)
