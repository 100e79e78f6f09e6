"""The classifier's held-out accuracy, its risk's parts, and odd input."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import empty, tricky

from varloom.llm import quality


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return {r.doc_id: r for r in quality.classify(spark, docs, labels).collect()}, {r.doc_id: r.quality for r in labels.collect()}


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [(rows[i], y) for i, y in labels.items() if rows[i].held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert np.mean([r.predicted == 1 for r, y in held if y == 1]) > 0.98
    good, bad = [r.score for r, y in held if y == 1], [r.score for r, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_contract(scored):
    rows, _ = scored
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_negatives_and_held_out_labels_are_never_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    turned = labels.selectExpr("doc_id", f"case when {held} then 1 - quality when quality = 0 then -7 else quality end as quality")
    one = sorted(quality.classify(spark, docs, labels).collect())
    two = sorted(quality.classify(spark, docs, turned).collect())
    assert [(r.doc_id, r.predicted) for r in one] == [(r.doc_id, r.predicted) for r in two]
    assert np.allclose([r.score for r in one], [r.score for r in two])


def test_prior_estimate():
    rng = np.random.default_rng(0)
    positive = rng.beta(8, 2, 5000)
    everything = np.r_[rng.beta(8, 2, 70000), rng.beta(2, 8, 30000)]
    histogram = np.histogram(everything, bins=200, range=(0, 1))[0]
    assert abs(quality.estimate_prior(positive, histogram, 0.5) - 0.7) < 0.05


def test_basis_is_a_partition():
    x = np.random.default_rng(1).normal(size=(50, len(quality.FEATURES))).astype(np.float32)
    b = quality.basis(x)
    assert b.shape == (50, quality.WIDTH) and np.allclose(b[:, 1:].sum(axis=1), len(quality.FEATURES)) and (b >= -1e-12).all()


def test_odd_input(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(6, 12)] + [(None, 1)], "doc_id long, quality int")
    docs = tricky(spark)
    got = quality.classify(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert quality.classify(spark, empty(spark), labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(spark, docs, none).collect()} == {0.5}
    assert quality.keep(spark, docs, none).columns == docs.columns


def plain_features(text):
    raw, words = (text or "").encode(), (text or "").split()
    share = lambda ok: sum(map(ok, raw)) / max(1, len(raw))
    upper, lower = (sum(a <= c <= z for c in raw) for a, z in ((65, 90), (97, 122)))
    counts = [words.count(w) for w in words] if len(words) < 400 else list(Counter(words).values())
    distinct, lines = len(set(words)), [x for x in (text or "").split("\n") if x]
    none = not words
    return {
        "log_chars": math.log(1 + len(raw)),
        "word_length": 0 if none else (len(text) - len(words) + 1) / len(words),
        "upper": upper / max(1, upper + lower),
        "symbols": share(lambda c: chr(c) in "!#$%&*+/<=>@[\\]^_`{|}~"),
        "marks": share(lambda c: chr(c) in ".,;:'\"-()?"),
        "digits": share(lambda c: 48 <= c <= 57),
        "spaces": share(lambda c: c in (9, 10, 11, 12, 13, 32)),
        "distinct": 0 if none else distinct / len(words),
        "growth": 0 if none else math.log(1 + distinct) / math.log(1 + len(words)),
        "top_word": 0 if none else max(counts) / len(words),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines and not none else 0,
        "same_start": 0 if none else sum(w.isalpha() for w in words) / len(words),
    }


def plain_basis(values):
    """A constant and the hat functions of each feature, one by one."""
    out = [1.0]
    for name, knots in quality.KNOTS.items():
        x = min(max(values[name], knots[0]), knots[-1])
        for i, k in enumerate(knots):
            left = knots[i - 1] if i else k - 1
            right = knots[i + 1] if i + 1 < len(knots) else k + 1
            out.append(max(0.0, 1 - (x - k) / (right - k)) if x >= k else max(0.0, 1 - (k - x) / (k - left)))
    return out


def test_against_plain_loops(spark, sf):
    """Features, the risk's minimum and the scores, by loops over all training rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    table = quality.feature_table(docs, "doc_id", "text").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in table.collect():
        assert np.allclose(np.frombuffer(r.x, "<f4"), list(plain_features(texts[r.id]).values()), atol=1e-5)
    settings = quality.Settings(steps=40)
    model = quality.fit(spark, table, labels, settings=settings)
    x = {i: np.array(plain_basis(plain_features(t))) for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    train = np.array([x[i] for i in texts if i not in held])
    trusted = np.array([x[r.doc_id] for r in labels.collect() if r.quality == 1 and r.doc_id not in held])
    loss = lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0)

    def risk(w):
        p, u = trusted @ w, train @ w
        negative = loss(-u).mean() - model.prior * loss(-p).mean()
        return model.prior * loss(p).mean() + max(0.0, negative) + settings.ridge / 2 * w @ w, negative

    best, negative = risk(model.weights)
    assert negative > 0
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 0.3):
        for _ in range(50):
            step = rng.normal(size=len(model.weights))
            assert risk(model.weights + size * step / np.linalg.norm(step))[0] >= best - 1e-7
    for r in quality.score(table, model).collect():
        assert abs(r.score - 1 / (1 + math.exp(-x[r.doc_id] @ model.weights))) < 1e-4
        assert r.held_out == (r.doc_id in held) and r.predicted == int(r.score >= 0.3)


def test_keep_with_any_columns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.selectExpr("*", "1 as id", "2 as x", "3 as held_out", "4 as score", "5 as predicted", "6 as quality")
    kept = quality.keep(spark, odd, labels)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.classify(spark, docs, labels).collect() if r.predicted)
