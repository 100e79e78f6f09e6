"""The pipeline's stages, each against a plain version of what it decides."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import tricky
from pyspark.sql import functions as F
from test_simhash import brute_kept

import corpus_pipeline
from varloom.llm import bpe, quality, secret_scan
from varloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark, "test")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.table(stage(spark, out[-1], SF)))
    return out


def test_shape(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for docs in stages[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema == stages[0].schema


def test_quality(spark, stages):
    scores = quality.classify(spark, stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in scores if r.predicted == 1)


def test_near_duplicates(stages):
    expected, close = brute_kept([(r.doc_id, r.text) for r in stages[1].collect()])
    kept = {r.doc_id for r in stages[2].collect()}
    assert len(kept ^ set(expected)) <= len(close)


def test_secrets(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        old = before.pop(r.doc_id)
        spans = [m.span() for rule in secret_scan.RULES for m in re.finditer(rule.pattern, old.text or "", rule.flags) if len(m[rule.group]) >= rule.least]
        if not spans:
            assert r == old
        else:
            assert all(old.text[a:b] not in r.text for a, b in spans if b - a > 20) and r.n_chars == len(r.text)
    assert not before


def test_mixture(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = stages[3].collect(), stages[4].collect()
    assert set(after) <= set(before) and max(Counter(r.doc_id for r in after).values()) <= 2
    total = sum(size(r.text) for r in before)
    assert abs(sum(size(r.text) for r in after) - 1.5 * total) < 0.15 * total


def test_encoding(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.vocabulary())
    expected = Counter()
    for r in stages[4].collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += 1
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == expected
    for r in rows[:20]:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert hashlib.sha256(bpe.load(corpus_pipeline.vocabulary()).decode(ids).encode()).hexdigest() == r.decoded_sha256


def test_odd_input(spark):
    """Null, empty and very long texts, null ids and sources, repeated rows, clashing names."""
    docs = tricky(spark)
    for name in ("row", "id", "order", "copies", "group", "x", "held_out", "__row", "odd.name"):
        docs = docs.withColumn(name, F.lit(name))
    everything = docs.count()
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality classifier":
            assert stage(spark, docs, SF).columns == docs.columns  # it may reject all of these
            continue
        after = scratch.table(stage(spark, docs, SF))
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        if name == "secret scans":
            assert after.count() == docs.count()
        docs = after
    assert 0 < docs.count() <= 2 * everything
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == docs.count() and encoded.columns[:2] == ["doc_id", "n_tokens"]


def test_run_and_empty(spark, stages, tmp_path):
    a = Counter(map(tuple, corpus_pipeline.run(spark, SF).drop("ids").collect()))
    assert a == Counter(map(tuple, stages[5].drop("ids").collect()))
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
