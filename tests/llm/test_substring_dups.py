"""Removal of repeated passages against every window of every text."""

import hashlib
import random

import numpy as np
from fixtures import SCHEMA, empty, same, tricky

from varloom.llm import substring_dups

L = 50


def brute(rows):
    """rows: (id, text); a null id is larger than all and equals none."""
    order = {}
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), b in zip(rows, raw):
        if i is not None:
            for q in range(len(b) - L + 1):
                s = b[q : q + L]
                order[s] = min(order.get(s, i), i)
    out = []
    for (i, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for q in range(len(b) - L + 1):
            least = order.get(b[q : q + L])
            if least is not None and (i is None or least < i):
                gone[q : q + L] = [True] * L
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(substring_dups.digest(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_tricky(spark):
    docs = tricky(spark)
    same(substring_dups.digest(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_planted(spark):
    """Passages of 48 to 120 bytes in random surroundings, periodic text, overlaps, ties."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghij é\n", k=n))
    passages = [noise(n) for n in (48, 49, 50, 51, 60, 83, 120)]
    texts = [noise(rng.randint(0, 200)) + rng.choice(passages) + noise(rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 5) :] + noise(30) for _ in range(120)]
    texts += ["a" * n for n in (10, 49, 50, 51, 300)] + ["ab" * 80, "x" + "ab" * 60, texts[3], texts[3], passages[6] * 2, passages[6][:70], passages[6][20:90]]
    ids = [rng.randint(0, 10**12) for _ in texts]
    ids[5], ids[6], ids[7] = None, None, ids[8]
    rows = [(i, t, None, None, None, None, None, None) for i, t in zip(ids, texts)]
    got = substring_dups.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    same(got, brute(list(zip(ids, texts))))


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 101, 80).astype(np.uint8)
    found = []
    for n in (0, 7, 300):
        data = np.r_[rng.integers(97, 101, n).astype(np.uint8), passage, rng.integers(97, 101, 40).astype(np.uint8)]
        ok, at, _ = substring_dups.anchors(data, np.array([0, len(data)]))
        found.append((at[n : n + 31] - n).tolist())
    assert found[0] == found[1] == found[2]


def test_empty(spark):
    assert substring_dups.digest(empty(spark)).collect() == []


def test_rerank_over_edges(spark, monkeypatch):
    """Ranks that reach over parts, batches and what a worker holds, against a plain count."""
    for constant, value in (("SORTED_ROWS", 64), ("HELD", 100)):
        monkeypatch.setattr(substring_dups, constant, value)
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 1, *range(2, 400)]), rng.randint(0, 2), rng.randint(0, 5 if k % 2 else 500), k) for k in range(3000)]
    rows += [(500, 7, 3, 9000 + k) for k in range(700)] + [(501, 7, k, 9900 + k) for k in range(700)] + [rows[-1]] * 400
    scratch = substring_dups.Scratch(spark, "test")
    table = scratch.table(spark.createDataFrame(rows, "a long, b long, place long, id long").repartition(7))
    owners = {}
    for a, b, i, _ in rows:
        owners.setdefault((a, b), set()).add(i)
    for keep, wanted in (("all", lambda o, i: True), ("smaller", lambda o, i: i > min(o)), ("several", lambda o, i: len(o) > 1)):
        got = substring_dups.rerank(scratch, table, 15, ["a", "b"], "place", keep, keep).collect()
        same([r[2:4] for r in got], [r[2:] for r in rows if wanted(owners[r[:2]], r[2])])
        assert all(r.a is not None or r.smaller and keep == "all" for r in got)
        got = [r for r in got if r.a is not None]
        assert all(r.smaller == (r.place > min(owners[r.a, r.b])) for r in got)
        ranks = {(r.a, r.b): r["rank"] for r in got}
        assert len({(r.a, r.b, r["rank"]) for r in got}) == len({r["rank"] for r in got}) == len(ranks)


def test_repeated_ids_and_hot_rows(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdef ", k=n))
    passage, hot = noise(90), noise(200)
    rows = [(1, passage + noise(40)), (1, noise(30) + passage), (2, passage), (None, passage), (None, passage + noise(60)), (None, None)]
    rows += [(7, hot)] * 40 + [(8, hot + passage)] * 5 + [(k, noise(20) + hot[k % 50 :] + noise(9)) for k in range(9, 60)]
    docs = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], SCHEMA).repartition(6)
    same(substring_dups.digest(docs).collect(), brute(rows))
