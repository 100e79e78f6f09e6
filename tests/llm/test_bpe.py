"""BPE against the library that reads the same file, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from fixtures import TRICKY, empty, same, tricky

from varloom.llm import bpe

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def check(library, texts):
    ours = bpe.load(PATH)
    theirs = library.encode_batch(texts, add_special_tokens=False)
    for text, (ids, said), r in zip(texts, ours.encode_batch(texts), theirs):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == r.ids, text[:80]
        assert said == library.decode(r.ids, skip_special_tokens=False) == ours.decode(got)


def test_tricky(library):
    check(library, [t or "" for t in TRICKY])


def test_random_strings(library):
    rng = random.Random(0)
    pool = list("ab'sreΣσİßé́ \t\n\x1c\x1f\x85  　漢字1٣²🎉#$%<|>lvm") + ["<|endoftext|>", "'ll", "'s", "aaaa", "hello", "ΑΣ "]
    check(library, ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "$" * 999])


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    rng = random.Random(1)
    check(library, [" ".join("".join(rng.choices("abcde.", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)])


def test_query(spark, library):
    docs = tricky(spark)
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.encode(docs, PATH, with_ids=False).collect(), expected)
    assert bpe.encode(empty(spark), PATH).collect() == []
