"""Operator 10: byte-pair encoding and decoding by batched numpy merge rounds.

Words are encoded many at a time: the symbols of all words of a batch lie in
one flat array, each round looks up every adjacent pair by binary search over
the sorted pair keys and merges the pairs of lowest rank in each word.

Defined results: a null text counts as empty; an empty text gives no ids, and
decodes to the empty string; texts of any length are encoded whole; repeated
rows give repeated results; only the named columns are read, so others may have
any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import text_chunks, texts

SPACES = "\t-\r \x85\xa0  -     　"
#: Words that a worker remembers; a full memory is emptied, which only costs time.
CACHE_WORDS = 200_000
NEVER = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """A BPE vocabulary file with word ends, lower case and dropped white space."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.size = max(self.tokens) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = made
        first_use = np.full(self.size, NEVER, dtype=np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        #: Merges whose product takes part only in later merges: all their
        #: occurrences in a word can go in one round.
        self.at_once = first_use[made] > np.arange(len(pairs))
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.split_re = re.compile(f"[{SPACES}]+")
        self.odd_re = re.compile("[\x1c-\x1f]")
        #: Ids and decoded text of words and of the pieces that words are cut into.
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.pieces_known: dict[str, tuple[bytes, str]] = {}

    def pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (UTF-8, not empty) in one array, and where each begins."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            same = word[1:] == word[:-1]
            ranks = np.full(len(sym), NEVER, dtype=np.int64)
            ranks[:-1][same] = self.pair_ranks(sym[:-1][same] * self.size + sym[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            counts = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            over = low == NEVER
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, ranks, low = sym[live], word[live], ranks[live], low[live]
                if not len(sym):
                    break
            at = np.flatnonzero(ranks == low)
            fresh = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            at = at[first | (self.at_once[low[at]] & (run % 2 == 0))]
            sym[at] = self.made[ranks[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        words, syms = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return syms[order], np.r_[0, np.cumsum(np.bincount(words, minlength=len(pieces)))]

    def learn(self, words: set[str]) -> None:
        """Put words (runs without white space) into the memory."""
        pieces_of, known = [], self.pieces_known
        for w in words:
            pieces_of.append((self.ascii_pieces if w.isascii() else self.pieces).findall(w))
        fresh = {p for ps in pieces_of for p in ps}.difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = {p for ps in pieces_of for p in ps}
        if fresh:
            pieces = list(fresh)
            ids, cuts = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
            raw, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
            said = list(map(self.tokens.__getitem__, ids.tolist()))
            for p, a, b in zip(pieces, cuts, cuts[1:]):
                known[p] = (raw[4 * a : 4 * b], " ".join(said[a:b]))
        for w, ps in zip(words, pieces_of):
            if len(ps) == 1:
                self.cache[w] = known[ps[0]]
            else:
                got = [known[p] for p in ps]
                self.cache[w] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.odd_re.search(text):
            return [w for w in self.split_re.split(text) if w]
        return text.split()

    def encode_batch(self, batch: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and what they
        decode to."""
        cut: list[list] = []
        for t in batch:
            if self.special_re and "<|" in t:
                parts = self.special_re.split(t)
                cut.append([("special", p) if i % 2 else ("words", self.words(p)) for i, p in enumerate(parts)])
            else:
                cut.append([("words", self.words(t))])
        fresh = {w for parts in cut for kind, x in parts if kind == "words" for w in x}
        missing = fresh.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = fresh
        if missing:
            self.learn(missing)
        known = self.cache.__getitem__
        for parts in cut:
            out: list[tuple[bytes, str]] = []
            for kind, x in parts:
                if kind == "words":
                    out.extend(map(known, x))
                else:
                    out.append((int(self.special[x]).to_bytes(4, "little"), x))
            yield b"".join([g[0] for g in out]), " ".join([g[1] for g in out])

    def decode(self, ids: list[int]) -> str:
        """Token strings with spaces between; the file names no other decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each text and decode it again.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``with_ids``, ``ids`` (little-endian unsigned 32-bit integers).  ``vocabulary``
    is a path that every executor can open.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for batch in text_chunks(whole):
                n, h, d, raw = [], [], [], []
                for ids, said in bpe.encode_batch(texts(batch)):
                    n.append(len(ids) // 4)
                    h.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(said.encode("utf-8")).hexdigest())
                    if with_ids:
                        raw.append(ids)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
