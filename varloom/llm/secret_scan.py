"""Operator 5: secret scans through a trigram inverted index.

From the syntax tree of each rule's regular expression a Boolean query over
trigrams is derived: trigrams that every match must hold.  Each block of
documents gets an inverted index (trigram to documents) over the trigrams that
the queries name; a rule's postings are united and intersected, and only the
candidates are verified with the expression itself.  Rules without mandatory
trigrams scan every document.

Defined results: a null text counts as empty and has no spans; texts are scanned
whole, however long; repeated rows give repeated results; only the named columns
are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import byte_buffer, map_whole_rows, text_chunks, texts


@dataclass(frozen=True)
class Rule:
    """``least`` is the length that group ``group`` of a match must have; shorter
    matches are dropped after they were found, so they still use up their text."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False


# The kinds of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18, True),
    # A run of hex digits is maximal, so asking for 16 at once drops the same runs.
    Rule("hex", r"[0-9a-f]{16,}", 0, 0, 16, True),
)
# Formats that their issuers publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{20,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]{1,64}:[^\s:/@\x22']{6,128}@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (no constraint), a trigram, or ("and"/"or", queries).
Query = None | str | tuple
MOST_STRINGS = 64


def both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else a if a == b else ("and", (a, b))


def any_of(queries: list[Query]) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    unique = tuple(dict.fromkeys(queries))
    return unique[0] if len(unique) == 1 else ("or", unique)


def of_string(s: str) -> Query:
    q: Query = None
    for i in range(len(s) - 2):
        q = both(q, s[i : i + 3])
    return q


def of_strings(strings: set[str]) -> Query:
    return any_of([of_string(s) for s in sorted(strings)])


def analyse(tree, strings: set[str]) -> tuple[set[str], Query]:
    """What may stand right before the end of a match of ``tree`` that follows one
    of ``strings`` (known tails), and the query that holds for it so far.  Strings
    are lower case, as the index is."""
    query: Query = None

    def flush(tails: set[str]) -> set[str]:
        nonlocal query
        query = both(query, of_strings(tails))
        return {""}

    for op, arg in tree:
        if op is C.LITERAL and arg < 128:
            strings = {s + chr(arg).lower() for s in strings}
        elif op is C.IN and (few := small_class(arg)):
            if len(strings) * len(few) > MOST_STRINGS:
                strings = flush(strings)
            strings = {s + c for s in strings for c in few}
        elif op is C.SUBPATTERN:
            strings, more = analyse(arg[-1], strings)
            query = both(query, more)
        elif op is C.BRANCH:
            ends, queries, whole = set(), [], True
            for branch in arg[1]:
                tails, q = analyse(branch, strings)
                ends |= tails
                queries.append(q)
                whole &= q is None
            if not whole:  # a branch has dropped its beginning: what it asked holds for it alone
                query = both(query, any_of([both(q, of_strings(analyse(b, strings)[0])) for q, b in zip(queries, arg[1])]))
                ends = {""}
            strings = ends if len(ends) <= MOST_STRINGS else flush(ends)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            if low == 0 and high == 1:
                tails, q = analyse(body, strings)
                strings = strings | tails if q is None and len(tails) <= MOST_STRINGS else flush(strings)
            else:
                strings = flush(strings)
                if low:
                    tails, q = analyse(body, {""})
                    query = both(query, both(q, of_strings(tails)))
        elif op is not C.AT:
            strings = flush(strings)
    return strings, query


def small_class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL and arg < 128:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] < 128 and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str) -> Query:
    tails, query = analyse(parser.parse(pattern), {""})
    return both(query, of_strings(tails))


def trigrams_of(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else {t for x in q[1] for t in trigrams_of(x)}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        names = sorted({t for q in self.queries for t in trigrams_of(q)})
        self.code = {t: i for i, t in enumerate(names)}
        self.codes = np.array([int.from_bytes(t.encode(), "little") for t in names], dtype=np.int64)
        self.by_code = np.argsort(self.codes)
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[self.codes & 0xFFFF] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def postings(self, batch: pa.RecordBatch, column: int) -> dict[int, np.ndarray]:
        """The inverted index of a batch: documents by trigram, ascending."""
        data, offsets = byte_buffer(batch, column)
        if len(data) < 3 or not len(self.codes):
            return {}
        low = self.lower[data]
        pairs = low[:-2].astype(np.uint16) | (low[1:-1].astype(np.uint16) << 8)
        at = np.flatnonzero(self.begins[pairs])
        code = pairs[at].astype(np.int64) | (low[at + 2].astype(np.int64) << 16)
        slot = np.minimum(np.searchsorted(self.codes[self.by_code], code), len(self.codes) - 1)
        hit = self.codes[self.by_code][slot] == code
        doc = np.searchsorted(offsets, at[hit], side="right") - 1
        which = self.by_code[slot[hit]]
        return {int(t): np.unique(doc[which == t]) for t in np.unique(which)}

    def candidates(self, q: Query, index: dict[int, np.ndarray]) -> np.ndarray:
        if isinstance(q, str):
            return index.get(self.code[q], np.zeros(0, np.int64))
        found = [self.candidates(x, index) for x in q[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if q[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, batch: pa.RecordBatch, column: int = 1) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
        """The texts, and for each its spans (start, rule's number, end), sorted."""
        all_texts = texts(batch, column)
        index = self.postings(batch, column)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in all_texts]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in range(len(all_texts)) if query is None else self.candidates(query, index).tolist():
                for m in regex.finditer(all_texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        for s in spans:
            s.sort()
        return all_texts, spans


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets by document: ``id_col``, ``spans`` (array of kind, start,
    end and whether the kind is a base one), ordered by start, then by rule."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for whole in batches:
            for batch in text_chunks(whole):
                _, spans = s.scan(batch)
                rows = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=[id_col, "spans"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", mark: Callable[[str], str] = lambda kind: f"[{kind}]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with each secret in ``text_col`` replaced by a mark; overlapping spans
    are replaced together, by the mark of the first.  Other columns stay."""
    column = df.columns.index(text_col)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        for a, k, b in spans:
            if a >= end:
                out += [text[end:a], mark(rules[k].kind)]
            end = max(end, b)
        return "".join(out) + text[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for whole in batches:
            for batch in text_chunks(whole, column):
                raw = batch.column(column)
                all_texts, spans = s.scan(batch, column)
                if any(spans):
                    new = [clean(t, x) if x else t for t, x in zip(all_texts, spans)]
                    mask = raw.is_valid().to_pylist()
                    cols = list(batch.columns)
                    cols[column] = pa.array([t if ok else None for t, ok in zip(new, mask)], raw.type)
                    batch = pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
                yield batch

    return map_whole_rows(df, run)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, from the spans that :func:`find` would give."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(RULES)
        kinds = [r.kind for r in RULES]
        n_base = len(BASE_RULES)
        for whole in batches:
            for batch in text_chunks(whole):
                _, spans = s.scan(batch)
                counts = np.zeros((n_base, len(spans)), dtype=np.int64)
                hashes, said = [nothing] * len(spans), [""] * len(spans)
                for i, found in enumerate(spans):
                    if found:
                        for _, k, _ in found:
                            if k < n_base:
                                counts[k, i] += 1
                        named = [(k, f"{kinds[k]}:{a}:{b}") for a, k, b in found]
                        hashes[i] = hashlib.sha256(",".join(x for k, x in named if k < n_base).encode()).hexdigest()
                        said[i] = ",".join(x for _, x in named)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(hashes), pa.array(said)], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
