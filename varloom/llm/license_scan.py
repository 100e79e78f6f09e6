"""Operator 3: licence scans.

An Aho-Corasick automaton runs over each text's words (lower-cased, one space
between) and finds notice phrases and identifier tags in one pass.  What follows
a tag is read as a licence expression: a shunting-yard parser turns it into
postfix order (``with`` binds tighter than ``and``, ``and`` tighter than
``or``) and evaluates it, giving the licences named and the least demanding
terms under which the work can be used.

Defined results: a null text counts as empty; without a match labels are empty
strings, places null and the score 0; equal places of several phrases count each;
an expression that cannot be parsed gives the licences named before the fault;
texts are scanned whole, and expressions to the end of their line, however long; repeated rows give repeated results; only the named
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import text_chunks, texts

# The phrases and labels of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Wording of well-known public licences, by words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "free software foundation either version": "gpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
RAW_TAG = "spdx-license-identifier"
#: Terms by the beginning of an identifier, the longest beginning first; higher numbers ask more.
TERMS = ("permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
FAMILIES = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "cc0": 0, "unlicense": 0, "cc-by": 0, "0bsd": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1,
    "gpl": 2, "agpl": 2, "cc-by-sa": 2,
    "cc-by-nc": 3, "cc-by-nd": 3, "licenseref": 3,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: The same words, and what is left of a line, in bytes decoded one to one.
WORD = re.compile("[0-9A-Za-z\x80-\xff]+")
LINE = re.compile(r"[^\n\r]*")


@dataclass(frozen=True)
class Terms:
    ids: frozenset[str]
    level: int


def terms_of(identifier: str) -> Terms:
    name = identifier.lower().rstrip("+")
    known = [f for f in FAMILIES if name == f or name.startswith(f + "-")]
    return Terms(frozenset([identifier.lower()]), FAMILIES[max(known, key=len)] if known else 4)


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting yard; raises ValueError where the brackets or operands don't fit."""
    out, ops, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in PRECEDENCE:
            if operand:
                raise ValueError("operator without operand")
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("operand before bracket")
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if operand or not ops:
                raise ValueError("bracket without partner")
            ops.pop()
        else:
            if not operand:
                raise ValueError("two operands")
            out.append(t)
            operand = False
    if operand or "(" in ops:
        raise ValueError("unfinished expression")
    return out + ops[::-1]


def evaluate(tokens: list[str]) -> Terms:
    """``or`` lets the user choose the lighter terms, ``and`` binds to the heavier;
    an exception after ``with`` makes copyleft one step lighter."""
    stack: list[tuple[set[str], int]] = []
    for t in to_postfix(tokens):
        if t not in PRECEDENCE:
            one = terms_of(t)
            stack.append((set(one.ids), one.level))
            continue
        (b, of_b), (a, of_a) = stack.pop(), stack.pop()
        if t == "with":
            exception = ",".join(sorted(b))
            stack.append(({f"{i} with {exception}" for i in a}, of_a - 1 if of_a in (1, 2) else of_a))
            continue
        small, large = sorted((a, b), key=len)
        large |= small
        stack.append((large, min(of_a, of_b) if t == "or" else max(of_a, of_b)))
    return Terms(frozenset(stack[0][0]), stack[0][1])


TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
LEAD = re.compile(r"[ \t:=\"']*")


def read_expression(text: str, start: int = 0, end: int | None = None) -> Terms | None:
    """The longest beginning of ``text[start:end]``, a line's rest, that is an expression.
    ``with`` stands between a licence and its exception only."""
    end = len(text) if end is None else end
    tokens, operand, depth, whole = [], True, 0, 0
    for m in TOKEN.finditer(text, LEAD.match(text, start, end).end(), end):
        t = m[0].rstrip(".")
        low = t.lower()
        before = tokens[-1].lower() if tokens else ""
        if t == "(":
            fits = operand and before != "with"
            depth += 1
        elif t == ")":
            fits = not operand and depth > 0
            depth -= 1
        elif low == "with":
            fits = not operand and before != ")" and [x.lower() for x in tokens[-2:-1]] != ["with"]
        else:
            fits = operand != (low in PRECEDENCE)
        if not fits:
            break
        tokens.append(t)
        operand = low in PRECEDENCE or t == "("
        if not operand and depth == 0:
            whole = len(tokens)
    return evaluate(tokens[:whole]) if whole else None


class Scanner:
    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                entries.setdefault(phrase, []).append((kind, label))
        for phrase, what in entries.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.machine.make_automaton()

    def scan(self, text: str) -> dict:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.translate(WORD_BYTES).split()
        out = {"n_words": len(words), "places": [], "labels": set(), "expressions": [], "weights": []}
        if not words:
            return out
        line = f" {b' '.join(words).decode('latin-1')} "
        seen, place, tags = 0, 0, []
        for end, (back, what) in self.machine.iter(line):
            start = end - back  # of the space before the phrase
            place += line.count(" ", seen, start) if start >= seen else -line.count(" ", start, seen)
            seen = start
            for kind, label in what:
                if kind == "base":
                    out["places"].append((place, label))
                    out["weights"].append(0.8)
                elif kind == "notice":
                    out["labels"].add(label)
                    out["weights"].append(0.6)
                else:
                    tags.append(place)
        if tags:
            self.expressions(raw.decode("latin-1"), tags, out)
        return out

    def expressions(self, text: str, tags: list[int], out: dict) -> None:
        """Read what follows each tag; ``tags``: the numbers of their first words."""
        spans = [m.span() for m in WORD.finditer(text)]
        line_end = 0
        for place in tags:
            start, end = spans[place][0], spans[place + len(TAG.split()) - 1][1]
            if text[start:end].lower() != RAW_TAG:
                continue
            if end > line_end or not line_end:
                line_end = LINE.match(text, end).end()
            if found := read_expression(text, end, line_end):
                out["expressions"].append(found)
                out["labels"] |= found.ids | {f"terms:{TERMS[found.level]}"}
                out["weights"].append(0.95)


_SCANNER: list[Scanner] = []


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` (the chance that some match is a real
    notice, taken as independent) and ``terms`` (the heaviest of the expressions,
    null without one)."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for whole in batches:
            for batch in text_chunks(whole):
                rows = []
                for t in texts(batch):
                    x = _SCANNER[0].scan(t)
                    places = [p for p, _ in x["places"]]
                    base = {label for _, label in x["places"]}
                    miss = 1.0
                    for w in x["weights"]:
                        miss *= 1 - w
                    rows.append((x["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | x["labels"])), 1 - miss, TERMS[max(e.level for e in x["expressions"])] if x["expressions"] else None))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "terms"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
