"""Operator 9: personal data, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (octets, Luhn, mod 97,
digit counts), and words nearby adjust each span's score.  Places of matches come
from splitting a text by the same expression: the lengths of the pieces between
and of the matches add up to the places, in code points.

The expressions are the contract's, written for Java so that they keep their
matches but stay linear and use no stack: repeats whose end is fixed by the class
are possessive, and a match cannot begin inside a run that has already failed
(``\\G`` still lets one begin where the last ended).

Defined results: a null text counts as empty and has no spans; texts are scanned
whole; ties of place between kinds keep the listed order; repeated rows give
repeated results; only the named columns are read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's kinds in its order, then the method's own.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
#: A text without this cannot match; saves the expression's run.
NEEDS = {"email": "@", "phone": "+"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: How sure a confirmed span is by itself, and words that make it surer.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "address|host|server|login|client",
    "card": "card|visa|credit|debit|payment|expir",
    "phone": "phone|call|tel|mobile|fax|number",
    "iban": "iban|bank|account|transfer",
}
NEAR = 48
#: Code points of the blocks in which the surroundings of spans are looked up.
BLOCK = 512
CONTEXT_GAIN = 0.5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.length(d) - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(d, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(d, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number passes the check of ISO 7064 (letters count from 10)."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: F.when(
            F.substring(turned, i, F.lit(1)).rlike("[0-9]"), (acc * 10 + F.try_to_number(F.substring(turned, i, F.lit(1)), F.lit("9")).cast("int")) % 97
        ).otherwise((acc * 100 + F.ascii(F.substring(turned, i, F.lit(1))) - 55) % 97),
    )
    return F.length(bare).between(15, 34) & (rest == 1)


def octets(m: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(m, "[.]"), lambda x: (F.length(bare(x)) <= 3) & (F.when(F.length(bare(x)).between(1, 3), bare(x).cast("int")).otherwise(F.lit(0)) <= 255))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "iban": mod97,
}


def proposals(text: Column, kind: str) -> Column:
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in NEEDS:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return found


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(steps: Column) -> Column:
    """Running sums of a non-empty array, by chunks of about the square root of its size:
    a fold that grows an array copies it at each step, so it had better be short."""
    total = lambda x, start: F.aggregate(
        x,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out")),
    )["out"]

    def chunked(chunks: Column) -> Column:
        ends = total(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, v: acc + v)), F.lit(0))
        return bound(ends, lambda ends: F.flatten(F.transform(chunks, lambda c, i: total(c, F.coalesce(F.get(ends, i - 1), F.lit(0))))))

    size = F.ceil(F.sqrt(F.size(steps))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda i: F.slice(steps, i * size + 1, size))
    return bound(chunks, chunked)


def spans_of(text: Column, matches: Column, kind: str) -> Column:
    """Confirmed spans of a kind from its matches: array of kind, start, end, score."""
    gaps = F.transform(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(matches)), F.length)
    steps = F.zip_with(gaps, matches, lambda gap, m: gap + F.length(m))
    placed = F.zip_with(bound(steps, running), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))
    confirmed = F.filter(placed, lambda s: CHECKS[kind](s["text"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    scored = lambda spans: F.when(F.size(spans) > 0, bound(blocks, lambda b: F.transform(spans, lambda s: _scored(b, s, kind))))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.coalesce(F.when(F.size(matches) > 0, bound(confirmed, scored)), none)


def _piece(blocks: Column, start: Column, length: Column) -> Column:
    """At most ``BLOCK`` code points of a text in blocks; finding them does not walk the text."""
    at = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return F.substring(two, start - at * BLOCK + 1, length)


def _scored(blocks: Column, s: Column, kind: str) -> Column:
    before = _piece(blocks, F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["start"], F.lit(NEAR)))
    after = _piece(blocks, s["end"], F.lit(NEAR))
    near = F.lower(F.concat(before, F.lit(" "), after)).rlike(CONTEXT[kind])
    score = F.lit(PRIOR[kind]) + F.when(near, (1 - PRIOR[kind]) * CONTEXT_GAIN).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its spans by kind: columns ``id_col`` and one array of structs
    (kind, start, end, score) for each kind, by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    proposed = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *(proposals(F.col("text"), k).alias(f"m_{k}") for k in PATTERNS))
    return proposed.select(F.col("id").alias(id_col), *(spans_of(F.col("text"), F.col(f"m_{k}"), k).alias(k) for k in PATTERNS))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, and the highest score of a span (null without one)."""
    found = find(df, id_col, text_col)
    named = lambda kinds: F.array_join(F.transform(F.concat(*(F.col(k) for k in kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(named(BASE_KINDS), 256).alias("base_sha256"),
        named(PATTERNS).alias("spans"),
        F.array_max(F.transform(F.concat(*(F.col(k) for k in PATTERNS)), lambda s: s["score"])).alias("max_score"),
    )
