"""Licence, secret and personal-data scans against plain loops over the contract's words."""

import hashlib
import random
import re
import time

import pytest
from fixtures import SCHEMA, empty, same, tricky

from varloom.llm import license_scan, pii, secret_scan
from varloom.llm.secret_scan import MORE_RULES, RULES, Rule, trigram_query


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_secrets(text):
    text = text or ""
    found = {"assign": [], "access": [], "hex": []}
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found["assign"].append(m.span())
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        found[kind] = [m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least]
    kinds = list(found)
    spans = sorted((a, kinds.index(k), b) for k, x in found.items() for a, b in x)
    return (*(len(x) for x in found.values()), sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)))


def all_rules(text):
    spans = [(m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r.pattern, text or "", r.flags) if len(m[r.group]) >= r.least]
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))


def brute_pii(text):
    found = brute_pii_spans(text or "")
    return (*(len(x) for x in found.values()), sha(",".join(f"{k}:{a}:{b}" for k, x in found.items() for a, b in x)))


def brute_pii_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    if not re.search(r"@[A-Za-z0-9-]+[.]", text):
        rules["email"] = ("(?!)", None)  # nothing can match, and the plain pattern is slow to see it
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.fixture(params=["tricky", "sf0.01"])
def docs(request, spark):
    return tricky(spark) if request.param == "tricky" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_secrets(docs):
    got = secret_scan.digest(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    same(got, [(r.doc_id, *brute_secrets(r.text), all_rules(r.text)) for r in docs.collect()])


def test_secret_spans_and_redaction(spark):
    docs = tricky(spark)
    spans = {r.doc_id: r.spans for r in secret_scan.find(docs).collect()}
    assert [s.kind for s in spans[20]] == ["private_key", "jwt", "url_login"]
    kept = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert kept[20].text == "[private_key] [jwt] http[url_login]host/"
    assert kept[0].text is None and kept[1].text == "" and kept[20].score == "x"
    assert secret_scan.redact(docs).columns == docs.columns


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{16,}") is None
    assert trigram_query("abc") == "abc"
    assert trigram_query("ab?c") is None
    assert trigram_query("(?:abcd|x)") is None
    assert trigram_query("AbC.*x") == "abc"
    for r in MORE_RULES:
        assert trigram_query(r.pattern) is not None, r.kind
    assert secret_scan.Scanner((Rule("any", "[xy]+"),)).codes.size == 0


def brute_spans(text):
    """All spans by kind and start, and the highest score."""
    text = text or ""
    found, best = brute_pii_spans(text), None
    iban = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"

    def mod97(s):
        s = s.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    found["iban"] = [m.span() for m in re.finditer(iban, text) if mod97(m[0])]
    for kind, spans in found.items():
        for a, b in spans:
            near = re.search(pii.CONTEXT[kind], (text[max(0, a - pii.NEAR) : a] + " " + text[b : b + pii.NEAR]).lower())
            best = max(best or 0.0, pii.PRIOR[kind] + (1 - pii.PRIOR[kind]) * pii.CONTEXT_GAIN * bool(near))
    return ",".join(f"{k}:{a}:{b}" for k, x in found.items() for a, b in x), best and round(best, 9)


def test_pii(docs):
    got = pii.digest(docs).collect()
    same([r[:6] for r in got], [(r.doc_id, *brute_pii(r.text)) for r in docs.collect()])
    same([(r.doc_id, r.spans, r.max_score and round(r.max_score, 9)) for r in got], [(r.doc_id, *brute_spans(r.text)) for r in docs.collect()])


def test_pii_of_many_matches(spark):
    """Twenty thousand of a kind in one text, wide characters between."""
    texts = ["é🎉, ".join(f"user{k}@mail{k}.example.org" for k in range(20000)), " x ".join(f"10.{k % 256}.7.{k % 250}" for k in range(20000)), "card 4111 1111 1111 1111 漢, " * 20000, "1 2,3 " * 20000]
    docs = spark.createDataFrame([(k, t, None, None, None, None, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    start = time.time()
    got = pii.digest(docs).collect()
    assert time.time() - start < 60
    same([r[:6] for r in got], [(k, *brute_pii(t)) for k, t in enumerate(texts)])
    same([(r.doc_id, r.spans) for r in got], [(k, brute_spans(t)[0]) for k, t in enumerate(texts)])


def test_pii_is_native_and_scores_context(spark):
    found = pii.find(tricky(spark))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    by_id = {r.doc_id: r for r in found.collect()}
    assert [(s.start, s.end) for s in by_id[14].iban] == [(0, 22), (23, 50), (51, 73)]
    cards = by_id[12].card
    assert cards[0].score > pii.PRIOR["card"] and all(0 <= s.score <= 1 for s in cards)


def plain_expression(rest):
    """(ids, level) by recursive descent, from the longest beginning that parses."""
    tokens = [m.rstrip(".") for m in license_scan.TOKEN.findall(re.match("[ \t:=\"']*(.*)", rest)[1])]

    def level(i):
        return license_scan.terms_of(i).level

    def joined(at, names, below):
        got = below(at)
        while got and got[2] < len(tokens) and tokens[got[2]].lower() == names:
            more = below(got[2] + 1)
            if not more:
                break
            got = (got[0] | more[0], (min if names == "or" else max)(got[1], more[1]), more[2])
        return got

    def word(at):
        return at < len(tokens) and tokens[at] not in "()" and tokens[at].lower() not in ("or", "and", "with")

    def atom(at):
        if at < len(tokens) and tokens[at] == "(":
            got = joined(at + 1, "or", lambda a: joined(a, "and", atom))
            return (got[0], got[1], got[2] + 1) if got and got[2] < len(tokens) and tokens[got[2]] == ")" else None
        if not word(at):
            return None
        one = tokens[at].lower()
        if at + 2 < len(tokens) + 0 and tokens[at + 1].lower() == "with" and word(at + 2):
            return {f"{one} with {tokens[at + 2].lower()}"}, level(one) - (level(one) in (1, 2)), at + 3
        return {one}, level(one), at + 1

    got = joined(0, "or", lambda a: joined(a, "and", atom))
    return got and got[:2]


def brute_labels(text):
    """The method's labels, score and terms, by plain searches over words and lines."""
    ascii_low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_low(text or ""))) + " "
    labels, miss = set(), 1.0
    for phrases, weight in ((license_scan.BASE_PHRASES, 0.8), (license_scan.NOTICES, 0.6)):
        for phrase, label in phrases.items():
            n = len(re.findall(f"(?= {re.escape(phrase)} )", words))
            miss *= (1 - weight) ** n
            labels |= {label} if n else set()
    levels = []
    for m in re.finditer(r"(?<![A-Z])(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?i:spdx-license-identifier)(?![A-Z]|[^\x00-\x2F\x3A-\x60\x7B-\x7F])(?=([^\n\r]*))", text or "", re.A):
        if got := plain_expression(m[1]):
            labels |= got[0] | {f"terms:{license_scan.TERMS[got[1]]}"}
            levels.append(got[1])
            miss *= 1 - 0.95
    return ",".join(sorted(labels)), round(1 - miss, 9), license_scan.TERMS[max(levels)] if levels else None


def test_licenses(docs):
    got = license_scan.scan(docs).collect()
    same([r[:6] for r in got], [(r.doc_id, *brute_licenses(r.text)) for r in docs.collect()])
    same([(r.doc_id, r.labels, round(r.score, 9), r.terms) for r in got], [(r.doc_id, *brute_labels(r.text)) for r in docs.collect()])
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_long_and_odd_expressions(spark):
    many = [f"L-{k}.0" for k in range(20000)]
    rng = random.Random(3)
    grown = lambda d: rng.choice(["MIT", "GPL-2.0+", "MPL-2.0", "X-1", "GPL-2.0 WITH a-b"]) if not d else rng.choice([f"({grown(d - 1)})", f"{grown(d - 1)} {rng.choice(['OR', 'and'])} {grown(d - 1)}"])
    texts = [
        "SPDX-License-Identifier: " + " OR ".join(many),
        "spdx-license-identifier: (" + " AND ".join(many) + ")",
        "İstanbul x SPDX-License-Identifier: MIT OR GPL-3.0-only",
        "İ SPDX-License-Identifier=MIT OR\rspdx-LICENSE-identifier (mit) with x, spdx license identifier MIT",
        "SPDX-License-Identifier: MIT " * 300,
        "xSPDX-License-Identifier: MIT SPDX-License-Identifiers: MIT éSPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: a with b with c or d with (e)",
        *(f"// SPDX-License-Identifier: {grown(rng.randint(0, 5))}{rng.choice(['', ' OR', ' x y', ' )', '. And so on'])}\nMIT" for _ in range(300)),
    ]
    rows = [(k, t, None, None, None, None, None, None) for k, t in enumerate(texts)]
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    same([(r.doc_id, r.labels, round(r.score, 9), r.terms) for r in got], [(k, *brute_labels(t)) for k, t in enumerate(texts)])
    assert len(got[0].labels.split(",")) == len(got[1].labels.split(",")) == 20001


def test_license_expressions():
    ev = lambda s: license_scan.read_expression(s)
    assert license_scan.to_postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert ev(": MIT OR GPL-3.0-only").level == 0
    assert ev(": MIT AND GPL-3.0-only").level == 2
    assert ev(": (MIT OR GPL-2.0) AND MPL-2.0").level == 1
    assert ev(": GPL-2.0-only WITH Classpath-exception-2.0").level == 1
    assert ev(": MIT. This file is prose").ids == {"mit"}
    assert ev(": (MIT OR") is None and ev(":") is None
    assert ev(": mit and and").ids == {"mit"}
    with pytest.raises(ValueError):
        license_scan.to_postfix(["(", "a"])


@pytest.mark.parametrize("f", [secret_scan.digest, secret_scan.find, secret_scan.redact, pii.digest, license_scan.scan])
def test_empty_tables(spark, f):
    assert f(empty(spark)).collect() == []
