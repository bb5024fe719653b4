from __future__ import annotations

import random
import re

import pytest

from quillon.llm import secrets

SCHEMA = "doc_id long, text string"


def brute(text):
    spans = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.removeprefix("(?i)")
        flags = re.ASCII | (re.IGNORECASE if rule.pattern != pattern else 0)
        spans += [(m.start(), number, m.end()) for m in re.compile(pattern, flags).finditer(text or "") if len(m[rule.group]) >= rule.least]
    return sorted(spans)


def test_against_brute_force(spark):
    draw = random.Random(4)
    parts = ["password = ", "Token:", "api_key='", "APIKEY=", "secret=token : ", "abcdef12", "x", "é", "漢", "\n", " ", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "0123456789abcdef" * 2, "ghp_" + "a1" * 18,
             "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.eyJabcdefghi.sig", "AIza" + "x" * 35, "xoxb-123456789012", "sk_live_" + "9" * 16, '"', "'"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(25)))) for i in range(300)] + [(301, None), (302, ""), (None, "password=hunter22")]
    rows += [(303, "token=abcdefgh")] * 3
    wide = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", rule int, row_key string")
    found = sorted((r.doc_id or -1, [tuple(s) for s in r.spans]) for r in secrets.found_spans(wide).collect())
    assert found == sorted((d or -1, brute(t)) for d, t in rows)


def test_queries_are_mandatory():
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query(r"abc?d") == frozenset({frozenset({"abc", "bcd"}), frozenset({"abd"})})
    assert secrets.trigram_query(r"(foo|[xyz]+)bar") != secrets.ANY
    assert secrets.trigram_query(r"(?:ab|c\x44)e{1}[^q]fgh{0,2}.ijk") == frozenset({frozenset({"abe", "ijk"}), frozenset({"cde", "ijk"})})
    assert secrets.trigram_query(r"x{3}abc|q") == secrets.ANY and secrets.trigram_query(r"(abc)+d*") == frozenset({frozenset({"abc"})})
    for bad in (r"(?=abc)", r"^abc", r"\babc"):
        with pytest.raises(ValueError):
            secrets.trigram_query(bad)
    for rule in secrets.RULES[:2] + secrets.RULES[3:]:
        assert secrets.trigram_query(rule.pattern) != secrets.ANY


def test_empty(spark):
    assert secrets.found_spans(spark.createDataFrame([], SCHEMA)).count() == 0
