from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """Scores of every document for every item, by the definition."""
    words = [cut(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for own in words for w in set(own))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), own in zip(docs, words, strict=True):
            tf, m = Counter(own), 100 - 25 + (25 * len(own) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in cut(text) if tf[w])
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out += [(item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id long, text string, score int, `n.o` string")
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, no int")
    return sorted((tuple(r) for r in lexical.search(d, q, **how).collect()), key=str)


@pytest.mark.parametrize("max_terms", [1_000_000, 40])
def test_ranks_are_those_of_brute_force(spark, monkeypatch, max_terms):
    draw = random.Random(3)
    words = ["the", "The", "ÉTÉ", "été", "naïve", "x1", "2024", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(draw.choices(words, [9] * 4 + [1] * (len(words) - 4), k=draw.choice([0, 1, 3, 40, 300])))) for i in range(120)]
    docs += [(200 + i, "same words in all of these") for i in range(40)] + [(500, None), (501, "...")]
    items = [(i, ", ".join(draw.choices(words, k=9))) for i in range(15)] + [(20, "same same words"), (21, None), (22, ""), (23, "nowhere"), (24, "the")]
    monkeypatch.setattr(lexical, "IMPACTS", 100)  # many small blocks in a task
    assert found(spark, docs, items, max_terms=max_terms) == brute(docs, items)
    assert found(spark, docs, items, top=3) == brute(docs, items, 3)


def test_nulls_repeats_and_ties(spark):
    docs = [(4, "a b"), (4, "a b"), (None, "a b"), (2, "a b"), (7, "c " * 30_000 + "a")]
    items = [(1, "A"), (1, "A"), (None, "c a"), (3, "a a")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_radix_order():
    draw = np.random.default_rng(1)
    for most in (1, 70_000, 2**40):
        keys = draw.integers(0, most, 5000)
        assert (radix := lexical.radix_order(keys, most)).tolist() == np.argsort(keys, kind="stable").tolist() and len(radix) == 5000
