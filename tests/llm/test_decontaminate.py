from __future__ import annotations

import random
import re

from quillon.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=10):
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(n, len(w))
        runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                ids.add(str(item_id))
    return len(own), sorted(hit), sorted(ids)


def tables(spark):
    draw = random.Random(5)
    vocabulary = ["ab", "Cd", "É", "é", "x1", "漢字", "İ", "the", "of"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, " .!? "), (10, "ab ab")]
    items = [r for r in items if len(words(r[1])) != 1] + [(60, "rare")]
    docs = []
    for i in range(80):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(60)))
        if i % 3 == 0:
            text += ", " + (draw.choice(items)[1] or "")
        docs.append((i, text.upper() if i % 7 == 0 else text))
    docs += [(204, "so RARE, it is"), (200, None), (201, ""), (None, items[0][1]), (202, items[1][1]), (202, items[1][1]), (203, "-" * 50_000 + items[2][1])]
    return docs, items


def test_scan_against_brute_force(spark):
    docs, items = tables(spark)
    wide = spark.createDataFrame([(*d, "h", 1) for d in docs], DOCS + ", hash string, at int")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, list(r.hits), list(r["items"])) for r in dc.scan(wide, spark.createDataFrame(items, ITEMS)).collect())
    assert found == sorted((d if d is not None else -1, *brute(t, items)) for d, t in docs)


def test_clean(spark):
    docs, items = tables(spark)
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = dc.clean(table, bench)
    assert whole.columns == ["doc_id", "text"]
    assert sorted(map(str, whole.collect())) == sorted(map(str, [r for r in table.collect() if not brute(r.text, items)[1]]))
    left = {r.doc_id: r.text for r in dc.clean(table, bench, remove="spans").collect()}
    for doc_id, text in docs:
        _, hits, _ = brute(text, items)
        if hits:
            assert words(left[doc_id]) == [w for i, w in enumerate(words(text)) if i not in hits]
        else:
            assert left[doc_id] == text


def test_shuffled_join_and_empty_tables(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(dc, "MAX_BROADCAST", 0)
    monkeypatch.setattr(dc, "MAX_PLACES", 0)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, list(r.hits), list(r["items"])) for r in dc.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())
    assert found == sorted((d if d is not None else -1, *brute(t, items)) for d, t in docs)
    assert dc.scan(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert dc.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).where("size(hits) > 0").count() == 0


def test_names_that_clash(spark):
    docs, items = tables(spark)
    odd = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], DOCS + ", row_key string, `a``b` int, hits int")
    for remove in ("documents", "spans"):
        left = dc.clean(odd, spark.createDataFrame(items, ITEMS), remove=remove)
        assert left.columns == odd.columns and {(r.row_key, r["a`b"], r.hits) for r in left.collect()} == {("k", 1, 2)}
        assert dc.clean(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS), remove=remove).count() == 0
