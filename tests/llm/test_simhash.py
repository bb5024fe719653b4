from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from quillon.llm import simhash as sh

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [(d, f, min((fps[k][0] for k in range(len(fps)) if group[k] == group[i] and fps[k][0] is not None), default=None)) for i, (d, f) in enumerate(fps)]


def test_groups_against_brute_force(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = []
    for g in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 30, 300]))]
        for _ in range(draw.choice([1, 2, 6, 25])):
            own = list(base)
            for _ in range(draw.randrange(3)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((len(rows) * 2 + g, " ".join(own).upper() if draw.random() < 0.2 else "  ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "one two"), (None, "one two"), (903, rows[0][1]), (903, rows[0][1])]
    wide = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", fp int, component_id int")
    found = [(r.doc_id, r.fp % 2**64, r.component_id) for r in sh.near_duplicates(wide).collect()]
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    assert sorted(found, key=key) == sorted(brute_components(rows), key=key)


def shingles_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {text or ""}


def brute_wide(text):
    """Both wide fingerprints, bit by bit in Python's own numbers."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) or [text or ""]
    own, whole = [xxhash.xxh64_intdigest(w.encode()) for w in words], 2**64

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    out = []
    for size, longs in ((2, 2), (5, 4)):
        k, sums = min(size, len(own)), set()
        for i in range(len(own) - k + 1):
            total = 0
            for h in own[i : i + k]:
                total = (total * 0x9E3779B97F4A7C15 + h) % whole
            sums.add(mixed(total))
        for j in range(1, longs + 1):
            sent = [mixed((h + j * 0x632BE59BD9B4E019) % whole) for h in sums]
            out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in sent) > len(sent)))
    return out


def test_wide_fingerprint_against_brute_force():
    draw = random.Random(10)
    texts = [None, "", "...", "One", "a b", "Ä ö, ä Ö! x-y " * 3] + [" ".join(draw.choice(["w%d" % i for i in range(40)]) for _ in range(n)) for n in (4, 5, 6, 300, 900)]
    for t in texts:
        assert sh.wide_fingerprint(t.encode() if t is not None else None).tolist() == brute_wide(t)
    long = " ".join(f"w{i}" for i in range(17_000))
    assert sh.wide_fingerprint(long.encode()).tolist() == brute_wide(long)


def test_near_copies_against_brute_force(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in [1, 3, 12, 60, 60, 200, 200, 700, 2000] * 3:
        base = [draw.choice(vocabulary) for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0.004, 0.01, 0.02, 0.3):
            own = [draw.choice(vocabulary) if draw.random() < share else w for w in base]
            texts.append(", ".join(own).title())
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, texts[-1]), (None, texts[0])]
    found = {r.doc_id: r.component_id for r in sh.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets, alike, links = [shingles_of(t) for t in texts], 0, []
    wide = [[int(x) for x in brute_wide(t)[2:]] for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if jaccard >= 0.8:
                alike += 1
                assert found[i] == found[j]
            if sum(bin(x ^ y).count("1") for x, y in zip(wide[i], wide[j], strict=True)) <= sh.WIDE_RADIUS:
                links.append((i, j))
                assert jaccard > 0.5
    assert alike > 40
    group = list(range(len(texts)))
    for i, j in links:
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    assert [found[i] for i in range(len(texts))] == [group.index(g) for g in group]
    assert found[None] == 0 and found[900] == found[901] == found[902] == 900 and found[903] == found[len(texts) - 1]
    kept = [r.doc_id for r in sh.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept) == sorted(set(found.values()))


def test_links_lose_nothing():
    draw = np.random.default_rng(7)
    heart = draw.integers(0, 2**64, 40, np.uint64)
    fps = np.unique(np.concatenate([heart] + [h ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (60, 3)).astype(np.uint64), axis=1) for h in heart]))
    masks = [np.uint64(m % 2**64) for m in sh.block_masks()]
    for i in range(0, len(fps), 37):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            assert any(fps[i] & m == fps[j] & m for m in masks)
    found = {frozenset(map(int, g)) for g in sh.groups_of(fps, sh.pivot_table(fps))}
    left, whole = set(range(len(fps))), set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {int(j) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 4)} & left
            left -= near
            todo += near
        if len(group) > 1:
            whole.add(frozenset(group))
    assert found == whole


def test_lists_cut_by_batches(spark, monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(8)
    keys = np.sort(draw.integers(0, 30, 400))
    fps = draw.integers(0, 64, 400).astype(np.uint64)
    cuts = [0, 3, 50, 51, 52, 200, 400]
    longs = [sh.pivot_table(fps).view(np.int64)[:, i].copy() for i in range(sh.PIVOTS // sh.PER_LONG)]
    columns, names = [keys, fps.view(np.int64), *longs], ["key", "fp", "p0", "p1"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in columns], names) for a, b in zip(cuts, cuts[1:], strict=False)]

    def rows(limit):
        return [r for x in sh._edges(limit, 0, sh.RADIUS)(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]

    a, b = sh._edges_of_lists(keys, fps, fps, sh.pivot_table(fps), sh.RADIUS)
    assert {r[:2] for r in rows(None)} == {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    size = {k: int((keys == k).sum()) for k in keys}
    back = [(k, a) for a, b, k in rows(12) if b is None]
    assert sorted(back) == sorted((int(k), int(f)) for k, f in zip(keys, fps, strict=True) if size[k] > 12)


def test_long_lists_are_dealt_into_parts(spark):
    draw = np.random.default_rng(9)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 20, (900, 5)).astype(np.uint64), axis=1)).view(np.int64)
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long")

    def groups(long):
        label = {r.node: r.label for r in sh.components(sh.links(table, long)).collect()}
        return {frozenset(n for n in label if label[n] == x) for x in label.values()}

    assert groups(40) == groups(1 << 20) and len(fps) > 200


def test_pivot_table_is_that_of_the_columns(spark):
    fps = np.array([0, -1, 5, 2**62, -(2**63)], np.int64)
    rows = sh.with_pivots(spark.createDataFrame([(int(f),) for f in fps], "fp long")).collect()
    got = sh.unpacked([np.array([r[f"p{i}"] for r in rows], np.int64) for i in range(sh.PIVOTS // sh.PER_LONG)])
    assert (got == sh.pivot_table(np.array([r.fp for r in rows], np.int64).view(np.uint64))).all()


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "k", 1), (2, "a b c d e", "k", 1), (2, "a b c d e", "k", 1)], SCHEMA + ", row_key string, `a``b` int")
    assert [tuple(r) for r in sh.keep_one(docs).collect()] == [(1, "a b c d e", "k", 1)]
    assert sh.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_and_chains(spark):
    assert sh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    label = {r.node: r.label for r in sh.components(chain).collect()}
    assert {label[i] for i in range(201)} == {0} and label[1001] == 1000


def test_groups_pass_by_the_driver_and_cost_few_tasks(spark):
    edges = [(i, i + 1) for i in range(0, 90) if i % 10 != 9] + [(200, i) for i in range(201, 260)]
    held = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsCount()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        label = sh.components(spark.createDataFrame(edges, "a long, b long"))
        found = {r.node: r.label for r in label.collect()}
        parts = label.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 10 for i in range(90)} | dict.fromkeys(range(200, 260), 200)
    assert parts <= 4 * spark.sparkContext.defaultParallelism, parts
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(int(ran), runs.size())]
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_size_estimates_do_not_grow_over_rounds(spark, monkeypatch):
    sizes, few = [], sh.in_few

    def seen(df, rows):
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return few(df, rows)

    monkeypatch.setattr(sh, "in_few", seen)
    chain = spark.createDataFrame([(hash((i, 7)), hash((i + 1, 7))) for i in range(200)], "a long, b long")
    label = sh.components(chain)
    assert label.select("label").distinct().count() == 1 and label.count() == 201
    assert len(sizes) > 6 and max(sizes) < 200, sizes  # bits; they doubled with each pass
