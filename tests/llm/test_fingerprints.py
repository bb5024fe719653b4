from __future__ import annotations

import hashlib
import random
from functools import cache

import pytest

from quillon.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def edited(rows):
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        yield doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()


def test_edited_texts_match_brute_force_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 7)
    draw = random.Random(1)
    rows = [(i * 3, "".join(draw.choice("abcdé 漢\n") for _ in range(draw.choice([0, 1, 2, 3, 40, 700])))) for i in range(60)] + [(1000, None), (None, "last of all")]
    found = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fp.edit_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == set(edited(rows))


def test_likeness_follows_edits(spark):
    draw = random.Random(2)
    for n in (60, 500, 5000, 40_000):
        sums = [0.0] * 4
        for _ in range(8):
            text = "".join(draw.choice("etaoin shrdlu") for _ in range(n))
            near = text[: n // 2] + "XY" + text[n // 2 + 1 :]
            third = text[: n - n // 3] + "".join(draw.choice("ETAOIN") for _ in range(n // 3))
            four = (text, near, third, "".join(draw.choice("etaoin shrdlu") for _ in text))
            marks = [fp.parsed(fp.shown(s, fp.level_of(n))) for s, _ in fp.walk([fp.classes(fp.code_points(t)) for t in four])]
            sums = [x + fp.likeness(marks[0][0], marks[0][1], m[0], m[1]) / 8 for x, m in zip(sums, marks, strict=True)]
        assert sums[0] == 1.0 and sums[1] > 0.75 and 0.5 < sums[2] < 0.8 and sums[3] < 0.4, (n, sums)


def test_odd_rows(spark):
    one = fp.edit_fingerprints(spark.createDataFrame([(5, "abcdef")], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "same text here"), (1, "same text here"), (2, ""), (3, None)]
    found = fp.edit_fingerprints(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", guest string, bucket int")).collect()
    assert len(found) == 4 and len({r.fingerprint for r in found if r.doc_id == 1}) == 1
    assert fp.edit_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.fingerprint for r in fp.fingerprints(spark.createDataFrame([(2, ""), (3, None)], SCHEMA)).collect()} == {"00"}


def test_near_duplicates(spark):
    draw = random.Random(3)
    rows, group = [], {}
    for g in range(8):
        base = "".join(draw.choice("etaoin shrdlu") for _ in range(draw.choice([300, 1100, 9000])))
        for k in range(g + 1):
            text = base
            for _ in range(k % 3):
                at = draw.randrange(len(text))
                text = text[:at] + draw.choice("xyz") + text[at + 1 :]
            rows.append((100 * g + k, text))
            group[100 * g + k] = 100 * g
    rows += [(900, None), (901, ""), (None, "lonely text of its own")]
    found = {r.doc_id: r.component_id for r in fp.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", node int")).collect()}
    assert len(found) == len(rows) and found[900] == found[901] == 900 and found[None] is None
    right = sum(found[d] == g for d, g in group.items())
    assert right >= 0.9 * len(group) and all(found[d] // 100 == d // 100 for d in group)
    assert fp.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def sampled_levels(upto: int) -> list[int]:
    """Trailing zeros of splitmix64 of each step's number."""
    out = []
    for j in range(upto):
        x = (j + 0x9E3779B97F4A7C15) % 2**64
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        x ^= x >> 31
        out.append((x & -x).bit_length() - 1 if x else 60)
    return out


LEVELS = sampled_levels(60_000)


def like(x: str, y: str) -> float:
    """Likeness of two fingerprints by the definition: equal samples of the steps that the coarser level samples."""
    level = max(int(x[:2]), int(y[:2]))
    a, b = coarse(x, level), coarse(y, level)
    longer = max(len(a), len(b))
    return sum(map(str.__eq__, a, b)) / longer if longer else float(x == y)


@cache
def coarse(text: str, level: int) -> str:
    own = (n for n in LEVELS if n >= int(text[:2]))
    return "".join(c for c, n in zip(text[2:], own, strict=False) if n >= level)


def groups(marks: list[str], least: float = 0.8) -> list[int]:
    name = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            if name[i] != name[j] and like(marks[i], marks[j]) >= least:
                name = [name[j] if n == name[i] else n for n in name]
    return name


def prints(texts: list[str]) -> list[str]:
    return [fp.shown(s, fp.level_of(len(t))) for t, (s, _) in zip(texts, fp.walk([fp.classes(fp.code_points(t)) for t in texts]), strict=True)]


def test_walked_lists_against_all_pairs():
    """Lists hold fingerprints of two levels: texts about the length at which the level goes up."""
    draw = random.Random(4)
    base = "".join(draw.choice("etaoin shrdlu") for _ in range(1100))
    texts = [base[: draw.choice([980, 1010, 1030, 1060, 1100]) - draw.randrange(30)] + "".join(draw.choice("ETAOIN") for _ in range(draw.randrange(200))) for _ in range(50)]
    marks = sorted(set(prints(texts)))
    assert len({m[:2] for m in marks}) == 2
    table = fp.Table(marks)
    for i in range(len(marks)):
        others = [j for j in range(len(marks)) if j != i]
        assert table.alike(i, fp.np.array(others), 0.8).tolist() == [like(marks[i], marks[j]) >= 0.8 for j in others]
    tree = list(range(len(marks)))
    for a, b in zip(*table.edges(0.8), strict=True):
        tree = [tree[a] if t == tree[b] else t for t in tree]
    name = groups(marks)
    assert all((tree[i] == tree[j]) == (name[i] == name[j]) for i in range(len(marks)) for j in range(i))


@pytest.mark.parametrize(("common", "own", "size"), [(1500, 540, 4096), (1500, 540, 40), (1200, 440, 4096)])
def test_templates_lose_no_links(spark, common, own, size):
    """Texts of one template: every band of the common part is a long list of texts most of which are just not alike enough."""
    draw = random.Random(common)

    def words(n):
        return "".join(draw.choice("etaoin shrdlu") for _ in range(n))

    start = words(common)
    marks = sorted(set(prints([start + words(own) for _ in range(150)] + [words(900) for _ in range(20)])))
    edges = fp.links(spark.createDataFrame(list(enumerate(marks)), "node long, fingerprint string"), 0.8, size).collect()
    tree = list(range(len(marks)))
    for a, b in edges:
        tree = [tree[a] if t == tree[b] else t for t in tree]
    name = groups(marks)
    pairs = [(i, j) for i in range(len(marks)) for j in range(i) if name[i] == name[j]]
    assert pairs and all(tree[i] == tree[j] for i, j in pairs)
    assert all(name[i] == name[j] for i in range(len(marks)) for j in range(i) if tree[i] == tree[j])


def test_lists_of_the_same_texts_are_walked_once(spark):
    rows = [(key, node) for key in range(5) for node in range(30)] + [(9, node) for node in range(31)]
    dealt = fp.long_lists(spark.createDataFrame(rows, "key long, node long"), 100).collect()
    assert len(dealt) == 30 + 31
    parts: dict[int, set] = {}
    for r in fp.long_lists(spark.createDataFrame(rows, "key long, node long"), 7).collect():
        parts.setdefault(r.key, set()).add(r.node)
    assert all(any({i, j} <= p for p in parts.values()) for i in range(31) for j in range(i))


def test_query_returns_groups_of_brute_force(spark):
    """op1 names each row's group, over lists longer than are compared whole (a shared opening, a large group of near copies)."""
    draw = random.Random(6)
    def words(n):
        return "".join(draw.choice("etaoin shrdlu") for _ in range(n))

    opening, base, rows = words(500), words(3000), []
    for i in range(60):
        text = opening + words(1500)
        at = draw.randrange(600, 1900)
        rows += [(10 * i, text), (10 * i + 1, text[:at] + "XY" + text[at + 3 :])]
    for i in range(80):
        at = draw.randrange(2900)
        rows.append((1000 + i, base[:at] + "Z" + base[at + 1 :]))
    rows += [(2000, base), (2001, base), (None, base + "!"), (None, None), (None, "")]
    found = fp.edit_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    marks = sorted({r.fingerprint for r in found})
    group = groups(marks)
    least: dict[int, int] = {}
    for r in found:
        g = group[marks.index(r.fingerprint)]
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    right = [r.component_id == least.get(group[marks.index(r.fingerprint)]) for r in found]
    assert sum(right) >= 0.98 * len(right) and {r.component_id for r in found if r.n_chars == 0} == {None}
