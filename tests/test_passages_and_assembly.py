from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import assembly, passages
from quillon.operators.assembly import Limits, Passage


def text(draw, sentences):
    return "".join(" ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(1, 60))) + draw.choice([". ", "! ", "\n", "\n\n", " "]) for _ in range(sentences))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!?…é", max_size=300), st.integers(1, 12))
def test_chunks_are_disjoint_slices_that_cover_all_words(body, target):
    spans = passages.chunk_offsets(body, target)
    assert all(a <= b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join(body[a:b] for a, b in spans).split() == body.split() or sum(len(body[a:b].split()) for a, b in spans) >= len(body.split())


def test_long_runs_are_cut():
    body = "word " * 2000
    spans = passages.chunk_offsets(body, passages.words_in(400))
    assert len(spans) == 2 and spans[0][1] == 1999 and spans[-1][1] == len(body)


def test_passages_table(spark):
    draw = random.Random(1)
    rows = [(i, f"p{i}", f"T{i}", text(draw, 40)) for i in range(5)] + [(9, "empty", "E", "  ")]
    found = passages.split(spark.createDataFrame(rows, "zim_id int, path string, title string, text string")).collect()
    body = {p: t for _, p, _, t in rows}
    assert {r.path for r in found} == {f"p{i}" for i in range(5)}
    assert all(r.text == body[r.path][r.char_start : r.char_end] and r.is_lead and r.breadcrumb == "T" + r.path[1:] for r in found)


def test_index_chunks_by_depth():
    body = "Lead text. " + "".join(f"Section {i} text. " for i in range(10))
    at = [body.index(f"Section {i}") for i in range(10)] + [len(body)]
    sections = [{"heading_path": [f"H{i}"], "level": 2, "char_start": at[i], "char_end": at[i + 1]} for i in range(10)]
    assert passages.index_chunks_of("T", body, sections, 1) == [(0, at[0], "T > Lead text. ")]
    deep = passages.index_chunks_of("T", body, sections, 2)
    assert len(deep) == 9 and deep[1][2] == "T > Section 0 text." and deep[-1][1] == len(body) and deep[-1][2].endswith("Section 7 text.")
    assert passages.index_chunks_of("", body, [], 1) == [(0, len(body), body)]
    assert passages.index_chunks_of("T", " \n", sections, 2) == [] and passages.index_chunks_of("T", "  x", [{**sections[0], "char_start": 0, "char_end": 3}], 1) == []
    assert passages.index_chunks_of("T", body, sections, 3)[0][2].startswith("T  Lead text.")


def brute_chunks(body, target):
    """The rule, one sentence at a time."""
    spans, open_at, held, sentences = [], None, 0, passages.sentence_offsets(body)
    for a, b in sentences:
        n = len(body[a:b].split())
        open_at = a if open_at is None else open_at
        if held and held + n > target:
            spans.append((open_at, a))
            open_at, held = a, 0
        held += n
        if held > 2 * target and b > open_at:
            cut = min(open_at + max(int(target * 6.5), 1), len(body))
            while any(c.isspace() for c in body[cut:]) and not body[cut].isspace():
                cut += 1
            spans.append((open_at, cut))
            open_at, held = cut, len(body[cut:b].split())
    return spans + ([(open_at, sentences[-1][1])] if sentences and open_at < sentences[-1][1] else [])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aab . \n!", max_size=300), st.integers(1, 12))
def test_chunks_follow_the_rule(body, target):
    assert passages.chunk_offsets(body, target) == brute_chunks(body, target)


def test_focused_view(spark):
    draw = random.Random(2)
    body = text(draw, 200) + " the needle stands here. " + text(draw, 200)
    view = passages.focused_view(body, {"needle"}, 6000, "Title")
    assert "needle" in view and "[...]" in view and len(view) < 6100 and all(part.startswith("Title\n") for part in view.split("\n\n[...]\n\n"))
    assert passages.focused_view("short", {"x"}, 10) == "short"
    # What must be in is whole, whatever the budget; nothing else fits then.
    at = body.index(" the needle")
    chunks = passages.chunk_offsets(body, passages.words_in(400))
    assert passages.focused_spans(body, {"w1"}, 10, must=[(at, at + 4000)]) == [chunks[0], (at, at + 4000)]
    rows = spark.createDataFrame([(1, 2, "p", "Title", body, ["needle"], [(at, at + 9)])], "item_id long, zim_id int, path string, title string, text string, terms array<string>, must array<struct<char_start:int,char_end:int>>")
    assert passages.focused_views(rows, 6000).first().view == passages.focused_view(body, {"needle"}, 6000, "Title", [(at, at + 9)])


def brute_snippet(body, terms, size=220):
    if len(body) <= size:
        return body.strip()
    places = [p for t in terms if len(t.strip()) >= 3 and (p := body.lower().find(t.strip().lower())) >= 0]
    if not places:
        return body[:size].rsplit(" ", 1)[0] + "…"
    high = min(len(body), max(0, min(places) - size // 2) + size)
    start, stop = max(0, high - size), high
    if start and 0 <= body.find(" ", start) < start + 20:
        start = body.find(" ", start) + 1
    if stop < len(body) and body.rfind(" ", start, stop) > start:
        stop = body.rfind(" ", start, stop)
    return ("…" if start else "") + body[start:stop].strip() + ("…" if stop < len(body) else "")


def test_snippets(spark):
    draw = random.Random(4)
    rows = [(text(draw, draw.randrange(1, 12)), draw.sample(["w1", "w77", "W45", " w30 ", "zzz", "w5 "], 3)) for _ in range(60)]
    rows += [("x" * 500, ["xxx"]), ("  short ", ["s"]), ("y" * 300, ["abc"]), (" " * 300 + "needle", ["needle"])]
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, body string, terms array<string>").select("i", T.snippet(F.col("body"), F.col("terms")).alias("s"))
    assert {r.i: r.s for r in found.collect()} == {i: brute_snippet(*r) for i, r in enumerate(rows)}


SHELLS = [
    ("""<html><meta http-equiv="refresh" content="0;url='../../A/Main_Page'"></html>""", "A/Main_Page"),
    ("""<META HTTP-EQUIV='Refresh' CONTENT='5; URL="./x#part"'>""", "x#part"),
    ("""<meta http-equiv=refresh content="0; /y">""", "y"),
    ("""<meta content="1;url=z w" http-equiv="refresh">""", "z"),
    ("""<meta http-equiv="refresh" content="30">""", None),
    ("""<meta name="refresh" content="0;url=q">""", None),
    ("""<meta http-equiv="refresh" content="0;url=q">""" + " " * 600, None),
]


def test_soft_redirects_and_captions(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(SHELLS)], "i int, html string").select("i", T.soft_redirect_target(F.col("html")).alias("t"))
    assert {r.i: r.t for r in rows.collect()} == {i: t for i, (_, t) in enumerate(SHELLS)}
    vtt = "WEBVTT - x\r\n\r\nNOTE a\n\n1\n00:01.000 --> 00:02.000\n  First \n\n00:12:05.5\nWEBVTTs stay\nat 10:30 we\nwebvtt\n12:30\n"
    assert spark.range(1).select(T.vtt_text(F.lit(vtt)).alias("t")).first().t == "1\nFirst\nWEBVTTs stay\nat 10:30 we"


def pool(seed, n=40):
    draw = random.Random(seed)
    base = [text(draw, 2) for _ in range(6)]
    return [
        Passage(draw.randrange(3), f"a{draw.randrange(5)}", i, draw.choice(["A", "B"]), draw.choice([*base, text(draw, 2), "tiny bit"]), draw.random() < 0.3, draw.choice([-0.5, 0.0, 0.1, 0.5, 0.9, 1.0]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(25))
def test_budget_rules(seed):
    limits = Limits(budget=200, per_article=2, floor_rel=0.5, least_articles=3)
    rows = assembly.by_score(pool(seed))
    chosen = assembly.top_k(rows, limits, "")
    # The same by its rules, one row at a time.
    kept, used = [], 0
    for p in rows:
        articles = {k.article for k in kept}
        if sum(k.article == p.article for k in kept) >= 2:
            continue
        own = assembly.bigrams(p.text)
        if len(own) >= 4 and any(assembly.overlap(own, assembly.bigrams(k.text)) > 0.85 for k in kept if assembly.bigrams(k.text)):
            continue
        if p.score < max(0.0, 0.5 * rows[0].score) and p.article not in articles and len(articles) >= 3:
            continue
        if kept and used + p.size > 200:
            break
        kept.append(p)
        used += p.size
    assert chosen == kept


@pytest.mark.parametrize("name", sorted(assembly.ASSEMBLERS))
@pytest.mark.parametrize("seed", range(8))
def test_assemblers_keep_their_limits(name, seed):
    rows = pool(seed)
    chosen = assembly.ASSEMBLERS[name](rows, Limits(budget=150), "A")
    assert chosen and len({p.key for p in chosen}) == len(chosen)
    if name in ("topk_budget", "diverse"):
        assert sum(p.size for p in chosen) <= max(150, chosen[0].size)
        assert max(sum(q.article == p.article for q in chosen) for p in chosen) <= 2
    if name == "diverse":
        assert max(sum(q.zim_id == p.zim_id for q in chosen) for p in chosen) <= 4
    if name == "lead_boost" and any(p.is_lead and p.breadcrumb == "A" for p in rows):
        assert chosen[0].is_lead and chosen[0].breadcrumb == "A"


def test_near_dup_sets_of_any_length_and_source(spark, tmp_path):
    from quillon.plans.assembly import near_dup_bigram_sets

    base = " ".join(f"word{i}" for i in range(200))
    texts = [("src1", base), ("src2", base + " more"), ("src3", base), ("src1", " ".join(f"other{i}" for i in range(200))), ("src2", "one two three four five six")]
    spark.createDataFrame([(i, s, t, len(t)) for i, (s, t) in enumerate(texts)], "doc_id long, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bags = {i: {tuple(p) for p in zip(t.split(), t.split()[1:])} for i, (_, t) in enumerate(texts)}
    head = {i: min(j for j in bags if bags[j] == bags[i]) for i in bags}
    near = {(a, b) for a in set(head.values()) for b in set(head.values()) if a < b and len(bags[a] & bags[b]) / len(bags[a] | bags[b]) > 0.85}
    rows = near_dup_bigram_sets(spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in rows if r.kind == "same") == sorted((h, i) for i, h in head.items())
    assert {(r.a, r.b) for r in rows if r.kind == "near"} == near == {(0, 1)}
