from __future__ import annotations

import random
import zlib

import numpy as np

from quillon.llm import language

SCHEMA = "doc_id long, text string, lang string, source string"
SYLLABLES = {"aa": ["ka", "ko", "ta", "ri", "mo"], "bb": ["sch", "ein", "ung", "ver", "ich"], "cc": ["tion", "eau", "oux", "ée", "qui"]}


def text(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def corpus():
    draw = random.Random(11)
    return [(i, text(draw, lang := draw.choice(list(SYLLABLES)), draw.randrange(3, 60)), lang, "s") for i in range(400)]


def test_held_out_accuracy(spark):
    rows = corpus() + [(1000, None, "aa", "s"), (1001, "12 34 !?", "bb", "s"), (1002, "kako taka", None, "s"), (None, "schein", "bb", "s")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", held_out int, score double")
    found = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert len(found) == len(rows)
    held = [(d, lang) for d, _, lang, _ in corpus() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(found[d].held_out for d, _ in held) and sum(found[d].lang_pred == lang for d, lang in held) / len(held) > 0.97
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0 and found[1002].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_mixtures(spark):
    draw = random.Random(12)
    model = language.learn(spark.createDataFrame(corpus(), SCHEMA))
    mixed = text(draw, "aa", 300) + " " + text(draw, "bb", 100)
    pure = text(draw, "cc", 200)
    langs, scores = language.infer([mixed, pure, ""], model)
    assert langs == ["aa", "cc", "und"] and 0.5 < scores[0] < 0.9 and scores[1] > 0.99


def test_bound_agrees_with_full_search(spark):
    draw = random.Random(13)
    model = language.learn(spark.createDataFrame(corpus(), SCHEMA))
    texts = [" ".join(text(draw, lang, draw.choice([0, 0, 3, 40])) for lang in SYLLABLES) for _ in range(60)]
    langs, scores = language.infer(texts, model)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        found, has = language.trigrams(t)
        if not has:
            continue
        f = model.feature[found.astype(np.int64)]
        counts = np.bincount(f[f >= 0], minlength=len(model.chance)).astype(float)[None, :]
        price, best = language.PENALTY * np.log(max(counts.sum(), 2)), (-np.inf, "", 0.0)
        allowed = np.ones((1, 3), bool)
        for size in (3, 2, 1):
            part, fit = language.mixture(counts, model.chance, allowed)
            best = max(best, (fit[0] - price * size, model.langs[part[0].argmax()], part[0].max()))
            allowed[0, np.where(allowed, part, np.inf).argmin(1)] = False
        assert lang == best[1] and abs(score - best[2]) < 0.02


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "kako", None, "s"), (2, "", None, "s")], SCHEMA)
    assert {(r.lang_pred, r.score) for r in language.predictions(docs).collect()} == {("und", 0.0)}
    assert language.predictions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shortcut_closes_no_text_that_a_second_language_pays_for():
    """Long texts of close languages: what is closed as one language has no better larger set after many more steps."""
    import numpy as np

    draw = np.random.default_rng(9)
    short = 0
    for n_langs in (4, 12, 40):
        base = draw.dirichlet(np.ones(200))
        chance = np.stack([0.9 * base + 0.1 * draw.dirichlet(np.ones(200)) for _ in range(n_langs)], 1)
        counts = np.stack([draw.multinomial(n, chance[:, :2] @ [s, 1 - s]) for n in (300, 3000, 30_000) for s in (0.5, 0.8, 0.95)]).astype(float)
        part, fit = language.mixture(counts, chance, np.ones((len(counts), n_langs), bool))
        full = part
        for _ in range(1500):
            full = full * ((counts / (full @ chance.T)) @ chance) / counts.sum(1, keepdims=True)
        best = (counts * np.log(full @ chance.T)).sum(1)
        assert (fit + language.gap(counts, chance, part) >= best - 1e-6).all()
        short += int((fit < best - 1).sum())
    assert short > 0
