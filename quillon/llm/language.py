"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams of letters. A document is taken as a mixture of
languages: expectation maximisation estimates their proportions from the trigram likelihoods, and the set of
languages is chosen by penalised likelihood, dropping the least one as long as the penalty saved outweighs the likelihood
lost. The prediction is the language with the largest proportion in the chosen set.

Learning counts trigrams in Spark over all documents learned from; what reaches the driver is one table of
`features` trigrams by languages, whatever the corpus's size. Documents are inferred in batches, all of a batch at once.

Defined cases: a null text, or one without letters, is `und` with score 0; null languages are not learned from, and
null doc_ids are held out; with no language learned every prediction is `und`; a text none of whose trigrams are features
gets the language learned from most, with that language's share; repeated rows and an empty table are as any; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import checkpointed

BUCKETS = 1 << 16
FEATURES = 4096
FOLDS, HELD = 3, 1
STEPS = 12
#: Penalty for each further language, in log-likelihood, times the log of the number of trigrams.
PENALTY = 8.0
BATCH = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def _letters() -> np.ndarray:
    """Lower-case code point of each code point below 0x3000 that is a letter, 32 (a space) for all else."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x3000)], np.uint32)


LETTERS = _letters()


def trigrams(text: str) -> tuple[np.ndarray, bool]:
    """Hash buckets of a text's trigrams within and at the edges of words, and whether it has a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = LETTERS[np.minimum(codes, len(LETTERS) - 1)]
    high = codes >= len(LETTERS)
    if high.any():
        low = low.copy()
        low[high] = [ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, codes[high].tolist())]
    has_letter = bool((low != 32).any())
    if not has_letter:
        return np.zeros(0, np.uint32), False
    padded = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]]).astype(np.uint32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    keep = (b != 32)
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16))[keep], True


def _counted(batches):
    """Trigram counts by language of one task: at most BUCKETS rows for each language."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, _ = trigrams(text or "")
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(found, minlength=BUCKETS) if len(found) > 4096 else 0
            if len(found) <= 4096:
                np.add.at(own, found, 1)
            docs[lang] = docs.get(lang, 0) + 1
    for lang, own in sums.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(some) + 1), pa.string()), pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(own[some], docs[lang]), pa.int64())],
            ["lang", "bucket", "n"],
        )


class Model:
    """Languages, their share of documents, the feature of each bucket (-1: none) and log-likelihoods by feature and language."""

    def __init__(self, langs: list[str], share: np.ndarray, feature: np.ndarray, chance: np.ndarray):
        self.langs, self.share, self.feature, self.chance = langs, share, feature, chance


def learn(docs: DataFrame, features: int = FEATURES) -> Model | None:
    """The model of documents that have a language and are not held out; None if there are none."""
    own = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = own.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    share = {r["lang"]: r["n"] for r in counts.where("bucket = -1").select("lang", "n").collect()}  # a row for each language
    if not share:
        return None
    langs = sorted(share)
    # The trigrams that say most about the language: by count times the spread of their rates over languages.
    total = counts.where("bucket >= 0").groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.where("bucket >= 0").join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    by_bucket = rate.groupBy("bucket").agg(F.sum("rate").alias("all"), F.max("rate").alias("most"))
    told = by_bucket.withColumn("worth", F.col("most") * F.log(F.col("most") * len(langs) / F.col("all") + 0.5))
    best = told.orderBy(F.desc("worth"), "bucket").limit(features).select("bucket")
    table = counts.join(F.broadcast(best), "bucket").collect()  # features times languages at most
    feature = np.full(BUCKETS, -1, np.int32)
    chosen = sorted({r["bucket"] for r in table})
    feature[chosen] = np.arange(len(chosen))
    seen = np.full((len(chosen), len(langs)), 0.5)
    place = {lang: i for i, lang in enumerate(langs)}
    for r in table:
        seen[feature[r["bucket"]], place[r["lang"]]] += r["n"]
    prior = np.array([share[lang] for lang in langs], float)
    return Model(langs, prior / prior.sum(), feature, seen / np.maximum(seen.sum(0, keepdims=True), 1e-300))


def mixture(counts: np.ndarray, chance: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages (documents by languages) and the log-likelihood, by expectation maximisation."""
    part = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    n = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(STEPS):
        part = part * ((counts / np.maximum(part @ chance.T, 1e-300)) @ chance) / n
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
    return part, (counts * np.log(np.maximum(part @ chance.T, 1e-300))).sum(1)


def gap(counts: np.ndarray, chance: np.ndarray, part: np.ndarray) -> np.ndarray:
    """By how much the log-likelihood of the proportions may still rise, at most: it is concave in them."""
    n = counts.sum(1)
    rise = ((counts / np.maximum(part @ chance.T, 1e-300)) @ chance).max(1) / np.maximum(n, 1)
    return n * np.log(np.maximum(rise, 1.0))


def chosen_sets(counts, chance, part, fit, price, best, value) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and penalised fit of the best of the nested sets that dropping the least language each time gives."""
    allowed = np.ones(part.shape, bool)
    for size in range(part.shape[1], 1, -1):
        better = fit - price * size >= value
        best, value = np.where(better[:, None], part, best), np.where(better, fit - price * size, value)
        if size > 2:
            allowed[np.arange(len(part)), np.where(allowed, part, np.inf).argmin(1)] = False
            part, fit = mixture(counts, chance, allowed)
    return best, value


def infer(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text of a batch."""
    n_features, n_langs = model.chance.shape
    found = [trigrams(t or "") for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(f) for f, _ in found])
    feature = model.feature[np.concatenate([np.zeros(0, np.uint32), *[f for f, _ in found]]).astype(np.int64)]
    cells = rows[feature >= 0] * n_features + feature[feature >= 0]
    counts = np.bincount(cells, minlength=len(texts) * n_features).reshape(len(texts), n_features).astype(float)
    used = counts.any(0)  # columns that no text of the batch has change nothing
    counts, chance = counts[:, used], model.chance[used]
    price = PENALTY * np.log(np.maximum(counts.sum(1), 2))
    part, fit = mixture(counts, chance, np.ones((len(texts), n_langs), bool))
    alone = counts @ np.log(chance)
    best, value = np.eye(n_langs)[alone.argmax(1)], alone.max(1) - price
    # No set fits better than all languages together: where even the best such fit would not pay for a second one, one it is.
    open_ = np.flatnonzero(fit + gap(counts, chance, part) - 2 * price > value)
    if open_.size:
        best[open_], value[open_] = chosen_sets(counts[open_], chance, part[open_], fit[open_], price[open_], best[open_], value[open_])
    none = counts.sum(1) == 0
    best = np.where(none[:, None], model.share[None, :], best)
    first = best.argmax(1)
    lang = [model.langs[i] if has else "und" for i, (_, has) in zip(first, found, strict=True)]
    return lang, [float(min(1.0, s)) if has else 0.0 for s, (_, has) in zip(best.max(1), found, strict=True)]


def predictions(docs: DataFrame, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    model = learn(docs, features)

    def predicted(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                texts = batch.column(2).to_pylist()
                langs, scores = infer(texts, model) if model else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
