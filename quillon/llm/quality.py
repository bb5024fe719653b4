"""Quality classifier: a sparse rule ensemble.

Statistics of each text are plain Spark expressions. A small random forest is fitted on labelled rows; every path from
a root to a node of its trees is a conjunctive rule over the statistics. A lasso logistic regression over the rules
keeps few of them, and the kept rules are compiled into one Spark column expression, so that scoring is a scan.

Fitting uses at most about `max_rows` labelled rows, picked by a hash of doc_id where there are more; statistics and
scores cover every row.

Defined cases: null and empty texts have zero statistics and a score like any other; a null doc_id counts as held out;
a doc_id with several labels is learned from each; without labels, or with one class only, every score is the
smoothed share of good labels (0.5 without any); an empty table gives no rows; other columns are ignored by `scores`
and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import checkpointed, packed

MAX_ROWS = 50_000
PARTS = 8
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are numbers, zero for an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "word_length": n_chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "doubled_words": count(r"(?<![^\s])(\S+)\s\1(?![^\s])") / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": n_words / F.greatest(F.size(lines), F.lit(1)),
        "shouted": count(r"\p{Lu}{2,}") / n_words,
        "symbols": count(r"[#$%&*@^~=<>{}\\]+") / n_words,
        "bars": count(r"\|") / n_words,
        "bangs": count(r"!") / n_words,
        "digits": count(r"[0-9]+") / n_words,
        "stops": count(r"[.?]") / n_words,
    }


NAMES = [
    "log_chars", "word_length", "distinct_words", "doubled_words", "distinct_lines", "line_words", "shouted", "symbols", "bars", "bangs",
    "digits", "stops",
]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    return docs.select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()])


def rules_of(tree: str) -> set[tuple[tuple[int, str, float], ...]]:
    """Rules of one tree, read from its description: for each path a conjunction of (feature, <= or >, bound), simplified."""
    found, path = set(), []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
            bounds: dict[tuple[int, str], float] = {}
            for _, feature, sign, bound in path:
                best = min if sign == "<=" else max
                bounds[feature, sign] = best(bound, bounds.get((feature, sign), bound))
            found.add(tuple(sorted((f, s, b) for (f, s), b in bounds.items())))
    return found


def compiled(rule: tuple[tuple[int, str, float], ...]) -> Column:
    out = F.lit(True)
    for feature, sign, bound in rule:
        out = out & (F.col(NAMES[feature]) <= bound if sign == "<=" else F.col(NAMES[feature]) > bound)
    return out


def fit(rows: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> list[tuple[Column | None, float]]:
    """Rules with weights (the intercept has no rule) from rows of statistics and `label` (0 or 1)."""
    good, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    prior = float(logit((good + 1) / (n + 2)))
    if good in (0, n):
        return [(None, prior)]
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(rows).select("features", "label", *NAMES)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed)
    model = forest.fit(vectors)
    rules = sorted(set().union(*[rules_of(t.toDebugString) for t in model.trees]))
    if not rules:
        return [(None, prior)]
    fired = F.array(*[compiled(r).cast("double") for r in rules])
    sparse = checkpointed(rows.select("label", array_to_vector(fired).alias("features")))
    lr = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False, aggregationDepth=2)
    fitted = lr.fit(sparse)
    kept = [(compiled(r), float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return [(None, float(fitted.intercept)), *kept]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def score_of(model: list[tuple[Column | None, float]]) -> Column:
    """The model as one column over the statistics: the chance of label 1."""
    total = F.lit(0.0)
    for rule, weight in model:
        total = total + (F.lit(weight) if rule is None else F.when(rule, weight).otherwise(0.0))
    return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Statistics and label of labelled rows that are not held out, about `max_rows` of them at most. Labels are picked first and, being
    that few, broadcast: the statistics of other rows are not worked out here, and no text moves."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")).where("label in (0, 1)")
    own = own.where(~held_out(F.col("id")))
    share = min(1.0, max_rows / max(own.count(), 1))
    own = own.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    own = F.broadcast(own) if own.count() <= 2 * max_rows else own
    rows = docs.select(F.col("doc_id"), F.col("text")).join(own, F.col("doc_id") == F.col("id"))
    rows = rows.select("id", "label", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    # Dealt out and sorted by fixed rules: the forest draws by place, so that reruns draw the same rows.
    return rows.repartition(PARTS, "id").sortWithinPartitions("id", "label", *NAMES).select("label", *NAMES)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[Column | None, float]]:
    return fit(checkpointed(training_rows(docs, labels, max_rows)))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    score = score_of(train(docs, labels, max_rows))
    out = with_statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject. Only narrow rows are shuffled, to fit it."""
    score = score_of(train(docs, labels, max_rows))
    scored = docs.select(packed(docs, "doc"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    return scored.where(score >= THRESHOLD).select("doc.*")
