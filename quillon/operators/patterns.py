"""Many patterns in many texts: which of a set of strings each text holds, in one pass over it.

The strings make one automaton (Aho-Corasick), so that a text is read once however many strings are asked for. They come from a
batch of queries; sets of more than MAX_CHARS characters are taken in blocks, each of which is a pass."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the strings of one automaton: some 500 MB in a task at most.
MAX_CHARS = 5_000_000


def folded(text: Column) -> Column:
    """Lower case, white space as one space."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def _held(patterns):
    """Rows (keys ..., text) as a row for each text and string that it holds."""
    def run(batches):
        automaton = ahocorasick.Automaton()
        for p in patterns.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = {p for _, p in automaton.iter(text)} if text else set()
                rows += [i] * len(own)
                found += sorted(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(found, pa.string())], [*batch.schema.names[:-1], "pattern"])

    return run


def held(texts: DataFrame, patterns: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The columns of `texts` but `text`, and `pattern`: a row for each text and each of `patterns` (pattern) that is a substring of it.
    Empty patterns and nulls are held by nothing."""
    keys = [c for c in texts.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in keys), "pattern string"])
    wanted = patterns.select("pattern").where("pattern <> ''").distinct()
    blocks = -(-(wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0) // max_chars)
    out = None
    for block in range(blocks):
        own = [r["pattern"] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]  # a block
        part = texts.select(*keys, "text").mapInArrow(_held(texts.sparkSession.sparkContext.broadcast(own)), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)
