"""Ranked lexical search by sort-based accumulation.

Documents are cut into terms once. Those that some item of the query set asks for stay, as arrays of term numbers and counts, one row
for each document; the length of each document stays too. From these come the number of documents, all their terms, and how many
hold each term.

A task takes a block of documents. For all their terms, the impacts on all items that ask for them are laid end to end: arrays of
item, document and impact. Item and document are packed into one key, keys are put in order by radix sort (16 bits a pass), and impacts of equal
keys are summed by reduceat. A heap for each item keeps its best; what lies below the worst of a full heap never enters it.
A document stands whole in one task, so that its sums are complete there: documents are the range that the work is
partitioned by, and a task hands on at most `top` rows an item. These meet in two steps, parts of an item first, so that the last one
reads few rows however many tasks there were.

The query set is read in blocks of at most MAX_TERMS terms, so that what tasks hold of it is bounded; documents are read once a block.

Defined cases: a null or empty text has no terms, counts as no document and is never found; items without terms get no rows; rows that
repeat a document are documents of their own, each with a rank; repeated items, and items with a null id, are ranked each by
itself; null doc_ids come last among equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._common import checkpointed

TOP = 20
#: What terms are made of. Bytes of characters beyond ASCII are all inside, so that this reads UTF-8 as it does text.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(TERM.encode())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of items, repeats included, that tasks hold at once: some 100 MB.
MAX_TERMS = 1_000_000
#: Terms that are counted at once, impacts that are summed at once, and documents whose numbers fit a key's low digit.
COUNTED, IMPACTS, DOCS = 1 << 20, 1 << 21, 1 << 16
#: Parts in which an item's rows first meet.
PARTS = 64


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _counted(known):
    """Rows (doc_id, text) as doc_id, n (terms), and the numbers and counts of the known terms."""
    def run(batches):
        number = known.value.get
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes, found, owners = np.zeros(batch.num_rows, np.int64), [], []
            keys, counts, waiting = [], [], 0

            def count():
                if found:
                    key, n = np.unique((np.concatenate(owners) << 32) | np.concatenate(found), return_counts=True)
                    keys.append(key), counts.append(n)
                    found.clear(), owners.clear()

            for i, text in enumerate(texts):
                words = TERMS.findall((text.as_py() or b"").lower())  # bytes.lower() knows A-Z alone
                sizes[i] = len(words)
                own = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                own = own[own >= 0]
                found.append(own), owners.append(np.full(len(own), i, np.int64))
                waiting += len(own)
                if waiting > COUNTED:
                    count()
                    waiting = 0
            count()
            key = np.concatenate([*keys, np.zeros(0, np.int64)])
            offsets = pa.array(np.searchsorted(key >> 32, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, np.concatenate([*counts, np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts keys of up to `most`, from their lowest 16 bits on (a stable sort of such is numpy's radix sort)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(most, 1).bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


@dataclass(frozen=True)
class Asked:
    """A block of the query set: ids of its items; by term number, where its items begin and end in `items`, how often each has the
    term (`times`), and the term's weight."""

    ids: list[int | None]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    weights: np.ndarray | None = None


def summed(asked: Asked, docs: np.ndarray, terms_: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, doc and score, by item then doc, from the impacts of documents' terms; doc numbers are below DOCS."""
    n = asked.starts[terms_ + 1] - asked.starts[terms_]
    place = np.arange(n.sum()) + np.repeat(asked.starts[terms_] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    width = int(docs.max(initial=0)) + 1
    keys = asked.items[place] * width + np.repeat(docs, n)
    values = np.repeat(impacts, n) * asked.times[place]
    order = radix_order(keys, len(asked.ids) * width)
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    scores = np.add.reduceat(values, starts) if len(starts) else values
    return keys[starts] // width, keys[starts] % width, scores


NONE = 1 << 63


def _ranked(shared, top: int, documents: int, all_terms: int):
    """From rows of `_counted`: item number, item_id, doc_id and score of the best of each item in this task."""
    def run(batches):
        asked: Asked = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in asked.ids]
        worst = np.ones(len(asked.ids), np.int64)
        for batch in batches:
            counts = batch.column("counts").flatten().to_numpy()
            numbers = batch.column("terms").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(np.asarray(batch.column("counts").value_lengths()))
            sizes = batch.column("n").to_numpy()
            ids = batch.column("doc_id").to_pylist()
            spread = np.concatenate(([0], np.cumsum(asked.starts[numbers + 1] - asked.starts[numbers])))
            m = 75 + (25 * sizes * documents) // max(all_terms, 1)
            first = 0
            while first < batch.num_rows:  # so many documents that their impacts fit, one at least
                begin = int(ends[first - 1]) if first else 0
                last = int(np.searchsorted(spread[ends], spread[begin] + IMPACTS, "right"))
                last = min(max(last, first + 1), first + DOCS, batch.num_rows)
                own = slice(begin, int(ends[last - 1]))
                docs = np.searchsorted(ends, np.arange(own.start, own.stop), "right")
                tf = counts[own].astype(np.int64)
                impacts = asked.weights[numbers[own]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
                item, doc, score = summed(asked, docs - first, numbers[own], impacts)
                good = score >= worst[item]
                for i, d, s in zip(item[good].tolist(), doc[good].tolist(), score[good].tolist(), strict=True):
                    entry = (s, -(NONE if ids[first + d] is None else ids[first + d]))
                    if len(heaps[i]) < top:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == top:
                        worst[i] = heaps[i][0][0]
                first = last
        rows = [(i, asked.ids[i], None if d == -NONE else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return run


def best(rows: DataFrame, top: int, *within: str) -> DataFrame:
    """The `top` rows with the highest scores; ties by doc_id. What each task can drop it drops before the shuffle."""
    order = W.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the `top` documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    spark = docs.sparkSession
    own = checkpointed(items.select(F.col("item_id").cast("bigint"), terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).withColumn("no", F.monotonically_increasing_id()))
    blocks = -(-(own.agg(F.sum(F.size("terms"))).first()[0] or 0) // max_terms)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    parts = []
    for block in range(blocks):
        queries = own.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block).orderBy("no").collect()  # a block
        known = {t: i for i, t in enumerate(sorted({t for q in queries for t in q["terms"]}))}
        rows = np.array([(known[t], i) for i, q in enumerate(queries) for t in q["terms"]], np.int64).reshape(-1, 2)
        pairs, times = np.unique(rows, axis=0, return_counts=True)
        counted = checkpointed(texts.mapInArrow(_counted(spark.sparkContext.broadcast({t.encode(): i for t, i in known.items()})), "doc_id long, n long, terms array<int>, counts array<int>"))
        documents, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(known), np.int64)
        for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the block
            held[term] = df
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
        asked = Asked([q["item_id"] for q in queries], np.searchsorted(pairs[:, 0], np.arange(len(known) + 1)), pairs[:, 1].copy(), times, weights)
        found = counted.where(F.size("terms") > 0).mapInArrow(_ranked(spark.sparkContext.broadcast(asked), top, documents, all_terms), "item long, item_id long, doc_id long, score long")
        some = best(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), top, "item", "part").drop("rank")
        parts.append(best(some, top, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
