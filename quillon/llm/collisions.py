"""Near-duplicate vectors by counting collisions under many sorted one-dimensional projections.

Every vector, scaled to unit length, is projected on TABLES random directions. Under each direction the vectors of a list are
sorted, and a window of fixed width is laid around each of them: two vectors collide where one stands in the other's window. Two
vectors of cosine c are sqrt(2 - 2c) apart, and so far times a normal variable apart under a direction, so how often a pair
just alike enough collides is known: pairs with at least LEAST collisions are verified by their cosine in double precision,
and as many directions are drawn as give such a pair that count with odds of RECALL.

Windows under one direction hold a fixed share of all vectors, so that alone they would give work that grows with the
square of the table. So the vectors sorted together under a direction are those of equal label, length, and signs under a few
more random directions of its own, as many as leave lists of about LIST vectors; how often signs agree is known too (one less
the angle over pi, for each), and is part of the odds. Small tables have one list for each label and direction.

A pair that meets under a direction is worked on there alone where that is the first one it collides under, which both its
vectors' marks show. So no pair leaves a task: each task gives for every vector the number of its links, and a forest that joins the
linked ones. Equal vectors of a label are compared once, with the number of their copies. Lists of more than LONG vectors are
dealt into parts, and every two parts are compared by a task of their own, so that none is ever cut short.

Defined cases: vectors without a label, and those that are null, empty, zero, or hold a null, NaN or infinity, link with nothing
and are groups of their own; vectors of different lengths do not link; repeated rows are linked copies, each with a row; a
null vec_id never names a group unless all of its group are null (then the group's is null, and its rows are kept);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import MAX_KEYS, checkpointed
from quillon.llm.simhash import components

COSINE = 0.98
#: Vectors of a list that are sorted together, on average; lists of over LONG are dealt into parts of about so many.
LIST, LONG = 512, 4096
#: Half a window, in standard deviations of how far two vectors just alike enough lie apart under a direction.
HALF = 1.5
#: Collisions that a pair needs, and the odds that a pair just alike enough has them.
LEAST, RECALL = 3, 0.9998


@dataclass(frozen=True)
class Scheme:
    """Signs to a list, directions (tables), half a window, and the collisions that a pair needs."""

    bits: int
    tables: int
    window: float
    least: int


def at_least(count: int, draws: int, odds: float) -> float:
    """Odds of `count` successes or more in so many draws."""
    return 1 - sum(math.comb(draws, i) * odds**i * (1 - odds) ** (draws - i) for i in range(count))


def scheme(rows: int, cosine: float = COSINE, recall: float = RECALL, size: int = LIST) -> Scheme:
    """The scheme for labels of up to `rows` different vectors."""
    apart = math.sqrt(max(2 - 2 * cosine, 1e-12))
    bits = max(0, math.ceil(math.log2(max(rows, 1) / size)))
    odds = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(HALF / math.sqrt(2))
    tables = LEAST
    while at_least(LEAST, tables, odds) < recall:
        tables += 1
    return Scheme(bits, tables, HALF * apart, LEAST)


def directions(dim: int, plan: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Random directions of each table: one to sort by, and those whose signs tell lists apart."""
    draw = np.random.default_rng([11, dim])
    return draw.standard_normal((dim, plan.tables)), draw.standard_normal((dim, plan.tables, plan.bits)).reshape(dim, -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; first by their largest component, so that no square runs over."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; there is no null among them."""
    sizes = np.asarray(column.value_lengths())
    if not len(sizes):
        return []
    if (sizes == sizes[0]).all():
        return [(np.arange(len(sizes)), column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1))]
    return [(at := np.flatnonzero(sizes == n), column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for n in np.unique(sizes)]


def _marks(plan: Scheme):
    """Adds to rows (node, kind, copies, embedding) the signs (a long for each table) and the projections."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            signs, places = np.zeros((n, plan.tables), np.int64), np.zeros((n, plan.tables), np.float32)
            for at, x in rows_of(batch.column("embedding")):
                sort_by, planes = directions(x.shape[1], plan)
                unit = scaled(x.astype(np.float64))
                places[at] = unit @ sort_by
                if plan.bits:
                    over = ((unit @ planes) > 0).reshape(len(at), plan.tables, plan.bits)
                    signs[at] = over @ (1 << np.arange(plan.bits, dtype=np.int64))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * plan.tables)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (signs, places)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "kind", "copies", "embedding")), *lists], ["node", "kind", "copies", "embedding", "signs", "places"])

    return run


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make rows i and j of each pair have the same root, the least row of all that are joined."""
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def forest(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a tree for each group, heap-shaped: few edges at each row, few steps between any two."""
    order = np.argsort(root, kind="stable")
    sorted_ = root[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    first = np.repeat(starts, np.diff(np.append(starts, len(root))))
    place = np.arange(len(root)) - first
    inner = place > 0
    return order[(first + (place - 1) // 2)[inner]], order[inner]


def linked(key, table, side, copies, signs, places, vectors, plan: Scheme, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of lists (all vectors of one length): copies that each row links to by pairs that first collide here, and roots.

    Rows are sorted by list, then by their projection; one step compares each row with that so many places on, for as long as
    windows reach. Rows of side 0 meet all of their list, those of sides 1 and 2 only each other."""
    own = places[np.arange(len(key)), table]
    order = np.lexsort((own, key))
    key, table, side, copies, signs, places, own = (x[order] for x in (key, table, side, copies, signs, places, own))
    unit = scaled(vectors[order].astype(np.float64))
    links, root = np.zeros(len(key), np.int64), np.arange(len(key))
    one, shift = np.arange(len(key)), 0
    while True:
        shift += 1
        one = one[one < len(key) - shift]
        one = one[(key[one + shift] == key[one]) & (own[one + shift] - own[one] <= plan.window)]
        if not one.size:
            break
        i = one[(side[one] == 0) | (side[one] != side[one + shift])]
        j = i + shift
        hit = (signs[i] == signs[j]) & (np.abs(places[i] - places[j]) <= plan.window)
        good = (hit.argmax(axis=1) == table[i]) & (hit.sum(axis=1) >= plan.least)
        i, j = i[good], j[good]
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[good], j[good]
        links[i] += copies[j]
        links[j] += copies[i]
        joined(root, i, j)
    back_links, back_root = np.empty_like(links), np.empty_like(root)
    back_links[order], back_root[order] = links, order[root]
    return back_links, back_root


def _compared(plan: Scheme, cosine: float):
    """From rows sorted by key: (a, null, number) for what a vector links to, (a, b, 0) for edges that keep groups together."""
    names = ["key", "t", "side", "node", "kind", "copies", "signs", "places", "embedding"]

    def settled(rows: pa.Table):
        key = rows.column("key").to_numpy()
        edge = key[1:] == key[:-1]
        met = np.concatenate((edge, [False])) | np.concatenate(([False], edge))
        rows = rows.filter(pa.array(met)).combine_chunks()
        if not rows.num_rows:
            return
        whole = {c: rows.column(c).combine_chunks() for c in names}
        wide = {c: whole[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, plan.tables) for c in ("signs", "places")}
        flat = {c: whole[c].to_numpy(zero_copy_only=False) for c in ("key", "t", "side", "node", "kind", "copies")}
        for at, vectors in rows_of(whole["embedding"]):
            key = np.unique(np.stack([flat["key"][at], flat["kind"][at]]), axis=1, return_inverse=True)[1].ravel()  # of a list, and of a label for certain
            links, root = linked(key, flat["t"][at], flat["side"][at], flat["copies"][at], wide["signs"][at], wide["places"][at], vectors, plan, cosine)
            node, some = flat["node"][at], np.flatnonzero(links)
            up, down = forest(root)
            a, b = np.concatenate([node[some], node[up]]), np.concatenate([node[some], node[down]])
            none = np.concatenate([np.ones(len(some), bool), np.zeros(len(up), bool)])
            counts = np.concatenate([links[some], np.zeros(len(up), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none), pa.array(counts)], ["a", "b", "links"])

    def run(batches):
        wait: list[pa.RecordBatch] = []  # what came of the list under way
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (wait and wait[-1].column("key")[-1].as_py() != key[0]):
                yield from settled(pa.Table.from_batches([*wait, batch.slice(0, cut)]))
                wait = []
            wait.append(batch.slice(cut))
        if wait:
            yield from settled(pa.Table.from_batches(wait))

    return run


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: components, all of them finite, not all zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def compared(kinds: DataFrame, plan: Scheme, cosine: float, long: int = LONG) -> DataFrame:
    """Rows of `_compared` for different vectors (node, kind, copies, embedding), where kind tells label and length."""
    marks = "node long, kind long, copies long, embedding array<%s>, signs array<long>, places array<float>"
    element = kinds.schema["embedding"].dataType.elementType.simpleString()
    marked = checkpointed(kinds.mapInArrow(_marks(plan), marks % element))
    tables = F.sequence(F.lit(0), F.lit(plan.tables - 1))
    keys = F.transform(tables, lambda t: F.xxhash64("kind", t, F.get("signs", t)))
    longer = checkpointed(marked.select(F.explode(keys).alias("key")).groupBy("key").count().where(F.col("count") > long).select("key", F.ceil(F.col("count") / long).cast("int").alias("parts")))
    rows = marked.select("*", F.posexplode(keys).alias("t", "key"))
    number = longer.limit(MAX_KEYS + 1).count()
    side = F.lit(0)
    if number:
        dealt = rows.join(F.broadcast(longer) if number <= MAX_KEYS else longer, "key", "left")
        parts = F.coalesce("parts", F.lit(1))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        side = F.when(F.col("part") < F.col("other"), 1).when(F.col("part") > F.col("other"), 2).otherwise(0)
        rows = dealt.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    rows = rows.select("key", "t", side.alias("side"), "node", "kind", "copies", "signs", "places", "embedding")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(plan, cosine), "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, long: int = LONG, size: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `vectors` (vec_id, embedding, label)."""
    own = vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label")
    works = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = own.where(works).select("vec_id", "embedding", F.xxhash64("label", F.size("embedding")).alias("kind"), F.xxhash64("label", "embedding").alias("x"), F.xxhash64(F.lit(1), "embedding", "label").alias("y"))
    same = rows.groupBy("x", "y").agg(F.first("kind").alias("kind"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    kinds = checkpointed(same.withColumn("node", F.monotonically_increasing_id()))
    largest = kinds.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    found = checkpointed(compared(kinds.select("node", "kind", "copies", "embedding"), scheme(largest, cosine, size=size), cosine, long))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    label = components(found.where("b is not null").select("a", "b"))
    named = kinds.select("x", "y", "node", "copies", "least").join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = checkpointed(named.select("x", "y", "label", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # Written out, so that both sides of the last join are shuffled for it and a vector that many rows share can be split.
    owners = checkpointed(named.join(least, "label").select("x", "y", "n_links", "component_id"))
    out = rows.select("vec_id", "x", "y").join(owners, ["x", "y"]).select("vec_id", "n_links", "component_id")
    rest = own.where(~works).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
