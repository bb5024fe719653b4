"""SimHash near-duplicates with pivot distance tables.

Each text gives a 64-bit fingerprint: a bit is set when over half of the text's word-shingle hashes (XXH64, seed 42)
have it. Fingerprints link when at most `radius` bits differ; documents of linked fingerprints form groups.

Links are sought between different fingerprints only, so copies cost nothing. Each fingerprint's row of the pivot distance
table, its Hamming distances to shared reference fingerprints (pivots), is worked out once and goes with it: |d(x,p) - d(y,p)|
never exceeds d(x,y), so a pair whose largest coordinate difference is above the radius is discarded without being compared,
and the bits of the survivors are counted.

Pivots discard pairs, but they cannot bring pairs together at scale: distances to a pivot spread by 4 bits about 32, so a
window of 4 either way keeps 57 % of all pairs at each pivot, and a fingerprint listed under the cells of one pivot that
may hold its partners is listed 1.8 times. Every further pivot multiplies lists by what it saves in comparisons, at any cell width. So
pairs meet in lists first: with radius 4 and 7 blocks of bits, two linked fingerprints agree in at least 3 blocks, and each
fingerprint is listed under its 35 triples of blocks; no link is lost. Within a list the pivot table decides which pairs
are compared. A list is walked breadth first, each fingerprint taking its unvisited neighbours, and gives only
enough edges to keep its groups together, never all pairs. Lists of more than LONG fingerprints are not walked by one task:
they are dealt into parts of that size, and every two parts are walked by a task of their own.

A radius of 4 among 64 bits finds copies with hardly an edit. `near_copies`, which `keep_one` goes by, links those groups further,
where texts are alike at 0.8 or more: by Jaccard likeness of their different shingles of five words, words being what is left
without ASCII punctuation and case. Such texts differ in up to 15 % of the bits of a fingerprint of those shingles, which 64 bits
tell too coarsely and no pivot can discard; so there it has 256 bits, and links at WIDE_RADIUS of them. To meet, texts are listed under
samples of the bits of a second fingerprint, of shingles of two words, in which an edit changes less: as many bits as leave
lists short, and as many lists as texts alike at 0.8 need to share one with odds of 0.99. So a link may be missed there by chance,
never by the length of a list.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; null
doc_ids are members but never name a group (a group of nulls has a null id); repeated rows each give a row; an empty
table gives no rows; other columns are ignored. For `near_copies` a text without words is its own sole shingle.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._common import checkpointed, grown, in_few, packed, removed, shared_folder, without_rows, written

SHINGLE = 4
RADIUS = 4
BLOCKS = 7
PIVOTS = 16
#: Lists of up to this many fingerprints are compared side by side; longer ones are walked one at a time.
SHORT = 16
#: Longer lists are dealt into parts of about so many.
LONG = 8192
CHUNK = 1 << 16
#: Pivots whose distances fit one long, a byte each.
PER_LONG = 8
#: Longs of the fingerprint that near copies are told by, and of the one that brings them together, with the words of their shingles.
WIDE, WIDE_SHINGLE, MEET, MEET_SHINGLE = 4, 5, 2, 2
#: Texts alike at 0.8 differ in 39 bits of 256 on average, 13 more being 2.3 standard deviations.
WIDE_RADIUS = 52
#: Share of equal bits of the meeting fingerprints that lists are laid out for, and the odds of sharing one.
ALIKE, ODDS = 0.9, 0.99
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()  # bytes.lower() and split() know ASCII letters and white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), CHUNK):
        cuts = zip(first[i : i + CHUNK].tolist(), last[i : i + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], 42) for a, b in cuts], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view("<u8")[0])


def mixed_up(x: np.ndarray) -> np.ndarray:
    """Each number sent to another, one to one, so that every bit depends on all (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the different shingles of a text, from hashes of its words; of fewer words, the whole sequence's."""
    k = min(shingle, len(words))
    n = len(words) - k + 1
    sums = np.zeros(n, np.uint64)
    for i in range(k):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(mixed_up(sums))


def wide_bits(hashes: np.ndarray, longs: int) -> np.ndarray:
    """A fingerprint of so many longs: a bit is set when over half of the hashes, sent on once for each long, have it."""
    votes = np.zeros(64 * longs, np.int64)
    salts = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for i in range(0, len(hashes), CHUNK // 4):
        sent = mixed_up(hashes[i : i + CHUNK // 4, None] + salts)
        bits = np.unpackbits(sent.view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)  # 255 fit a byte
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: bytes | None) -> np.ndarray:
    """MEET longs of two-word shingles, then WIDE longs of five-word shingles."""
    words = WORD.findall((text or b"").lower()) or [text or b""]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.concatenate([wide_bits(shingle_set(hashes, MEET_SHINGLE), MEET), wide_bits(shingle_set(hashes, WIDE_SHINGLE), WIDE)])


MEET_LONGS, WIDE_LONGS = [f"m{i}" for i in range(MEET)], [f"w{i}" for i in range(WIDE)]


def _wide(batches):
    """Rows (doc_id, row_key, text) with both kinds of fingerprints in place of the text."""
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2).cast(pa.large_binary())]
        fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        wide = np.array([wide_fingerprint(t) for t in texts], np.uint64).reshape(-1, MEET + WIDE).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(fps), *[pa.array(np.ascontiguousarray(c)) for c in wide.T]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "fp", *MEET_LONGS, *WIDE_LONGS])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "row_key", "fp"])


def row_key() -> Column:
    """One number for doc_id and text: rows that share it are repeats of each other."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and fp (the fingerprint's bits as a signed long) of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row_key"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def pivot_marks(pivots: int = PIVOTS) -> list[int]:
    """The reference fingerprints, as signed longs."""
    return np.random.default_rng(64).integers(-(2**63), 2**63, pivots, np.int64).tolist()


def with_pivots(fps: DataFrame) -> DataFrame:
    """fp and its row of the pivot distance table: longs p0, p1 and so on, a distance (0 to 64) in each byte."""
    marks, longs = pivot_marks(), []
    for i in range(0, len(marks), PER_LONG):
        packed_ = F.lit(0).cast("bigint")
        for k, mark in enumerate(marks[i : i + PER_LONG]):
            packed_ = packed_.bitwiseOR(F.call_function("shiftleft", F.bit_count(F.col("fp").bitwiseXOR(F.lit(mark))).cast("bigint"), F.lit(8 * k)))
        longs.append(packed_.alias(f"p{i // PER_LONG}"))
    return fps.select("fp", *longs)


def unpacked(longs: list[np.ndarray]) -> np.ndarray:
    """The table from its longs: a row for each fingerprint, a column for each pivot."""
    return np.stack(longs, axis=1).view(np.int8).reshape(len(longs[0]), -1)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The table of some fingerprints, worked out here."""
    marks = np.array(pivot_marks(), np.int64).view(np.uint64)
    return np.bitwise_count(fps[:, None] ^ marks[None, :]).astype(np.int8)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ, row by row; a row is one long or several."""
    bits = np.bitwise_count(x ^ y)
    return bits.sum(1, dtype=np.int64) if bits.ndim > 1 else bits


def near(fps: np.ndarray, table: np.ndarray, one: int, others: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Those of `others` (row numbers) linked to row `one`: pivots first, then the bits themselves."""
    for column in range(table.shape[1]):
        others = others[np.abs(table[others, column] - table[one, column]) <= radius]
        if not others.size:
            return others
    return others[differing(fps[others], fps[one]) <= radius]


def groups_of(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """Row numbers of each group of two or more among fingerprints of one list."""
    left, found = np.arange(len(fps)), []
    while left.size:
        members, todo, left = [left[:1]], [left[0]], left[1:]
        while todo and left.size:
            hit = near(fps, table, todo.pop(), left, radius)
            if hit.size:
                members.append(hit)
                todo.extend(hit)
                left = np.setdiff1d(left, hit, assume_unique=True)
        if len(members) > 1:
            found.append(np.concatenate(members))
    return found


def _edges_of_lists(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the nodes of rows of equal key; rows come sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    some = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
    k, n, f, t = keys[some], nodes[some], fps[some], table[some]
    for shift in range(1, SHORT):
        one = np.flatnonzero(k[shift:] == k[:-shift])
        if not one.size:
            break
        for column in range(t.shape[1]):
            one = one[np.abs(t[one + shift, column] - t[one, column]) <= radius]
        one = one[differing(f[one], f[one + shift]) <= radius]
        a.append(n[one]), b.append(n[one + shift])
    for i in np.flatnonzero(sizes > SHORT):
        own = slice(starts[i], starts[i] + sizes[i])
        for group in groups_of(fps[own], table[own], radius):  # a heap-shaped tree: few edges at each node, few steps between any two
            group = nodes[own][group]
            a.append(group[(np.arange(1, len(group)) - 1) // 2]), b.append(group[1:])
    return np.concatenate([*a, nodes[:0]]), np.concatenate([*b, nodes[:0]])


def _edges(limit: int | None, words: int, radius: int):
    """From rows (key, node, fingerprint in `words` longs, pivot distances) sorted by key: edges a < b between nodes. Without words the
    node is the fingerprint. A list cut by the end of a batch waits for its rest; one of more than `limit` rows is handed
    back instead: each node as a, without b, and the key."""
    names = ["a", "b", "key"]

    def batch(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names)

    def back(part):
        return batch(part[1], [None] * len(part[1]), part[0])

    def settled(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if not len(columns[0]):
            return
        _, place, sizes = np.unique(columns[0], return_inverse=True, return_counts=True)
        long = sizes[place] > (limit or len(place))
        if long.any():
            yield back([c[long] for c in columns])
        keys, nodes, *longs = (c[~long] for c in columns)
        fps = (np.stack(longs[:words], axis=1) if words else nodes).view(np.uint64)
        table = unpacked(longs[words:]) if longs[words:] else np.zeros((len(nodes), 0), np.int8)
        a, b = _edges_of_lists(keys, nodes, fps, table, radius)
        yield batch(np.minimum(a, b), np.maximum(a, b), [None] * len(a))

    def run(batches):
        wait: list[list[np.ndarray]] = []  # the list under way
        gone = None  # key of a list under way of which rows were handed back
        for rows in batches:
            columns = [c.to_numpy() for c in rows.columns]
            if gone is not None:
                lead = int(np.count_nonzero(columns[0] == gone))
                yield back([c[:lead] for c in columns])
                columns = [c[lead:] for c in columns]
            keys = columns[0]
            if not len(keys):
                continue
            gone = None
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if not cut and wait and wait[0][0][0] == keys[0]:
                wait.append(columns)
            else:
                yield from settled([*wait, [c[:cut] for c in columns]])
                wait = [[c[cut:] for c in columns]]
            if limit and sum(len(part[0]) for part in wait) > limit:
                yield from (back(part) for part in wait)
                wait, gone = [], keys[-1]
        if wait:
            yield from settled(wait)

    return run


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks (signed longs) of all choices of blocks - radius blocks: any link agrees under one of them at least."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    single = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    masks = [sum(m) for m in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links_of(table: DataFrame, keys: Column, words: int, radius: int, long: int = LONG) -> DataFrame:
    """Edges a < b that join the linked of `table` (node, then as for `_edges`; nodes differ) that share one of `keys`: enough of
    them for the groups."""
    own = [c for c in table.columns if c != "keys"]

    def walked(listed: DataFrame, limit: int | None) -> DataFrame:
        return listed.select("key", *own).repartition("key").sortWithinPartitions("key").mapInArrow(_edges(limit, words, radius), "a long, b long, key long")

    found = checkpointed(walked(table.select(*own, F.explode(keys).alias("key")), long).distinct())
    edges, rest = found.where("b is not null").select("a", "b"), found.where("b is null").select("key", F.col("a").alias("node"))
    if rest.isEmpty():
        return edges
    # Each part of a long list meets every other: a node goes to as many pairs of parts as its list has parts.
    parts = rest.groupBy("key").agg(F.ceil(F.count("*") / long).cast("int").alias("parts"))
    placed = rest.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = placed.select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = pairs.select("node", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    return edges.union(walked(dealt.join(grown(table.select(*own)), "node"), None).select("a", "b")).distinct()


def links(fps: DataFrame, long: int = LONG) -> DataFrame:
    """Edges a < b that join the linked among distinct fingerprints `fp`: enough of them for the groups."""
    table = checkpointed(with_pivots(fps).withColumnRenamed("fp", "node"))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks())])
    return links_of(table, keys, 0, RADIUS, long)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the group's name) of every node of `edges` (a, b: longs).

    Each round every node takes the least node around it as its parent, parents are followed to the top of their tree, and
    the edges are drawn anew between the tops, of which there are half as many at most. Every round is a few shuffles
    over what is left.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    try:
        return checkpointed(_components(edges, rounds, folder))
    finally:
        removed(spark, folder)


def _components(edges: DataFrame, rounds: int, folder: str) -> DataFrame:
    edges = written(edges.select("a", "b").where("a <> b").distinct(), folder)
    left = edges.count()
    most = 2 * left  # nodes
    edges = in_few(edges, left)
    label = written(in_few(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), most), folder)
    for _ in range(rounds):
        if not left:
            return label
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        parent = written(in_few(least, 2 * left), folder)
        while True:  # each pass halves the way to the top of a tree
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            higher = written(in_few(parent.join(grown(up), "p").select("v", "p", "q"), 2 * left), folder)
            parent = higher.select("v", F.col("q").alias("p"))
            if higher.where("p <> q").isEmpty():
                break
        named = label.join(grown(parent), F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label"))
        label = written(in_few(named, most), folder)
        pa_, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        drawn = edges.join(grown(pa_), "a").join(grown(pb), "b").where("pa <> pb")
        edges = written(in_few(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), left), folder)
        left = edges.count()
    raise RuntimeError("groups did not settle")


def labelled(distinct: DataFrame) -> DataFrame:
    """fp and label (its group's name) of distinct fingerprints `fp` that are linked to others."""
    label = components(links(distinct.select("fp")))
    return label.select(F.col("node").alias("fp"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp and component_id (the smallest doc_id that links lead to) of each row."""
    marked = checkpointed(fingerprints(docs))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = labelled(distinct).join(grown(distinct), "fp")
    least = named.groupBy("label").agg(F.min("least").alias("group_least"))
    grouped = named.join(grown(least), "label").select("fp", "group_least")
    # Written out, so that both sides of the last join are shuffled for it and a fingerprint that many rows share can be split.
    owners = checkpointed(distinct.join(grown(grouped), "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id")))
    return marked.join(grown(owners), "fp").select("doc_id", "row_key", "fp", "component_id")


def meeting_masks(rows: int) -> list[list[int]]:
    """Masks (signed longs, MEET for each list) that sample bits for `rows` different fingerprints."""
    bits = min(max(8, math.ceil(math.log2(max(rows, 2))) - 3), 48)
    count = math.ceil(math.log(1 - ODDS) / math.log(1 - ALIKE**bits))
    draw, masks = np.random.default_rng(3), []
    for _ in range(count):
        chosen = np.zeros(64 * MEET, np.uint8)
        chosen[draw.choice(64 * MEET, bits, replace=False)] = 1
        masks.append(np.packbits(chosen, bitorder="little").view("<i8").tolist())
    return masks


def wide_links(nodes: DataFrame) -> DataFrame:
    """Edges a < b between nodes (node, meeting and wide fingerprint) whose wide fingerprints link."""
    masks = meeting_masks(nodes.count())
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(MEET_LONGS, mask, strict=True)]) for i, mask in enumerate(masks)])
    return links_of(nodes.select("node", *WIDE_LONGS, keys.alias("keys")), F.col("keys"), WIDE, WIDE_RADIUS)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and component_id (the smallest doc_id that links lead to) of each row, by the links of `near_duplicates` and
    by those of texts alike at 0.8 or more."""
    texts = docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row_key"), F.col("text").cast("string"))
    schema = ", ".join(f"{c} long" for c in ["doc_id", "row_key", "fp", *MEET_LONGS, *WIDE_LONGS])
    marked = checkpointed(texts.mapInArrow(_wide, schema).withColumn("node", F.xxhash64(*WIDE_LONGS)))
    by_fp = labelled(marked.select("fp").distinct())
    # One row for each kind of wide fingerprint within a group: groups are joined where they share one, and where two link.
    kinds = marked.groupBy("fp", "node").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in [*MEET_LONGS, *WIDE_LONGS]])
    kinds = checkpointed(kinds.join(grown(by_fp), "fp", "left").withColumn("own", F.coalesce("label", "fp")).drop("label"))
    nodes = checkpointed(kinds.groupBy("node").agg(F.min("own").alias("first"), *[F.min_by(c, "fp").alias(c) for c in [*MEET_LONGS, *WIDE_LONGS]]))
    ends = nodes.select("node", "first")
    near_ = wide_links(nodes).join(grown(ends.toDF("a", "x")), "a").join(grown(ends.toDF("b", "y")), "b").select("x", "y")
    same = kinds.select("node", "own").distinct().join(grown(ends), "node").select(F.col("own").alias("x"), F.col("first").alias("y"))
    wider = components(near_.union(same).where("x <> y").toDF("a", "b")).withColumnRenamed("label", "wider")
    named = kinds.join(grown(wider), kinds.own == wider.node, "left").select("fp", kinds.node, "least", F.coalesce("wider", "own").alias("name"))
    least = named.groupBy("name").agg(F.min("least").alias("component_id"))
    owners = checkpointed(named.join(grown(least), "name").select("fp", "node", "component_id"))
    return marked.join(grown(owners), ["fp", "node"]).select("doc_id", "row_key", "component_id")


def hex_fingerprint(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group of `near_copies`: that with the smallest doc_id.

    Of rows that repeat its doc_id and text one stays. Of a group whose doc_ids are all null each text stays once. Texts
    stay where they are: only keys are shuffled, unless more rows go than may be broadcast.
    """
    found = near_copies(docs).select("row_key", F.expr("doc_id is distinct from component_id and component_id is not null").alias("goes"))
    counted = checkpointed(found.groupBy("row_key").agg(F.bool_or("goes").alias("goes"), F.count("*").alias("n")).where("goes or n > 1"))
    repeated = counted.where("not goes").select("row_key")
    keyed = docs.select(packed(docs, "doc"), row_key().alias("row_key"))
    stay = without_rows(keyed, counted.select("row_key"), "row_key").select("doc.*")
    if repeated.isEmpty():
        return stay
    nth = F.row_number().over(W.partitionBy("row_key").orderBy("row_key"))
    once = keyed.join(repeated, "row_key", "left_semi").withColumn("nth", nth).where("nth = 1").select("doc.*")
    return stay.unionAll(once)
