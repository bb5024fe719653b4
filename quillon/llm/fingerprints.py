"""Document fingerprints by a randomised edit embedding.

A shared random walk maps a text to a longer string: at step j the character under the pointer is written down, and a
shared random bit, looked up by j and the character, says whether the pointer moves on. Two texts a few edits apart fall
back into step soon after each edit, so their edit distance shows as a Hamming distance between the walks. The walk runs
over the whole text; a fingerprint keeps four bits of what it wrote at sampled steps. Steps are sampled by nested
levels (each level keeps a random half of the one below), a text of n characters at the level that leaves 256 to 512
of its about 2n steps, so that fingerprints of texts of different lengths compare at the coarser of their levels.

Texts walk in batches: one step moves the pointers of all texts of a batch.

`near_duplicates` bands the sampled bits into keys, verifies what meets under a key by `likeness`, and names groups;
`edit_fingerprints` returns each row's group with it. Short lists of a key give all their pairs. Longer ones (templates, common
openings) are walked breadth first, each fingerprint compared with all that are not taken yet, so that no link of a list is lost and
no pairs leave a task; lists of the same fingerprints are walked once, and lists of more than LONG in parts, every two of which
are a task.

Defined cases: a null text counts as empty; an empty text's fingerprint has no samples, is wholly like another empty
one and unlike all else; rows that repeat a doc_id follow each other by their text's hash; null doc_ids come last; a
sole row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._common import MAX_KEYS, checkpointed, text_or_empty
from quillon.llm.simhash import components

SAMPLES = 256
ROWS_A, ROWS_B = 4096, 4093
#: Steps between two looks at which texts have ended.
STRIDE = 64
MAX_LEVEL = 60
ROWS_PER_BUCKET, MAX_BUCKETS = 2048, 16384
NOBODY = -(2**63)


def _shared() -> tuple[np.ndarray, np.ndarray]:
    """Random moves by step and character class: a row of one table xor a row of the other, of coprime heights."""
    draw = np.random.default_rng(1)
    return draw.integers(0, 2, (ROWS_A, 256), np.int64), draw.integers(0, 2, (ROWS_B, 256), np.int64)


def step_levels(first: int, count: int) -> np.ndarray:
    """Levels of the steps from `first` on: the trailing zeros of a hash of the step's number (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.arange(first, first + count, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        low = x & (~x + np.uint64(1))
    return np.minimum(np.bitwise_count(low - np.uint64(1)), MAX_LEVEL).astype(np.int8)


def level_of(n_chars: int) -> int:
    return max(0, (2 * n_chars // SAMPLES).bit_length() - 1)


def classes(codes: np.ndarray) -> np.ndarray:
    """Character classes: the code point itself below 256, a hash of it above."""
    high = codes >= 256
    if high.any():
        codes = np.where(high, (codes * np.uint32(2654435761)) >> np.uint32(24), codes)
    return codes.astype(np.uint8)


#: Four bits of each class.
NIBBLE = np.random.default_rng(2).permutation(np.repeat(np.arange(16, dtype=np.uint8), 16))


def walk(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (character classes): the samples (0 to 15) at its own level, and the levels of their steps."""
    rows_a, rows_b = _shared()
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(2 * STRIDE, np.uint8)])
    ends = np.cumsum(sizes)
    own_level = np.array([level_of(int(n)) for n in sizes], np.int8)
    alive = np.flatnonzero(sizes)
    alive = alive[np.argsort(own_level[alive], kind="stable")]  # texts that sample a step are then the first so many
    at, stop, own = (ends - sizes)[alive], ends[alive], own_level[alive]
    who, what, step_level = [], [], []
    first, levels = 0, step_levels(0, 1 << 16)
    j = 0
    while alive.size:
        if j + STRIDE > first + len(levels):
            first, levels = j, step_levels(j, 1 << 16)
        least = own[0]
        for j in range(j, j + STRIDE):
            char = flat.take(at, mode="clip")
            level = levels[j - first]
            if level >= least:
                n = int(np.searchsorted(own, level, "right"))
                inside = at[:n] < stop[:n]
                who.append(alive[:n][inside])
                what.append(char[:n][inside])
                step_level.append(np.full(len(who[-1]), level, np.int8))
            at += (rows_a[j % ROWS_A] ^ rows_b[j % ROWS_B]).take(char)
        j += 1
        on = at < stop
        if not on.all():
            alive, at, stop, own = alive[on], at[on], stop[on], own[on]
    if not who:
        return [(np.zeros(0, np.uint8), np.zeros(0, np.int8))] * len(texts)
    owner = np.concatenate(who)
    order = np.argsort(owner, kind="stable")
    samples, marks = NIBBLE[np.concatenate(what)[order]], np.concatenate(step_level)[order]
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [(samples[a:b], marks[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def likeness(x: tuple[np.ndarray, np.ndarray], x_level: int, y: tuple[np.ndarray, np.ndarray], y_level: int) -> float:
    """Share of equal samples at the coarser of both levels; steps that only one text reaches count as unequal."""
    level = max(x_level, y_level)
    a = x[0][x[1] >= level] if level > x_level else x[0]
    b = y[0][y[1] >= level] if level > y_level else y[0]
    longer = max(len(a), len(b))
    if not longer:
        return 1.0 if x_level == y_level else 0.0
    both = min(len(a), len(b))
    return int(np.count_nonzero(a[:both] == b[:both])) / longer


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def shown(samples: np.ndarray, level: int) -> str:
    """A fingerprint as text: two digits for the level, then one hex digit for each sample."""
    return f"{level:02d}" + HEX[samples].tobytes().decode()


#: By level, the levels of the first steps sampled there, and how many steps were looked at.
SAMPLED: dict[int, tuple[np.ndarray, int]] = {}


def sampled(level: int, count: int) -> np.ndarray:
    """Levels of the first `count` steps that are sampled at a level."""
    marks, first = SAMPLED.get(level, (np.zeros(0, np.int8), 0))
    while len(marks) < count:
        levels = step_levels(first, 1 << 16)
        marks, first = np.concatenate([marks, levels[levels >= level]]), first + (1 << 16)
        SAMPLED[level] = marks, first
    return marks[:count]


def parsed(fingerprint: str) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Samples, the levels of their steps, and the level of a fingerprint in text form."""
    level, digits = int(fingerprint[:2]), np.frombuffer(fingerprint[2:].encode(), np.uint8)
    samples = np.where(digits >= 97, digits - 87, digits - 48).astype(np.uint8)
    return (samples, sampled(level, len(samples))), level


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fingerprints(batches):
    """The text, which comes last, gives way to n_chars and fingerprint."""
    for batch in batches:
        keys, last = batch.schema.names[:-1], batch.num_columns - 1
        texts = [classes(code_points(t or "")) for t in batch.column(last).to_pylist()]
        found = [shown(s, level_of(len(t))) for t, (s, _) in zip(texts, walk(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())], [*keys, "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_or_empty(F.col("text")))
    return rows.mapInArrow(_fingerprints, "doc_id long, n_chars long, fingerprint string")


BAND = 12
#: Lists of up to ALL fingerprints give all their pairs; longer ones are walked, and dealt into parts of about LONG beyond that.
ALL, LONG = 9, 4096
LEAST = 0.8


def bands(fingerprint: str) -> list[int]:
    """Key of each band of a fingerprint, at its own level and at the next coarser one."""
    (samples, marks), own = parsed(fingerprint)
    keys = []
    for level in (own, own + 1):
        kept = samples[marks >= level].tobytes()
        places = range(0, max(len(kept) - BAND, 0) + 1, BAND) if kept else ()
        keys += [hashlib.blake2b(kept[p : p + BAND] + b"%d:%d" % (level, p), digest_size=8).digest() for p in places]
    return np.frombuffer(b"".join(keys), "<i8").tolist()


def _banded(batches):
    for batch in batches:
        rows = [(key, node) for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for key in bands(text)]
        columns = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node"])


def _met(batches):
    """From rows (key, node) sorted by both: a < b for the pairs of short lists; for longer ones each node as a, without b, and the key."""
    names = ["a", "b", "key"]

    def settled(keys: np.ndarray, nodes: np.ndarray):
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        long = np.repeat(sizes := np.diff(np.append(starts, len(keys))), sizes) > ALL
        a, b = [], []
        short, own = keys[~long], nodes[~long]
        for shift in range(1, ALL):
            same = np.flatnonzero((short[shift:] == short[:-shift]) & (own[shift:] != own[:-shift]))
            a.append(own[same]), b.append(own[same + shift])
        a, b = np.concatenate(a), np.concatenate(b)
        none = np.concatenate([np.zeros(len(a), bool), np.ones(int(long.sum()), bool)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.minimum(a, b), nodes[long]])), pa.array(np.concatenate([np.maximum(a, b), nodes[long]]), mask=none), pa.array(np.concatenate([np.zeros(len(a), np.int64), keys[long]]), mask=~none),
        ], names)

    wait = [np.zeros(0, np.int64)] * 2  # the list under way
    long = None  # its key, if it is known to be a long one
    for batch in batches:
        keys, nodes = (np.concatenate([w, c.to_numpy()]) for w, c in zip(wait, batch.columns, strict=True))
        if long is not None:
            lead = int(np.count_nonzero(keys == long))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[:lead]), pa.nulls(lead, pa.int64()), pa.array(keys[:lead])], names)
            keys, nodes = keys[lead:], nodes[lead:]
        if not len(keys):
            wait = [keys, nodes]
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        long = keys[-1] if len(keys) - cut > ALL else None
        yield from settled(keys[: cut if long is None else None], nodes[: cut if long is None else None])
        wait = [keys[cut:], nodes[cut:]] if long is None else [keys[:0], nodes[:0]]
    if len(wait[0]):
        yield from settled(*wait)


class Table:
    """Fingerprints of one list, so laid out that one is compared with many: 16 samples to a word, at the coarsest level of all and,
    for those that are finer, at their own. The levels of a list are two at most."""

    ONES = np.uint64(0x1111111111111111)

    def __init__(self, prints: list[str]):
        read = [parsed(p) for p in prints]
        self.own = np.array([level for _, level in read])
        self.top = int(self.own.max())
        self.at = {level: self._laid([samples[marks >= level] if own <= level else samples[:0] for (samples, marks), own in read]) for level in set(self.own.tolist())}

    def _laid(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        width = max(1, -(-int(sizes.max()) // 16)) * 16
        table, valid = np.zeros((len(rows), width), np.uint8), np.zeros((len(rows), width), np.uint8)
        for i, r in enumerate(rows):
            table[i, : len(r)], valid[i, : len(r)] = r, 1
        return *((x[:, ::2] | (x[:, 1::2] << 4)).view(np.uint64) for x in (table, valid)), sizes

    def alike(self, one: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which of `others` have a likeness of `least` or more to `one`, each at the coarser of both levels."""
        good = np.zeros(len(others), bool)
        for level, (words, valid, sizes) in self.at.items():
            mine = np.flatnonzero(np.maximum(self.own[others], self.own[one]) == level)
            if not mine.size:
                continue
            them = others[mine]
            x = words[them] ^ words[one]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            unlike = np.bitwise_count(x & valid[them] & valid[one]).sum(axis=1, dtype=np.int64)
            longer = np.maximum(sizes[them], sizes[one])
            good[mine] = np.minimum(sizes[them], sizes[one]) - unlike >= np.maximum(least * longer - 1e-9, 1)
        return good

    def edges(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Edges that keep the linked together: each one takes, breadth first, all that are like it and not taken yet. A group's
        edges are heap-shaped: few at each, few steps between any two."""
        left, a, b = np.arange(len(self.own)), [], []
        while left.size:
            group, todo, left = [left[:1]], [left[0]], left[1:]
            while todo and left.size:
                hit = self.alike(todo.pop(), left, least)
                group.append(left[hit])
                todo.extend(left[hit])
                left = left[~hit]
            members = np.concatenate(group)
            a.append(members[(np.arange(1, len(members)) - 1) // 2]), b.append(members[1:])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(least: float):
    """Of rows a, b and both fingerprints (number of digits, bytes), the pairs that are alike enough."""
    def run(batches):
        for batch in batches:
            pairs = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            kept = pa.array([likeness(*parsed(x.hex()[:n]), *parsed(y.hex()[:m])) >= least for n, x, m, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return run


def _walked(least: float):
    """From rows (key, node, digits, bytes) sorted by key, a list to a key: edges a < b."""
    def settled(rows: pa.Table):
        nodes = rows.column("node").to_numpy()
        found = Table([x.hex()[:n] for n, x in zip(rows.column("size").to_pylist(), rows.column("bytes").to_pylist(), strict=True)]).edges(least)
        a, b = (nodes[x] for x in found)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if wait and high > low and wait[-1].column("key")[0].as_py() != keys[low]:
                    yield settled(pa.Table.from_batches(wait))
                    wait = []
                wait += [batch.slice(low, high - low)] if high > low else []
        if wait:
            yield settled(pa.Table.from_batches(wait))

    return run


def long_lists(long: DataFrame, size: int = LONG) -> DataFrame:
    """key and node of the tasks in which long lists (key, node) are walked: lists of the same nodes once, those of over `size` in
    parts, every two of them a task."""
    sums = long.groupBy("key").agg(F.count("*").alias("n"), *[F.expr(f"bit_xor(xxhash64({i}, node))").alias(f"x{i}") for i in (0, 1)])
    once = checkpointed(sums.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / size).cast("int").alias("parts")))
    few = once.limit(MAX_KEYS + 1).count() <= MAX_KEYS
    placed = long.join(F.broadcast(once) if few else once, "key")
    whole = placed.where("parts = 1").select("node", "key")
    parts = placed.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A part is walked with every other one, so that it needs no task of its own.
    every = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
    return whole.unionAll(every.select("node", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key")))


def links(distinct: DataFrame, least: float, size: int = LONG) -> DataFrame:
    """Edges a < b that keep together the fingerprints (node, fingerprint) that share a band and are alike: all pairs of short lists
    are verified, longer ones are walked whole."""
    even = F.when(F.length("fingerprint") % 2 == 1, F.concat("fingerprint", F.lit("0"))).otherwise(F.col("fingerprint"))
    marks = distinct.select("node", F.struct(F.length("fingerprint").alias("size"), F.unhex(even).alias("bytes")))
    listed = distinct.select("node", "fingerprint").mapInArrow(_banded, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    found = checkpointed(listed.mapInArrow(_met, "a long, b long, key long"))
    met = found.where("b is not null").select("a", "b").distinct().join(marks.toDF("a", "x"), "a").join(marks.toDF("b", "y"), "b")
    digits = [c for side in ("x", "y") for c in (f"{side}.size", f"{side}.bytes")]
    near = met.select("a", "b", *digits).toDF("a", "b", "x", "x_bytes", "y", "y_bytes").mapInArrow(_verified(least), "a long, b long")
    dealt = long_lists(found.where("b is null").select("key", F.col("a").alias("node")), size)
    rows = dealt.join(marks.toDF("node", "mark"), "node").select("key", "node", "mark.size", "mark.bytes")
    walked = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_walked(least), "a long, b long")
    return near.unionAll(walked)


def _owners(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash (of the text), fingerprint and node of each row, and component_id of each node."""
    text = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = rows.mapInArrow(_fingerprints, "doc_id long, hash long, n_chars long, fingerprint string")
    marked = checkpointed(marked.select("doc_id", "hash", "fingerprint", F.xxhash64("fingerprint").alias("node")))
    distinct = checkpointed(marked.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least")))
    label = components(links(distinct, least))
    named = distinct.join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    owner = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # Written out, so that a fingerprint that many rows share can be split when rows are joined to it.
    return marked, checkpointed(named.join(owner, "label").select("node", "component_id"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links lead to) of each row. Documents link when they share a
    band of samples and their fingerprints are at least `least` alike; equal fingerprints always do.

    Only different fingerprints are banded."""
    marked, owners = _owners(docs, least)
    return marked.join(owners, "node").select("doc_id", "fingerprint", "component_id")


def _bucketed(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows dealt to buckets by falling doc_id. The first rows of each bucket are also put, as guests, after the last
    of the bucket before, and those of the first bucket after the very last: each row finds its next one in its bucket.
    Before each row, without a text, goes the component_id that `groups` (doc_id, hash) has for it."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NOBODY)).alias("id"), text_or_empty(F.col("text")).alias("text"))
    n = rows.select("id").count()
    buckets = min(MAX_BUCKETS, max(1, n // ROWS_PER_BUCKET))
    cuts = rows.agg(F.max("id").alias("top"), F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets).alias("cuts")).first()
    bounds = sorted({cuts["top"], *(cuts["cuts"] if buckets > 1 else [])} - {None}, reverse=True) or [NOBODY]
    last, table = len(bounds) - 1, F.lit(bounds)

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
        right = F.get(table, middle) >= F.col("id")
        return F.struct(F.when(right, middle).otherwise(span["low"]).alias("low"), F.when(right, span["high"]).otherwise(middle - 1).alias("high"))

    turns = F.lit(list(range(math.ceil(math.log2(last + 1)) + 1)))
    bucket = F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.lit(last).alias("high")), halve, lambda s: s["low"])
    placed, named = rows.withColumn("bucket", bucket), groups.select(F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), "hash", "component_id").withColumn("bucket", bucket)
    guest = F.get(table, F.col("bucket")) == F.col("id")
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("place", F.explode(F.when(guest, F.array(here, there)).otherwise(F.array(here))))
    none = F.lit(None)
    texts = dealt.select("place.bucket", "place.guest", "id", F.xxhash64("text").alias("hash"), "text", none.cast("bigint").alias("component_id"))
    every = texts.unionByName(named.select("bucket", F.lit(False).alias("guest"), "id", "hash", none.cast("string").alias("text"), "component_id"))
    return (
        every.repartition(last + 1, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), "hash", F.isnotnull("text"))
        .select("bucket", "guest", "id", "text", "component_id")
    )


def _edited(batches):
    """Rows of _bucketed: for each that is no guest, its text, the edited text, and the fingerprints of both and of the next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    wait: list[tuple[int, bool, int, str, int | None]] = []
    component = None
    for batch in batches:
        rows = wait
        for *row, named in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[3] is None:
                component = named
            else:
                rows.append((*row, component))
        wait = rows[-1:]
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not own:
            continue
        points = [code_points(r[3]) for r in rows]
        edits = []
        for i in own:
            text, following = points[i], points[i + 1]
            cut = len(text) // 3
            edits.append(np.concatenate([text[: len(text) - cut], following[:cut]]))
        marks = walk([classes(p) for p in points] + [classes(p) for p in edits])
        levels = [level_of(len(p)) for p in points]
        out = []
        for k, i in enumerate(own):
            level, mark = level_of(len(edits[k])), marks[len(rows) + k]
            out.append((
                None if rows[i][2] == NOBODY else rows[i][2], len(points[i]),
                hashlib.sha256(edits[k].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(),
                shown(marks[i][0], levels[i]), shown(mark[0], level),
                likeness(marks[i], levels[i], mark, level), likeness(marks[i], levels[i], marks[i + 1], levels[i + 1]), rows[i][4],
            ))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text, whose last third is the start of the next document by
    falling doc_id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; and
    component_id, the row's group by `near_duplicates`."""
    marked, owners = _owners(docs, LEAST)
    return _bucketed(docs, marked.select("doc_id", "hash", "node").join(owners, "node").select("doc_id", "hash", "component_id")).mapInArrow(
        _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    )
