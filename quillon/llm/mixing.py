"""Mixing sources to target weights.

Each source's words (its documents in a fixed order) are cut into blocks of fixed length. The output has shards of a fixed number
of slots, a block each, and every shard draws how many of its slots go to each source: multinomial counts, by the number of
blocks that meet the source's target. A source's slots are numbered across shards by running sums of these counts, and its k-th slot
takes the block at permutation(k mod blocks), a keyed Feistel permutation of the source's block numbers, so that no block comes up
a second time before all have come up once. Drawn block numbers are joined with the blocks by number.

What a source is given so is near its target, the nearer the more blocks it has. Where it is off by over SLACK (few blocks),
or would be taken over `most` times, the source is held to its target; see `drawn_blocks`.

All is arithmetic over (document, size) rows until the end: texts move only when `mixed` cuts them out.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating. They share `share` of all words by weight,
no source more than `most` times its words, the excess going to the others by weight (a water level found by sorting).

Defined cases: a null text has no words, is never drawn and gets no rows in `mixed`; null and empty sources are two
sources; repeated rows hold words of their own; an empty table, or one without words, mixes to nothing; other columns
are ignored by `plan` and kept by `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._common import MAX_KEYS, checkpointed, packed, permuted, row_hash, running_start

BLOCK = 128
SHARE, MOST = 1.5, 2
WEIGHTS = (3, 1, 2)
SHARD_BLOCKS = 8192
TOKEN = r"[^\x20\x09-\x0D]+"
#: A token with the white space before it: joined, such pieces give the text back.
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
CHUNK, CHUNKS_PER_TASK = 4096, 4
#: Chunks of the numbers to draw from that are broadcast: some 20 MB.
MAX_CHUNKS = 200_000
#: How far off its draws a source may be, as a share of them.
SLACK = 0.02


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _sized(docs: DataFrame) -> DataFrame:
    row = row_hash(docs)
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKEN)).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"), row.alias("row"),
        F.col("source").cast("string"), _source_key(F.col("source")).alias("key"), size.alias("size"),
    )


def targets(sized: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """key, source_size, weight, target, blocks and draws of each source of rows (key, source, size), and first: how many draws the
    sources before it have. All windows here are over one row for each source."""
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.row_number().over(order) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    # Sources fill up in order of most * size / weight; the level is what is left over the weight of those not full.
    rising = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= most * F.col("source_size") / F.col("weight"))
    found = levels.withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    cap = most * F.col("source_size")
    target = F.least(cap, F.coalesce(F.col("water") * F.col("weight"), cap)).cast("double")
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    draws = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), most * F.col("blocks")).cast("bigint")
    return (
        found.withColumn("target", target).withColumn("blocks", blocks)
        .withColumn("draws", F.when(F.col("source_size") > 0, draws).otherwise(F.lit(0).cast("bigint")))
        .withColumn("first", F.sum("draws").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("draws"))
        .select("key", "source_size", "weight", "target", "blocks", "draws", "first")
    )


def _chosen_sources(sources: DataFrame, total: int, seed: int) -> DataFrame:
    """place and key of every slot of all shards: each slot draws its source by weight, so that a shard's counts are multinomial.

    A draw is a number below `total`, of which each source owns a run; runs are cut at every CHUNK numbers, and looked up by the chunk."""
    runs = sources.where("draws > 0").withColumn("end", F.col("first") + F.col("draws"))
    cut = runs.select("key", "end", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))).alias("chunk"))
    table = cut.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("end", "key"))).alias("owners"))
    few = total <= CHUNK * MAX_CHUNKS and sources.limit(MAX_CHUNKS + 1).count() <= MAX_CHUNKS
    some = F.broadcast(table) if few else table
    slots = sources.sparkSession.range(0, total, 1, max(1, -(-total // (CHUNK * CHUNKS_PER_TASK))))
    drawn = slots.select(F.col("id").alias("place"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total).cast("bigint")).alias("draw"))
    owner = F.get(F.filter("owners", lambda o: o["end"] > F.col("draw")), F.lit(0))["key"]
    return drawn.withColumn("chunk", F.floor(F.col("draw") / CHUNK)).join(some, "chunk").select("place", owner.alias("key"))


def drawn_blocks(sources: DataFrame, seed: int = 8, shard_blocks: int = SHARD_BLOCKS, most: float = MOST) -> DataFrame:
    """key, draw, shard, slot and block of every draw. Shards have `shard_blocks` slots, the last one what is left.

    Counts of each shard and source are summed up over the shards, which numbers a source's slots; its k-th slot takes the block at
    permutation(k mod blocks). A source whose slots are off its draws by over SLACK, or beyond `most` times its blocks, is held
    to its draws: its surplus slots go to sources held up to theirs, stay empty where none is, and where they do not suffice slots
    are added after the last one."""
    total = sources.agg(F.sum("draws")).first()[0] or 0
    chosen = checkpointed(_chosen_sources(sources, total, seed).withColumn("shard", F.floor(F.col("place") / shard_blocks)))
    counts = checkpointed(chosen.groupBy("shard", "key").agg(F.count("*").alias("n")))
    start = running_start(counts, counts.count(), ["key"], ["shard"], "n", "start").select("shard", "key", "start")
    met = sources.join(counts.groupBy("key").agg(F.sum("n").alias("met")), "key", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    off = (F.abs(F.col("met") - F.col("draws")) > SLACK * F.col("draws")) | (F.col("met") > most * F.col("blocks"))
    order = W.orderBy("first", "key").rowsBetween(W.unboundedPreceding, -1)  # over one row for each source
    held = met.where("draws > 0").withColumn("held", F.when(off, F.col("draws")).otherwise(F.col("met")))
    held = held.withColumn("spare", F.greatest(F.col("met") - F.col("held"), F.lit(0))).withColumn("lack", F.greatest(F.col("held") - F.col("met"), F.lit(0)))
    held = checkpointed(held.select("key", "blocks", "met", "held", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("spare", "lack")], "lack", F.sum("spare").over(W.partitionBy()).alias("spares")))
    nth = F.row_number().over(W.partitionBy("shard", "key").orderBy("place")) - 1
    # A key is a source, of which one may have a third of all slots; a shard and a source together have a shard's slots at most.
    numbered = chosen.withColumn("nth", nth).join(start, ["shard", "key"]).select("place", "key", (F.col("start") + F.col("nth")).alias("draw"))
    few = held.limit(MAX_KEYS + 1).count() <= MAX_KEYS
    numbered = numbered.join(F.broadcast(held) if few else held, "key")
    kept = numbered.where("draw < held").select("key", "draw", "blocks", "place")
    given = numbered.where("draw >= held").select((F.col("spare_before") + F.col("draw") - F.col("held")).alias("turn"), "place")
    lacks = held.where("lack > 0").select("key", "blocks", "lack_before", "met", "spares", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lack") - 1)).alias("i"))
    lacks = lacks.select("key", (F.col("met") + F.col("i")).alias("draw"), "blocks", (F.col("lack_before") + F.col("i")).alias("turn"), "spares")
    place = F.coalesce("place", F.lit(total) + F.col("turn") - F.col("spares"))
    filled = lacks.join(given, "turn", "left").select("key", "draw", "blocks", place.alias("place"))
    block = permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.xxhash64("key", F.lit(seed)))
    return kept.unionAll(filled).select(
        "key", "draw", F.floor(F.col("place") / shard_blocks).cast("int").alias("shard"), (F.col("place") % shard_blocks).cast("int").alias("slot"), block.alias("block")
    )


def shard_counts(docs: DataFrame, seed: int = 8, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """shard, source key and blocks: the source counts drawn for each output shard."""
    return drawn_blocks(targets(_sized(docs)), seed, shard_blocks).groupBy("shard", "key").agg(F.count("*").alias("blocks"))


def plan(docs: DataFrame, seed: int = 8, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Per row of `docs` and block that holds words of it: doc_id, row, nth (of equal rows), size, source_size, target,
    from_word, n_words and slots (shard and slot of each time the mix takes them, at most `most` times rounded up).
    Rows without words have one such row, without slots."""
    sized = checkpointed(_sized(docs))
    sources = checkpointed(targets(sized, block=block))
    drawn = drawn_blocks(sources, seed, shard_blocks).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("slots"))
    nth = F.row_number().over(W.partitionBy("key", "id", "row").orderBy("key", "id", "row"))
    placed = running_start(sized.withColumn("nth", nth), sized.count(), ["key"], ["key", "id", "row"], "size", "start")
    end = F.col("start") + F.col("size")
    inside = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    cut = placed.join(sources.select("key", "source_size", "target"), "key").select(
        "doc_id", "row", "nth", "key", "size", "source_size", "target", "start", F.explode_outer(F.when(F.col("size") > 0, inside)).alias("block")
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = cut.withColumn("from_word", low - F.col("start")).withColumn("n_words", F.coalesce(high - low, F.lit(0)))
    none = F.array().cast(drawn.schema["slots"].dataType)
    # Spark takes exploded rows for as few as they came from and would broadcast them.
    return pieces.join(drawn.hint("merge"), ["key", "block"], "left").select(
        "doc_id", "row", "nth", "size", "source_size", "target", "from_word", "n_words", F.coalesce("slots", none).alias("slots")
    )


def taken(docs: DataFrame, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards of each row: how many words of it the mix takes, and how many output
    shards get some."""
    by_row = plan(docs, seed).groupBy("row", "nth", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.col("n_words") * F.size("slots")).cast("bigint").alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("slots.shard")))).cast("bigint").alias("shards")
    )
    return by_row.select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixed(docs: DataFrame, seed: int = 8, by_shard: bool = False, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix as rows with the columns of `docs`: for each time a document's words are taken, those words in order.

    With `by_shard` what goes to different output shards stands in rows of its own, with mix_shard and mix_slot (that of its first
    block) after the columns of `docs`. A document taken whole keeps its text as it is. Where blocks are left out, the text is
    what the blocks taken hold, with the white space before each word; n_chars, if there is such a column, follows.
    """
    cuts = plan(docs, seed, shard_blocks=shard_blocks).select("row", "nth", "size", "from_word", "n_words", F.posexplode("slots").alias("turn", "at"))
    shard = F.col("at.shard") if by_shard else F.lit(None).cast("int")
    copies = cuts.groupBy("row", "nth", "turn", shard.alias("mix_shard")).agg(
        F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("cuts"), (F.sum("n_words") == F.max("size")).alias("whole"), F.min("at.slot").alias("mix_slot")
    )
    keyed = docs.select(packed(docs, "doc"), row_hash(docs).alias("row"))
    # Equal rows are the same text: the copies of all of them are cut out of one.
    first = keyed.withColumn("same", F.row_number().over(W.partitionBy("row").orderBy("row"))).where("same = 1").drop("same")
    out = copies.join(first.hint("merge"), "row")
    words = F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(PIECE), F.lit(0))
    picked = F.flatten(F.transform("cuts", lambda c: F.slice("words", (c["from_word"] + 1).cast("int"), c["n_words"].cast("int"))))
    out = out.withColumn("words", F.when(~F.col("whole"), words)).withColumn("picked", F.when(F.col("whole"), F.col("doc.text")).otherwise(F.array_join(picked, "")))
    shown = {"text": F.col("picked"), "n_chars": F.char_length("picked").cast("bigint")}
    doc = F.col("doc")
    for name in [c for c in docs.columns if c in shown]:
        doc = doc.withField(name, shown[name])
    out = out.select(doc.alias("doc"), "mix_shard", "mix_slot")
    return out.select("doc.*", *(["mix_shard", "mix_slot"] if by_shard else []))
