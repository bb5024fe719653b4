"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, met by each document's windows.

Every benchmark item gives its windows of `n` consecutive words (an item with fewer words, but not none, is one
window). The hash set holds the hash of each window; its size is checked before it is broadcast, and beyond the bound the
same join runs shuffled. Every window of a document is hashed, at each length that the benchmark has, and looked up. Rows that
go through this join are a number for the row, a place and a hash, never texts.

Hashes of windows are built by doubling: those of 1, 2, 4 and 8 words from each other, and those of any other length from two
overlapping windows of the next lower power of two. So a place costs four hashes, not one for each word of its window.

Places that meet the set are verified: the words that stand there are cut out of the texts of the rows concerned, and
count where a window of the benchmark has the same words.

Defined cases: null texts have no words and no hits; a document shorter than the window can only be hit by items of at
most its own length; null doc_ids and repeated rows give a row each; an empty benchmark hits nothing; an
empty table gives no rows; other columns are ignored by `scan` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import MAX_KEYS, checkpointed, packed, without_rows

WINDOW = 10
#: What words are made of, and what stands between them.
INSIDE, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes that may be broadcast: about 60 MB as a hash table; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Places to verify that may be broadcast to where the texts are: about 15 MB.
MAX_PLACES = 500_000


def words_of(text: Column) -> Column:
    """Words as they stand; lower-casing A-Z changes no boundary."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"{INSIDE}+"), F.lit(0))


def row_key() -> Column:
    """One number for doc_id and text: rows that share it are repeats of each other."""
    return F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))


def exact(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def paired(hashes: Column, shift: int) -> Column:
    """Each hash of a list taken together with that `shift` places on."""
    n = F.greatest(F.size(hashes) - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))


def with_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Add `hashed` to rows with `words`: an array for each of `lengths`, of the hashes of all windows of so many words by their
    place. Hashes are equal where words are equal but for case; the verification looks at A-Z alone."""
    rows = rows.withColumn("g1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    power = 1
    while 2 * power <= max(lengths, default=1):
        rows = rows.withColumn(f"g{2 * power}", paired(F.col(f"g{power}"), power))
        power *= 2
    parts = []
    for k in lengths:
        half = 1 << (k.bit_length() - 1)
        parts.append(F.col(f"g{half}") if half == k else paired(F.col(f"g{half}"), k - half))
    return rows.withColumn("hashed", F.array(*parts)).drop(*[f"g{1 << i}" for i in range(power.bit_length())])


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, len and run (its words) of every window of each benchmark item."""
    own = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    cut = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, n))).alias("run"))
    return cut.select("item_id", F.size("run").alias("len"), "run")


def hashed_windows(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """hash, run (lower-case words, joined) and items (the item_ids that have it, as strings) of each different window."""
    hashed = with_windows(windows.withColumnRenamed("run", "words"), lengths)
    own = F.get(F.get("hashed", F.array_position(F.lit(lengths), F.col("len")).cast("int") - 1), F.lit(0))
    rows = hashed.select(own.alias("hash"), exact(F.col("words")).alias("run"), F.col("item_id").cast("string").alias("item"))
    return rows.groupBy("hash", "run").agg(F.collect_set("item").alias("items"))


def _places(found: Column, lengths: list[int], n_words: Column) -> Column:
    """Where windows stand (at, len and hash), from their numbers (pos, hash) when the windows of all lengths are laid end to end."""
    def place(p: Column) -> Column:
        before, at, length = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
        for k in lengths:
            own = F.greatest(n_words - k + 1, F.lit(0))
            inside = at.isNull() & (p["pos"] < before + own)
            at, length = F.when(inside, p["pos"] - before).otherwise(at), F.when(length.isNull() & (p["pos"] < before + own), k).otherwise(length)
            before = before + own
        return F.struct(at.alias("at"), length.alias("len"), p["hash"].alias("hash"))

    return F.transform(found, place)


def met_places(parsed: DataFrame, known: DataFrame, broadcast: bool) -> DataFrame:
    """doc_id, row_key, n_words and met (number and hash of the windows whose hash is in `known`) of each row of `parsed`.

    With a broadcast set, hash 0 at number -1 stands for the row itself, which so comes through the join once whatever it holds;
    being broadcast, the set makes no hot key of it. Shuffled, there is no such mark, and rows are joined to what they met."""
    n_words, entry = F.size("words").cast("bigint").alias("n_words"), F.struct("pos", "hash")
    if broadcast:
        table = F.broadcast(known.where("hash <> 0").union(parsed.sparkSession.range(1).select(F.lit(0).cast("bigint"))))
        every = F.concat(F.array(F.lit(0).cast("bigint")), F.flatten("hashed"))
        rows = parsed.select("doc_id", "row_key", n_words, F.posexplode(every).alias("pos", "hash")).join(table, "hash").withColumn("pos", F.col("pos") - 1)
        by_row = rows.groupBy("doc_id", "row_key", "n_words").agg(
            F.count_if(F.col("pos") < 0).alias("copies"), F.collect_set(F.when(F.col("pos") >= 0, entry)).alias("met"))
        return by_row.select("doc_id", "row_key", "n_words", "met", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("col")
    rows = parsed.select("row_key", F.posexplode(F.flatten("hashed")).alias("pos", "hash")).join(known.hint("merge"), "hash", "left_semi")
    by_row = rows.groupBy("row_key").agg(F.collect_set(entry).alias("met"))
    none = F.array().cast(by_row.schema["met"].dataType)
    return parsed.select("doc_id", "row_key", n_words).join(by_row, "row_key", "left").withColumn("met", F.coalesce("met", none))


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, row_key, n_words, hits (the word numbers hit, sorted) and items (their ids, sorted as strings)."""
    windows = checkpointed(item_windows(items, n))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [n]  # n values at most
    listed = checkpointed(hashed_windows(windows, lengths))
    known = listed.select("hash").distinct()
    parsed = with_windows(docs.select(F.col("doc_id"), row_key().alias("row_key"), words_of(F.col("text")).alias("words")), lengths)
    rows = checkpointed(met_places(parsed, known, known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST))
    some = rows.where(F.size("met") > 0).dropDuplicates(["row_key"]).select("row_key", "met")
    n_rows, n_places = some.agg(F.count("*"), F.coalesce(F.sum(F.size("met") + 4), F.lit(0))).first()
    texts = docs.select(row_key().alias("row_key"), "text")
    if n_places > MAX_PLACES and n_rows <= MAX_KEYS:  # the keys alone keep the other texts where they are
        texts = texts.join(F.broadcast(some.select("row_key")), "row_key", "left_semi")
    # Words are cut out before places are taken apart, so that no text is copied for each place.
    texts = texts.join(F.broadcast(some) if n_places <= MAX_PLACES else some, "row_key").withColumn("words", words_of(F.col("text")))
    places = texts.withColumn("places", _places(F.col("met"), lengths, F.size("words")))
    runs = F.transform("places", lambda p: F.struct(p["hash"].alias("hash"), p["at"].alias("at"), p["len"].alias("len"), exact(F.slice(F.col("words"), p["at"] + 1, p["len"])).alias("run")))
    verified = places.select("row_key", F.inline(runs)).join(listed, ["hash", "run"])
    place = F.struct("at", "len", "items")
    found = verified.groupBy("row_key").agg(F.collect_set(place).alias("found"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda p: F.sequence(p["at"], p["at"] + p["len"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda p: p["items"]))))
    found = found.select("row_key", covered.alias("hits"), ids.alias("items"))
    return rows.select("doc_id", "row_key", "n_words").join(found, "row_key", "left").select(
        "doc_id", "row_key", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, remove: str = "documents") -> DataFrame:
    """`docs` without what the benchmark holds: whole documents with any hit, or only the words hit (`remove="spans"`).

    With spans, a hit word goes with what stands between it and the next word; n_chars, if there is such a column,
    follows the new text. Documents without hits are left alone.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    hit = scan(docs, items, n).where(F.size("hits") > 0).select("row_key", "hits").dropDuplicates(["row_key"])
    keyed = docs.select(packed(docs, "doc"), row_key().alias("row_key"))
    if remove == "documents":
        return without_rows(keyed, checkpointed(hit.select("row_key")), "row_key").select("doc.*")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    lead = F.regexp_extract(text, f"^{BETWEEN}*", 0)
    pieces = F.filter(F.regexp_extract_all(text, F.lit(f"{INSIDE}+{BETWEEN}*"), F.lit(0)), lambda _, i: ~F.array_contains("hits", i))
    out = keyed.join(hit, "row_key", "left").withColumn("left", F.concat(lead, F.array_join(pieces, "")))
    changed = {"text": F.col("left"), "n_chars": F.char_length("left").cast("bigint")}
    doc = F.col("doc")
    for name in [c for c in docs.columns if c in changed]:
        doc = doc.withField(name, F.when(F.col("hits").isNull(), F.col(f"doc.{name}")).otherwise(changed[name]))
    return out.select(doc.alias("doc")).select("doc.*")
