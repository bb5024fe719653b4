"""Secret scan over a trigram index.

Every rule is a regular expression. A Boolean query over trigrams is derived from it: an OR of ANDs of trigrams
(of the lower-cased text) of which any match must contain one whole AND. The index lists, for each trigram that
some query names, the rows whose text has it; postings are intersected per row, and only rows that pass a rule's
query are verified with its expression. Rules without a mandatory trigram are verified on every row.

Spans are found without any per-row code: splitting a text at the matches gives the gaps, extracting them gives the
matches, and running sums of both lengths give the places, in code points.

Defined cases: a null text counts as empty; rows that repeat doc_id and text each give a row; null doc_ids are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of `pattern` count when group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules, then the further ones.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # the same matches as [0-9a-f]+ of 24 characters or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
]

Query = frozenset[frozenset[str]]
#: True of every text.
ANY: Query = frozenset([frozenset()])
MOST_STRINGS = 64


def _simple(query: Query) -> Query:
    return frozenset(q for q in query if not any(p < q for p in query))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS:
        return a  # weaker, so still right
    return _simple(frozenset(p | q for p, q in product(a, b)))


def _of_strings(strings: set[str]) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


#: What a piece of an expression matches: all its strings (lower-cased; None: too many to tell), and its query.
Piece = tuple[set[str] | None, Query]
FEW, MANY = 8, 1 << 16


class _Reader:
    """Reads an expression once, from left to right. It knows literals, classes, groups, alternatives and repeats, which is all that
    rules use; anything else raises."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self, wanted: str = "") -> str:
        """The next character, passed over if it is one of `wanted` (or if that is empty)."""
        char = self.text[self.at : self.at + 1]
        if char and (not wanted or char in wanted):
            self.at += 1
            return char
        return ""

    def branches(self) -> Piece:
        parts = [self.sequence()]
        while self.next("|"):
            parts.append(self.sequence())
        whole = None if any(s is None for s, _ in parts) else set().union(*[s for s, _ in parts])
        return whole, _simple(frozenset().union(*[q for _, q in parts]))

    def sequence(self) -> Piece:
        run, query, exact = {""}, ANY, True
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            strings, own = self.repeated()
            if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, strings)}
            else:
                query, run, exact = _both(_both(query, _of_strings(run)), own), {""}, False
        whole = _both(query, _of_strings(run))
        return (run if exact else None), whole

    def repeated(self) -> Piece:
        strings, query = self.atom()
        mark = self.next("?*+{")
        low, high = {"": (1, 1), "?": (0, 1), "*": (0, MANY), "+": (1, MANY), "{": (1, 1)}[mark]
        if mark == "{":
            bounds = self.text[self.at : self.text.index("}", self.at)]
            self.at += len(bounds) + 1
            first, comma, last = bounds.partition(",")
            low = int(first or 0)
            high = int(last) if last else MANY if comma else low
        if high > 1:
            strings = None
        elif low == 0 and strings is not None:
            strings = strings | {""}
        return strings, query if low else ANY

    def atom(self) -> Piece:
        char = self.next()
        if char == "(":
            if self.next("?") and not self.next(":"):
                raise ValueError(f"no rule for the group at {self.at} in {self.text!r}")
            found = self.branches()
            self.next(")")
            return found
        if char == "[":
            return self.one_of(), ANY
        if char in "^$":
            raise ValueError(f"no rule for {char} in {self.text!r}")
        return (None if char == "." else {self.escaped() if char == "\\" else char.lower()}), ANY

    def escaped(self) -> str:
        char = self.next()
        if char == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16)).lower()
        if char.isalnum():
            raise ValueError(f"no rule for \\{char} in {self.text!r}")
        return char

    def one_of(self) -> set[str] | None:
        """The characters of a class; None if they are more than a few, or all but some."""
        found, other = set(), bool(self.next("^"))
        while not self.next("]"):
            low = self.next()
            low = self.escaped() if low == "\\" else low
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found |= {chr(c).lower() for c in range(ord(low), ord(self.next()) + 1)}
            else:
                found.add(low.lower())
        return None if other or len(found) > FEW else found


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of trigrams: every text in which `pattern` matches holds, lower-cased, all of one AND. ANY if it has no mandatory trigram."""
    return _Reader(pattern.removeprefix("(?i)")).branches()[1]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: trigram and row_key, for the trigrams asked for."""
    low = F.lower("text")
    own = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("row_key", F.explode(own).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """row_key and the numbers of the rules whose trigram query its text passes, for rows that pass any."""
    terms = [
        (rule, number, trigram, 1 << bit, (1 << len(chosen)) - 1)
        for rule, r in enumerate(rules)
        if (query := trigram_query(r.pattern)) != ANY
        for number, conjunction in enumerate(sorted(query, key=sorted))
        for chosen in [sorted(conjunction)[:60]]  # fewer trigrams let more rows pass, never fewer
        for bit, trigram in enumerate(chosen)
    ]
    asked = docs.sparkSession.createDataFrame(terms, "rule int, number int, trigram string, bit long, all long")
    met = postings(docs, sorted({t[2] for t in terms})).join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    met = met.groupBy("row_key", "rule", "number", "all").agg(F.bit_or("bit").alias("bits")).where("bits = all")
    return met.groupBy("row_key").agg(F.collect_set("rule").alias("rules"))


def found_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row of `docs`: doc_id and spans, an array of (start, rule, end) in code points, sorted; rule is a number in `rules`."""
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("row_key"))
    passed = candidates(rows, rules)
    scanned = [i for i, r in enumerate(rules) if trigram_query(r.pattern) == ANY]
    joined = rows.join(passed, "row_key", "left").withColumn("row", F.monotonically_increasing_id())
    none = F.array(F.struct(F.lit(-1).alias("rule"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("good")))
    hits = [none] + [
        F.when(F.lit(i in scanned) | F.coalesce(F.array_contains("rules", i), F.lit(False)), _hits(r, i)).otherwise(F.array().cast(HIT))
        for i, r in enumerate(rules)
    ]
    exploded = joined.select("row_key", "row", "doc_id", F.inline(F.concat(*hits)))
    # Everything from here on happens within the partitions of the join by row_key.
    so_far = W.partitionBy("row_key", "row", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = exploded.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end")
    return placed.groupBy("row_key", "row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("spans")).select("doc_id", "spans")


HIT = "array<struct<rule:int,nth:int,gap:int,size:int,good:boolean>>"


def _hits(rule: Rule, number: int) -> Column:
    """All matches of a rule in `text`: the length of the gap before each, its own, and whether it is long enough."""
    gaps, matches = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    gap_sizes = F.transform(gaps, F.char_length)

    def hit(match: Column, pair: Column) -> Column:
        part = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(
            F.lit(number).alias("rule"), pair.alias("nth"), F.lit(0).alias("gap"), F.char_length(match).alias("size"),
            (F.char_length(part) >= rule.least).alias("good"),
        )

    return F.zip_with(
        F.slice(gap_sizes, F.lit(1), F.size(matches)), F.transform(matches, hit),
        lambda gap, h: F.struct(h["rule"].alias("rule"), h["nth"].alias("nth"), gap.alias("gap"), h["size"].alias("size"), h["good"].alias("good")),
    )


def digest(spans: Column, rules: list[Rule] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.lit([r.kind for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
