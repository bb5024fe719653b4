"""Entity spans of a raw question, and decoding of bytes: per-row helpers where regular expressions alone do not do."""

from __future__ import annotations

import codecs
import re
import string

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillon.functions.text import STOPWORDS

# Connectors within names, words that open sentences, adjectives of origin, quotes, lengths.
CONNECTORS = frozenset("of de der den van von di da du del della la le the al el ibn bin mac mc".split())
OPENERS = frozenset(STOPWORDS) | frozenset(
    (
        "after during besides despite following according roughly approximately considering imagine suppose let's i've i'm i'd we're we've they're"
        " you're he's she's it's that's there's what's who's"
    ).split()
)
ORIGINS = frozenset(
    (
        "african american ancient arab asian australian austrian belgian brazilian british canadian chinese christian communist czech danish dutch egyptian"
        " english european french german greek hindu indian irish islamic israeli italian japanese jewish korean latin medieval muslim nazi norwegian"
        " persian polish portuguese russian scottish serbian soviet spanish swedish swiss turkish welsh western"
    ).split()
)
LEAST_CHARS, MOST_CHARS = 3, 60

#: Characters of a word, and what may close a quotation or bracket after a sentence's end.
IN_WORD, CLOSERS = "'’-_", "\"'‘’“”)"
#: Kinds of quotation marks: what opens, what closes, and what may not stand inside.
QUOTES = (("“\"", "”\"", "“”\""), ("‘", "’", "‘’"), ("'", "'", "'"))
LEAST_QUOTED, MOST_QUOTED = 2, 80
EDGES = string.punctuation + "‘’“”…€£₹ \t"


def _plain(word: str) -> str:
    return word.lower().replace("’", "'").replace("‘", "'")


def _trimmed(span: str) -> str:
    span = " ".join(span.split()).strip(EDGES)
    return span[:-2].strip(EDGES) if _plain(span).endswith("'s") else span


def _capitalised(token: str) -> list[tuple[int, int]]:
    """Offsets of the words in a token that begin with a capital A to Z, each up to the first character no word holds."""
    found, i = [], 0
    while i < len(token):
        if "A" <= token[i] <= "Z" and not (i and (token[i - 1].isalnum() or token[i - 1] == "_")):
            end = i + 1
            while end < len(token) and (token[end].isalnum() or token[end] in IN_WORD):
                end += 1
            found.append((i, end))
            i = end
        i += 1
    return found


def names(question: str) -> list[tuple[int, str, bool]]:
    """Where names stand, the names, and whether they open a sentence. A name goes on over white space from one capitalised word to
    the next, and over one connector between them."""
    found: list[list] = []
    on, bridged, before = False, False, ""  # whether the last name may go on, whether a connector stands after it
    for m in re.finditer(r"\S+", question):
        at, token = m.start(), m[0]
        words = _capitalised(token)
        if on and words and words[0][0] == 0:
            found[-1][1] = at + words[0][1]
            last, words = words[0], words[1:]
        elif on and not bridged and token in CONNECTORS:
            bridged = True
            before = token
            continue
        else:
            last = None
        opens = at == 0 or before.rstrip(CLOSERS)[-1:] in tuple(".!?")
        for word in words:
            found.append([at + word[0], at + word[1], opens and word[0] == 0])
            last = word
        on, bridged, before = last is not None and last[1] == len(token), False, token
    return [(a, question[a:b], opens) for a, b, opens in found]


def quotations(question: str) -> list[tuple[int, str]]:
    """Where quotations stand, and what they hold. Straight single quotes count between words only, as they may be apostrophes."""
    found, at = [], 0
    while at < len(question):
        for opening, closing, never in QUOTES:
            if question[at] not in opening:
                continue
            end = next((i for i in range(at + 1, min(len(question), at + MOST_QUOTED + 2)) if question[i] in never), None)
            if end is None or question[end] not in closing or end - at - 1 < LEAST_QUOTED:
                continue
            beside = question[max(at - 1, 0) : at] + question[end + 1 : end + 2]
            if opening == "'" and any(c.isalnum() or c in "_'‘’" for c in beside):
                continue
            found.append((at, question[at + 1 : end]))
            at = end
            break
        at += 1
    return found


def entity_spans(question: str, most: int = 4, terms: bool = False) -> list[str]:
    """Names and quotations in a question, the surest first, at most `most`; with `terms`, distinctive words after them.

    A run of capitalised words, or a quotation, beats single capitalised words, which then do not count. A word that only opens
    a sentence is no part of a name, and an adjective of origin is none by itself."""
    found: list[tuple[int, int, str]] = []

    def offer(sure: int, at: int, span: str) -> None:
        if LEAST_CHARS <= len(span) <= MOST_CHARS and span.lower() not in STOPWORDS:
            found.append((-sure, at, span))

    for at, name, opens in names(question):
        words = _trimmed(name).split()
        if words and opens and _plain(words[0]) in OPENERS:
            words = _trimmed(" ".join(words[1:])).split()
        if len(words) == 1 and _plain(words[0]) in ORIGINS:
            continue
        offer(2 if len(words) > 1 else 1, at, " ".join(words))
    for at, quoted in quotations(question):
        offer(2, at, _trimmed(quoted))
    if terms:
        for m in re.finditer(r"\w+", question):
            if len(m[0]) >= 4 and _plain(m[0]) not in OPENERS | ORIGINS:
                offer(0, m.start(), m[0])
    if any(sure == -2 for sure, _, _ in found):
        found = [f for f in found if f[0] != -1]
    kept: list[str] = []
    covered: set[str] = set()
    for _, _, span in sorted(found, key=lambda f: f[:2]):
        if len(kept) < most and span.lower() not in covered:
            kept.append(span)
            covered |= {span.lower(), *map(_plain, span.split())}
    return kept


def with_entity_spans(rows: DataFrame, column: str, most: int = 4, terms: bool = False) -> DataFrame:
    """`rows` (flat columns) with `spans`: the names and quotations in a column."""
    names_, place = rows.columns, rows.columns.index(column)

    def run(batches):
        for batch in batches:
            found = [entity_spans(q or "", most, terms) for q in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*names_, "spans"])

    return rows.mapInArrow(run, S.StructType([*rows.schema.fields, S.StructField("spans", S.ArrayType(S.StringType()))]))


DECLARED = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decoded(content: bytes, is_html: bool = True) -> str:
    """Text of bytes: by a byte-order mark, else by what the page declares in its first 4096 bytes, else as UTF-8 if it is
    that, else as Windows-1252, else as Latin-1."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    declared = DECLARED.search(content[:4096]) if is_html else None
    for name in [declared[1].decode() if declared else "", "utf-8", "cp1252"]:
        try:
            if name:
                return content.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("latin-1")
