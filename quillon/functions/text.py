"""Text functions as Column expressions: tokens, terms, titles, sentences, snippets, clean-up, entry flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters, digits and underscores in any script.
TOKEN = r"[\p{L}\p{N}_]+"

# Stopwords, inert tokens, question words.
STOPWORDS = (
    "a an the and or of to in on at by for with from into is are was were be been being do does did doing have has had i you he she it we they"
    " this that these those my your me him her us them how what why who whom when where which whose explain tell about there here"
).split()
INERT = ["and", "or", "not", "near", "xor", "a", "an", "the", "+", "-", "*", '"']
QUESTION_WORDS = "what who how when where why which whose whom explain describe define tell list compare summarize calculate".split()
# Phrases of a refusal to answer.
ABSTAIN = [
    r"\bcould not find\b",
    r"\bcouldn't find\b",
    r"\bunable to find\b",
    r"\bno (?:relevant )?(?:information|passage|source)s? (?:were |was )?found\b",
    r"\bi don't have (?:that|this) information\b",
    r"\bnot (?:present|available) in (?:the|my) (?:available )?(?:archive|sources|corpus)\b",
    r"\bno mention\b",
    r"\bnot mentioned\b",
    r"\bdo(?:es)? not (?:contain|mention|include|provide)\b",
    r"\bcannot find\b",
    r"\bno information (?:about|on|regarding)\b",
]
# Entry flags, list titles, disambiguation marks.
REDIRECT, SOFT_REDIRECT, DISAMBIGUATION, LIST, STUB = 1, 2, 4, 8, 16
SKIPPED = REDIRECT | SOFT_REDIRECT | DISAMBIGUATION | LIST
LIST_TITLES = ["list of ", "lists of ", "timeline of ", "index of ", "glossary of "]
DISAMBIGUATION_MARKS = ["mw-disambig", "disambigbox", "dmbox"]
STUB_CHARS, SHELL_BYTES = 1200, 600


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without(terms: Column, words: list[str]) -> Column:
    """`terms` less `words`, unless nothing would be left."""
    left = F.filter(terms, lambda t: ~t.isin(words))
    return F.when(F.size(left) > 0, left).otherwise(terms)


def query_terms(text: Column) -> Column:
    """Lower-cased words of a query, without stopwords and inert tokens unless it has nothing else."""
    spaced = F.translate(F.lower(F.trim(text)), "?\"'", "   ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return without(without(words, STOPWORDS), INERT)


def ladder_terms(text: Column) -> Column:
    """Tokens of a query less inert ones."""
    return F.filter(tokens(text), lambda t: ~t.isin(INERT))


def search_terms(text: Column) -> Column:
    """Distinct tokens to search for: stopwords go unless there is nothing else."""
    return F.array_distinct(without(ladder_terms(text), STOPWORDS))


def is_question(text: Column, words: list[str] = QUESTION_WORDS) -> Column:
    return text.endswith("?") | F.lower(F.split(F.trim(text), r"\s+")[0]).isin(words)


def first_words(text: Column, n: int) -> Column:
    """The first n words of a text, a space between them; the rest is not looked at."""
    return F.regexp_replace(F.regexp_extract(text, rf"^\s*+((?:\S++\s++){{0,{n - 1}}}\S++)", 1), r"\s+", " ")


def strip_prefix(path: Column) -> Column:
    """A path less one leading ./ or /."""
    return F.regexp_replace(path, r"^(\./|/)", "")


def entry_title(path: Column) -> Column:
    return F.trim(F.translate(F.element_at(F.split(strip_prefix(path), "/"), -1), "_", " "))


def title_key(path: Column) -> Column:
    return F.lower(entry_title(path))


def match_path(path: Column) -> Column:
    """A path as evaluation compares it: trimmed, less one leading A/."""
    return F.regexp_replace(F.trim(path), "^A/", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s) != "")


def breadcrumb(title: Column, headings: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(title), headings), lambda h: F.coalesce(F.trim(h), F.lit("")) != ""), " > ")


def content_terms(text: Column) -> Column:
    """Runs of three or more ASCII letters and digits, lower-cased, less stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))


def word_bigrams(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def looks_abstained(answer: Column) -> Column:
    return (F.trim(answer) == "") | answer.rlike("(?i)" + "|".join(ABSTAIN))


def soft_redirect_target(html: Column) -> Column:
    """Target of a small page that only sends the reader on (a meta tag that refreshes, with seconds and a target in its content);
    null for any other."""
    tags = F.filter(F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), F.lit(0)), lambda t: t.rlike("""(?i)http-equiv\\s*=\\s*["']?refresh\\b"""))
    said = F.regexp_extract(F.get(tags, F.lit(0)), """(?is)\\bcontent\\s*=\\s*["']\\s*[0-9]+\\s*;\\s*(?:url\\s*=\\s*)?(.*)""", 1)
    mark = F.substring(said, 1, 1)
    bare = F.regexp_extract(said, """^[^"'\\s>]+""", 0)
    target = F.when(mark.isin('"', "'"), F.element_at(F.split(F.substr(said, F.lit(2)), mark), 1)).otherwise(bare)
    inside = F.trim(strip_prefix(F.regexp_replace(F.trim(target), r"^(\.\./)+", "")))
    return F.when((F.octet_length(html) <= SHELL_BYTES) & (target != ""), inside)


def entry_flags(title: Column, html: Column, is_redirect: Column, n_chars: Column) -> Column:
    name = F.lower(F.trim(title))
    start = F.substring(html, 1, 4096)
    marked = name.endswith("(disambiguation)")
    for mark in DISAMBIGUATION_MARKS:
        marked = marked | F.contains(start, F.lit(mark))
    listed = F.lit(False)
    for prefix in LIST_TITLES:
        listed = listed | name.startswith(prefix)

    def flag(when: Column, value: int) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), value).otherwise(0)

    return (
        flag(is_redirect, REDIRECT) + flag(soft_redirect_target(html).isNotNull(), SOFT_REDIRECT) + flag(marked, DISAMBIGUATION)
        + flag(listed, LIST) + flag((n_chars > 0) & (n_chars < STUB_CHARS), STUB)
    )


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def plain_text(text: Column) -> Column:
    lines = F.transform(_lines(text), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Lines of a WebVTT file that are no cue text: the header, notes, cue times, lone clock times, empty lines.
NO_CUE = r"(?im)^[ \t]*(?:webvtt(?: .*)?|note.*|.*-->.*|[0-9:.]*[0-9]:[0-9][0-9:.]*)?[ \t]*(?:\n|\z)"


def vtt_text(text: Column) -> Column:
    """Cue text of WebVTT: what is left when all other lines are struck out."""
    cues = F.regexp_replace(F.array_join(_lines(text), "\n"), NO_CUE, "")
    return F.regexp_replace(cues, r"(?m)^[ \t]+|[ \t]+$|\n\z", "")


def markdown_text(text: Column) -> Column:
    def bare(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"^#{1,6}\s+", "")
        return F.regexp_replace(F.regexp_replace(x, r"\*\*|__|`", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")

    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(_lines(text), bare), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def snippet(text: Column, terms: Column, size: int = 220) -> Column:
    """A window of a text around the first of its terms of three letters or more, cut at words, with ellipses.

    A text that fits is shown whole. Without a match it is the text's start, cut at the last space."""
    n = F.length(text)
    wanted = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 3)
    at = F.array_min(F.filter(F.transform(wanted, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)) - 1
    high = F.least(F.greatest(at - size // 2, F.lit(0)) + size, n)
    low = F.greatest(high - size, F.lit(0))
    # The start moves on to the word after, if one begins soon; the end moves back to the word before.
    space = F.instr(F.substr(text, low + 1, F.lit(20)), F.lit(" "))
    start = F.when(low > 0, low + space).otherwise(low)
    tail = F.instr(F.reverse(F.substr(text, start + 1, high - start)), F.lit(" "))
    stop = F.when((high < n) & (tail > 0) & (high - tail > start), high - tail).otherwise(high)
    body = F.regexp_replace(F.substr(text, start + 1, stop - start), r"^\s+|\s+$", "")
    window = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(stop < n, "…").otherwise(""))
    head = F.concat(F.regexp_replace(F.substr(text, F.lit(1), F.lit(size)), " [^ ]*$", ""), F.lit("…"))
    return F.when(n <= size, F.regexp_replace(text, r"^\s+|\s+$", "")).when(at >= 0, window).otherwise(head)


def context_overflow(status: Column, body: Column) -> Column:
    """Whether a refused request says that it was larger than the model's window."""
    low = F.lower(body)
    said = F.contains(low, F.lit("context size")) | F.contains(low, F.lit("context length")) | F.contains(low, F.lit("context window"))
    return F.coalesce((status == 400) & F.contains(low, F.lit("exceed")) & said, F.lit(False))


def byte_range(header: Column, size: Column) -> Column:
    """first and last byte of a Range header bytes=a-b, bytes=a- or bytes=-n; null when it cannot be met."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i).try_cast("bigint") for i in (1, 2))
    first = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d*[1-9]\d*)$") & (size > 0) & (first <= last), F.struct(first.alias("first"), last.alias("last")))
