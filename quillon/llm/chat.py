"""Chat formatting by prefix-target expansion.

A conversation's turns are written one after another between control strings. Every assistant turn gives an example of
its own: all turns before it as context, then the reply, and only the reply's text under the loss mask. Turns after the last
reply, which no example holds, come as a row without a mask, so that nothing of a conversation is lost.

Control strings inside roles and texts are escaped: a backslash goes in after the opening character of anything that
reads like one, behind the backslashes that may stand there already; taking one out again gives the text back.

Conversations are dealt out by conv_id and read in order, one row at a time: a task holds the formatted prefix of one
conversation, never its rows. Output grows with the square of a conversation's turns, as every prefix is written out.

Defined cases: null roles and texts count as empty; turns that share a number follow each other by role and text, those
without a number come last; rows without conv_id are one conversation; an empty table gives no examples; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and what reads like a control string of common chat templates.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?SYS>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?SYS>|/?INST\])"
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(ESCAPED)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}\n", re.DOTALL)
SCHEMA = "conv_id long, example int, text string, new_from long, loss_start long, loss_end long"
TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
FLUSH_CHARS = 8_000_000


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    return [(unescaped(role), unescaped(said)) for role, said in _TURN.findall(text)]


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)


def _expanded(batches):
    """Examples from rows (conv_id, role, text) in order."""
    out: list[tuple] = []
    pending = 0
    conv, example, prefix, done = object(), 0, "", 0
    for conv_id, role, said in _rows(batches):
        if conv_id != conv:
            if len(prefix) > done:
                out.append((conv, example, prefix[done:], 0, None, None))
            conv, example, prefix, done = conv_id, 0, "", 0
        prefix += f"{START}{escaped(role)}{SEPARATOR}"
        start, prefix = len(prefix), prefix + escaped(said)
        stop, prefix = len(prefix), prefix + f"{END}\n"
        if role == "assistant":
            out.append((conv, example, prefix, done, start, stop))
            pending += len(prefix)
            example, done = example + 1, len(prefix)
        if pending > FLUSH_CHARS:
            yield _batch(out)
            out, pending = [], 0
    if len(prefix) > done:
        out.append((conv, example, prefix[done:], 0, None, None))
    if out:
        yield _batch(out)


def ordered_turns(turns: DataFrame) -> DataFrame:
    said, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), said.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text").select("conv_id", "role", "text")


def prefix_targets(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), text, new_from (where the turns start that the example before did not have),
    loss_start and loss_end (code points of the reply; null for turns after the last reply)."""
    return ordered_turns(turns).mapInArrow(_expanded, SCHEMA)


def _read(batches):
    """Per conversation, from its examples in order: what reading them back gives."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out: list[tuple] = []
    conv, state = None, None

    def done():
        turns, sha, chars, loss_sha, formatted = state
        out.append((conv, len(turns), sha.hexdigest(), chars, loss_sha.hexdigest(), formatted))

    for conv_id, _, text, _, loss_start, loss_end in _rows(batches):
        if state is None or conv_id != conv:
            if state:
                done()
            conv, state = conv_id, [[], hashlib.sha256(), 0, hashlib.sha256(), 0]
        turns, before = turns_of(text), len(state[0])
        if loss_start is None:
            turns = state[0] + turns
        elif turns[:before] != state[0]:
            raise ValueError(f"an example of conversation {conv_id} does not begin with the turns of the one before")
        for role, said in turns[before:]:
            state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        state[0] = turns
        if loss_start is not None:
            reply = unescaped(text[loss_start:loss_end])
            state[2] += len(reply)
            state[3].update(reply.encode("utf-8", "surrogatepass"))
        state[4] += len(text)
        if len(out) >= 4096:
            yield batch(out)
            out.clear()
    if state:
        done()
    if out:
        yield batch(out)


def read_back(examples: DataFrame, sort: bool = False) -> DataFrame:
    """Digests per conversation, read from whole examples; an example whose context is not the turns of the one before raises. Examples
    as `prefix_targets` gives them stand together and in order; `sort` brings them so, if they were written and read again."""
    if sort:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return examples.select(*[part.split()[0] for part in SCHEMA.split(", ")]).mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
