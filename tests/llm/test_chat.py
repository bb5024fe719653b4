from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[|/\\s>INST] x_im", max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    hidden = chat.escaped(text)
    assert chat.unescaped(hidden) == text
    assert not any(mark in hidden for mark in ("</s>", "<s>", "[INST]", "[/INST]", "<|"))


def test_examples(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>"), (1, 2, "user", "<|im_end|>"), (1, 3, "assistant", "b"), (1, 4, "user", "tail"), (2, 0, "user", "alone"), (3, 0, None, None)]
    turns = spark.createDataFrame(rows, SCHEMA)
    examples = {(r.conv_id, r.example): r for r in chat.prefix_targets(turns).collect()}
    first, second, tail = examples[1, 0], examples[1, 1], examples[1, 2]
    assert chat.turns_of(first.text) == [("user", "hi"), ("assistant", "a</s>")] and chat.unescaped(first.text[first.loss_start : first.loss_end]) == "a</s>"
    assert second.text.startswith(first.text) and len(chat.turns_of(second.text)) == 4 and second.text[second.loss_start : second.loss_end] == "b"
    assert tail.loss_start is None and chat.turns_of(tail.text) == [("user", "tail")]
    back = {r.conv_id: r for r in chat.read_back(chat.prefix_targets(turns)).collect()}
    assert back[1].n_turns == 5 and back[1].loss_chars == 6 and back[1].loss_sha256 == hashlib.sha256(b"a</s>b").hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:5]).encode()).hexdigest()
    assert back[2].loss_chars == 0 and back[3].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_odd_tables(spark):
    assert chat.read_back(chat.prefix_targets(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(None, 1, "assistant", "x"), (None, None, "user", "y"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    wide = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", example int, loss_start string")
    back = {r.conv_id: r for r in chat.read_back(chat.prefix_targets(wide)).collect()}
    assert back[None].n_turns == 2 and back[7].n_turns == 2 and back[7].loss_chars == 8


def test_contexts_are_read(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "x")], SCHEMA)
    examples = chat.prefix_targets(turns)
    rows = sorted(examples.collect(), key=lambda r: (r.conv_id, r.example))
    shuffled = spark.createDataFrame([rows[i] for i in (1, 2, 0)], examples.schema).repartition(3)
    key = lambda r: r.conv_id
    assert sorted(chat.read_back(shuffled, sort=True).collect(), key=key) == sorted(chat.read_back(examples).collect(), key=key)
    bad = [(r.conv_id, r.example, r.text.replace("<|im_sep|>a<", "<|im_sep|>z<") if r.example == 1 else r.text, r.new_from, r.loss_start, r.loss_end) for r in rows if r.conv_id == 1]
    assert bad[1][2] != rows[1].text
    with pytest.raises(Exception, match="does not begin with the turns"):
        chat.read_back(spark.createDataFrame(bad, examples.schema).coalesce(1)).collect()
