from __future__ import annotations

import pytest

from quillon.functions.spans import decoded, entity_spans


@pytest.mark.parametrize(("question", "spans"), [
    ("What was Eminem's first album?", ["Eminem"]),
    ("When did Elizabeth II meet the King of Spain in Madrid?", ["Elizabeth II", "King of Spain"]),
    ("How old is the German city?", []),
    ('Who wrote "the old man" and sang?', ["the old man"]),
    ("In Paris. London fell", ["Paris", "London"]),
    ("", []),
])
def test_entity_spans(question, spans):
    assert entity_spans(question) == spans


def test_terms_come_last_and_once():
    assert entity_spans("where is mount kilimanjaro in Kenya", terms=True) == ["Kenya", "mount", "kilimanjaro"]
    assert len(entity_spans("Aa Bb. Cc Dd. Ee Ff. Gg Hh. Ii Jj")) == 4


def test_decoding():
    assert decoded("é".encode("utf-8-sig")) == "é" and decoded("é漢".encode("utf-16")) == "é漢" and decoded("é".encode()) == "é"
    assert decoded(b'<meta charset="latin-1">\xe9') == '<meta charset="latin-1">é' and decoded(b"\x93x\x94") == "“x”" and decoded(b"\x81\xe9") == "\x81é"
