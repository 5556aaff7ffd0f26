"""Ids by pieces are those of the library, for any text."""

from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.bpe import Encoder
from graphloom.llm.queries import TOKENIZER

BPE = Encoder(TOKENIZER)


def same(text):
    return BPE.encode(text) == b"".join(int(i).to_bytes(BPE.dtype.itemsize, "little") for i in BPE.tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "a", "it's they'll IT'S 'twas o'clock's ''s", "x\ny\n\n z\t\tw \n v\r\n", "a3f9-00ff_x 12,345.67%", "tail \n", "a\x00b \x7f\x01 c", "a\x0bb\x0cc \x1c d\x1f", "café naïve 12½ 中文 x", "  two  three   ", "'", "a' 's b'", "don't’t"])
def test_fixed_texts(text):
    assert same(text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("abzZ019 '\n\t\r\x0b\x0c\x00\x7f\x1c-_.,!strvemld"), max_size=40))
def test_ascii_texts(text):
    assert same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_texts(text):
    assert same(text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("  's\xa0\x85ñßÉ½²–“’…€ 　中")), max_size=40))
def test_latin_texts(text):
    assert same(text)


def test_latin_texts_need_one_call_a_part():
    """Each distinct match of the pattern is encoded once, by the model alone; a text is not cut by the library."""
    bpe, asked = Encoder(TOKENIZER), []
    bpe.split, model = None, bpe.model
    bpe.model = SimpleNamespace(tokenize=lambda part: asked.append(part) or model.tokenize(part))
    for text in ("Größe qxqx, año – qxqx.\nGröße: qxqx", "zz qxqx, qxqx. qxqx"):
        found = bpe.encode(text)
        assert found == b"".join(int(i).to_bytes(bpe.dtype.itemsize, "little") for i in bpe.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(asked) == len(set(asked))


def test_starting_anew(monkeypatch):
    monkeypatch.setattr("graphloom.llm.bpe.MOST_PIECES", 5)
    for text in ("one two three four five six", "один два three", "seven ünd eight", "один два three"):
        assert same(text)
