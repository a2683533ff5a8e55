"""Ids of whole texts against the tokenizer itself; a word that recurs is worked on once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quire.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "a", "Word, word; WORD! word", "don't we'll it's 'tis", "tab\tand\rreturn \x0b\x0c x", "x" * 60, "Straße ÄÖÜ éÈ ÿŸ İstanbul ΣΑΣ ẞ",
    "Kelvin Ångstrom é ́x", "a.b..c ...$$$ ### a-b_c", "(555)555-0330 user.1@mail.example.com 10.0.0.1", "日本語 text  nbsp em", "<|endoftext|> x<|startoftext|>", "\0 nul", "x" * 47 + "..", "x" * 48 + "." * 3, "😀 ok 😀😀", "one\ntwo  three   ",
]


@pytest.mark.parametrize("piece", [1, 40, K.PIECE])
def test_ids_are_the_tokenizers(monkeypatch, piece):
    monkeypatch.setattr(K, "PIECE", piece)
    own = K.WordTokens(PATH)
    want = [np.array(own.tok.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in ODD]
    assert own.encode_all(pa.array(ODD)) == want
    assert own.encode_all(pa.array(["cut off", *ODD, "cut off"]).slice(1, len(ODD))) == want  # a slice, with everything met before
    assert own.encode_all(pa.array([], pa.string())) == []
    monkeypatch.setattr(K, "CORES", 3)
    assert own.encode_all(pa.array(ODD)) == want


def test_recurring_words_are_worked_on_once(monkeypatch):
    own, asked, whole = K.WordTokens(PATH), [], []
    words, tell = own._words, own._whole
    monkeypatch.setattr(own, "_words", lambda x: asked.extend(x.to_pylist()) or words(x))
    monkeypatch.setattr(own, "_whole", lambda x: whole.append(x) or tell(x))
    own.encode_all(pa.array(["One two, two; ONE." * 1 + " two, One" * 500] * 100))
    assert sorted(asked) == ["ONE.", "One", "two,", "two;"]
    assert sorted(whole) == [",", ".", ";"] and sorted(own.cores) == ["", "one", "two"]
