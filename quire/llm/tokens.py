"""Token ids of whole texts, word by word: a word's ids don't depend on its neighbours, and most words recur."""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time, about, unless one text is longer.
PIECE = 4 << 20
#: Words without their signs whose ids a worker keeps, and the longest word that is cut by hand; beyond that number the memory starts anew.
CORES, LONGEST = 600_000, 48
#: Letters and signs of which the tokenizer's own rules make one piece each; the letters' lower case is as long as they are.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_SIMPLE = f"^[{_LETTERS}]*[{_SIGNS}]*$"
_ALL_LETTERS, _ALL_SIGNS = ("".join(re.findall(f"[{x}]", "".join(map(chr, range(256))))) for x in (_LETTERS, _SIGNS))


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens:
    """Ids as little-endian 16-bit bytes, for a lower-casing byte-level BPE that drops white space, splits at it and has under 65,536 ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("this tokenizer's ids don't fit")
        if sys.byteorder != "little":
            raise ValueError("ids are kept as this machine has them, which must be little-endian")
        self.model, self.letters = self.tok.model, _byte_letters()
        self.cores = {"": b""}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _core(self, core: str) -> bytes:
        """Of lower-case letters alone: they go to the model alone."""
        ids = self.cores.get(core)
        if ids is None:
            shown = core if core.isascii() else "".join([self.letters[b] for b in core.encode()])
            ids = self.cores[core] = array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _words(self, words: pa.Array) -> np.ndarray:
        """Ids of each of the distinct words: of simple ones letters and signs apart, each looked up once; all others go through every rule of the tokenizer."""
        simple = pc.and_(pc.match_substring_regex(words, _SIMPLE), pc.less_equal(pc.utf8_length(words), LONGEST))
        own, some = np.empty(len(words), object), words.filter(simple)
        core = pc.utf8_lower(pc.utf8_rtrim(some, _ALL_SIGNS)).dictionary_encode()
        sign = pc.utf8_ltrim(some, _ALL_LETTERS).dictionary_encode()
        cores = np.array([self._core(x) for x in _strings(core.dictionary)], object)
        signs = np.array([self._whole(x) if x else b"" for x in _strings(sign.dictionary)], object)
        mask = simple.to_numpy(zero_copy_only=False)
        own[mask] = cores[core.indices.to_numpy()] + signs[sign.indices.to_numpy()]
        own[~mask] = np.array([self._whole(x) for x in _strings(words.filter(pc.invert(simple)))], object)
        return own

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, none for a null: of a piece's words, each distinct one is looked up once, and its ids are copied to all its places."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            out += self._piece(texts.slice(at, to - at))
        return out

    def _piece(self, texts: pa.Array) -> list[bytes]:
        if len(self.cores) > CORES:
            self.cores = {"": b""}
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        own = self._words(coded.dictionary)
        n = np.fromiter(map(len, own), np.int64, len(own)) // 2
        word = coded.indices.to_numpy(zero_copy_only=False)
        count, starts = n[word], (np.cumsum(n) - n)[word]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(b"".join(own), "<u2")[np.arange(before[-1]) + np.repeat(starts - before[:-1], count)]
        edges = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
