"""Token ids of whole texts by a public tokenizer whose words do not depend on their neighbours."""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import cache

#: Distinct words whose ids a worker keeps; beyond it the store starts anew.
KEPT = 300_000
#: ASCII marks that form tokens of their own at the end of a word that ends in an ASCII letter or digit.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level BPE writes each byte as a character: those that print in Latin-1 as themselves, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = dict(zip(sorted(set(range(256)) - _PRINTED), range(256, 512)))


class WordIds(dict):
    """UTF-8 word, lower-cased in ASCII, to its ids as little-endian unsigned 32-bit numbers.

    White space always ends a token of this tokenizer, so a word's ids are found once and kept. It lower-cases and splits
    letters from marks before its BPE: words of letters alone go to the BPE directly, others through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-1:].isalnum():
            found = self[stem] + self[word[len(stem) :]]
        elif word.isalpha():
            found = self._bpe(word.decode())
        else:
            text = word.decode("utf-8", "replace")
            plain = unicodedata.normalize("NFC", text).lower()
            if plain.isalpha() and "Σ" not in text:  # a capital sigma is lower-cased by its place
                found = self._bpe(plain.encode().decode("latin-1").translate(_WRITTEN))
            else:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def _bpe(self, letters: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text."""
        return b"".join(map(self.__getitem__, text.lower().split()))


@cache
def word_ids(name: str, kept: int = KEPT) -> WordIds:
    """One store a worker process; name: a file of the installed public tokenizers, or its path."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return WordIds(name, kept)
