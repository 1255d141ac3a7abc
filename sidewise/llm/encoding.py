"""Token ids of whole texts, exactly as the tokenizers library gives them, with every word encoded once per cache.

A byte-level vocabulary always starts a new piece at a space that is followed by something else than white space. So a
text may be cut there, and its ids are the ids of the parts one after another. Parts recur; they are kept. Parts that are
not in the cache are split as the vocabulary's pattern does and run through the library's own merge model. Texts or parts
with anything unusual (double white space, special strings, scripts beyond Cyrillic) go through the library as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import regex

from sidewise.llm.common import held_by

# The pattern that byte-level vocabularies of this family split by.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Space, printable ASCII, line feed, and letters up to Cyrillic: here all Unicode versions agree.
_PLAIN = re.compile("[ -~\n¡-ԯ]*")
# What stands for a space and for a line feed, the only plain ASCII that does not stand for itself.
_SPACE, _LINE_FEED = "Ġ", "Ċ"
_UNUSUAL = re.compile(r" \s")
CACHED = 600_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(0x100 + i) for i, byte in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids with a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.largest_id = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        self._merge = self.library.model.tokenize
        self._special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self._letters = _byte_letters()
        self._pieces = regex.compile(PIECES).findall
        self._parts = _Kept(self.part, before=" ")  # by what follows a space

    def ids(self, text: str) -> bytes:
        """The ids of one text, four bytes each."""
        if _UNUSUAL.search(text) or any(special in text for special in self._special):
            return self._whole(text)
        first, *rest = text.split(" ")
        if len(self._parts) > CACHED:
            self._parts.clear()
        return self.part(first) + b"".join(map(self._parts.__getitem__, rest))

    def part(self, text: str) -> bytes:
        """The ids of a text between two cuts."""
        if not text:
            return b""
        if text.isascii() and text.isprintable() or _PLAIN.fullmatch(text):
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                return self._piece(text)
            # A word before a comma is the word itself with one more piece.
            return b"".join([
                self._parts[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self._piece(piece)
                for piece in self._pieces(text)
            ])
        return self._whole(text)

    def _piece(self, text: str) -> bytes:
        if text.isascii():
            letters = text.replace(" ", _SPACE).replace("\n", _LINE_FEED)
        else:
            letters = text.encode().decode("latin-1").translate(self._letters)
        return _packed([token.id for token in self._merge(letters)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Kept(dict):
    """Results of ``encode`` by text."""

    def __init__(self, encode: Callable[[str], bytes], before: str = ""):
        super().__init__()
        self._encode = encode
        self._before = before

    def __missing__(self, text: str) -> bytes:
        found = self[text] = self._encode(self._before + text)
        return found


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return held_by(f"encoder {path}", lambda: Encoder(path))
