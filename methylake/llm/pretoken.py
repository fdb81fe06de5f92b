"""Pre-tokens of the public tokenizers' own patterns.

Over U+0000 to U+024F the general categories are the same in every Unicode version in use, so a pattern with
explicit classes, in the re module, matches what the tokenizers library matches. Any other text, and any text that may
hold a special token or changes under NFC, is cut by the library's own normaliser and pre-tokenizer, special tokens
being taken out first as the library does. Both ways give the same pre-tokens, so both meet in the same dictionaries.
"""

from __future__ import annotations

import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LAST = 0x24F


def _cls(test) -> str:
    """Ranges, for a regular expression's class, of the characters up to _LAST that pass test."""
    out, c = "", 0
    while c <= _LAST:
        if test(chr(c)):
            e = c
            while e < _LAST and test(chr(e + 1)):
                e += 1
            out += f"\\u{c:04x}-\\u{e:04x}"
            c = e
        c += 1
    return out


# White space of the Unicode standard up to U+024F.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
L = _cls(lambda c: unicodedata.category(c)[0] == "L")
N = _cls(lambda c: unicodedata.category(c)[0] == "N")
S = _cls(lambda c: c in _WHITE)
O = _cls(lambda c: unicodedata.category(c)[0] not in "LN" and c not in _WHITE)  # noqa: E741

#: The byte-level pattern: contractions, words, numbers, others, each with the space before it, then white space.
BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[{O}]+|[{S}]+(?![{L}{N}{O}])|[{S}]+")
#: The pattern with word ends: white space is dropped, numbers stand alone.
WORD_END = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[{O}]+")

_OUTSIDE = re.compile(f"[^\\u0000-\\u{_LAST:04x}]")
#: As _OUTSIDE, and characters with a lower case of several characters or beyond _LAST, for which the classes have no place.
_LOWER_OUTSIDE = re.compile(f"[^{_cls(lambda c: len(c.lower()) == 1 and ord(c.lower()) <= _LAST)}]")


def plain(text: str, specials: tuple[str, ...]) -> bool:
    """Whether the patterns above match as the library does."""
    return (text.isascii() or not _OUTSIDE.search(text)) and not any(s in text for s in specials)


def lower_plain(text: str, specials: tuple[str, ...]) -> bool:
    """As plain(), for the lower case too, which is the same character by character, and NFC leaves it alone."""
    return (text.isascii() or not _LOWER_OUTSIDE.search(text) and unicodedata.is_normalized("NFC", text)) and not any(s in text for s in specials)


class PieceCache(dict):
    """cache[piece] is make(piece), worked out once while the piece is held. At most `most` pieces are held, none of
    more than `longest` characters, so its bytes are bounded too; longer ones are worked out each time."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials_of(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()


def byte_level(piece: str) -> str:
    """A pre-token as the library's model takes it."""
    return piece.encode().decode("latin-1").translate(_LETTERS)


_BYTES = {ord(letter): b for b, letter in _LETTERS.items()}


def from_byte_level(piece: str) -> str:
    """The inverse of byte_level."""
    return piece.translate(_BYTES).encode("latin-1").decode()


def special_cutter(specials: tuple[str, ...]) -> re.Pattern | None:
    """Cuts a text at special tokens, which stand at odd places of its split()."""
    return re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None


def library_pieces(tokenizer, cutter: re.Pattern | None, text: str) -> list[str]:
    """Byte-level pre-tokens and, as they are, special tokens of a text, by the library."""
    normalizer, cut, out = tokenizer.normalizer, tokenizer.pre_tokenizer.pre_tokenize_str, []
    for i, part in enumerate(cutter.split(text) if cutter else [text]):
        if i % 2:
            out.append(part)
        elif part:
            out += [piece for piece, _ in cut(normalizer.normalize_str(part) if normalizer else part)]
    return out
