"""Token ids of whole texts by way of a bounded cache of short pieces of text.

A text is cut only where the tokenizer is bound to end a pre-token, so the ids
of the pieces, put in a row, are the ids of the text.  Pieces repeat far more
often than texts do, and the library is asked once for each distinct piece.

Where cuts are safe:

* byte-level tokenizer with the pattern `` ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
  before a space that a character other than white space follows.  A run of
  white space gives up its last space to the word after it whether or not that
  word is there, so both sides are cut alike.  The same holds for a line feed
  that such a character follows.
* word-level tokenizer that drops white space: at any ASCII white space.

No cut is made before ``<``, as special strings start with it and end the text
segment before them.
"""

from __future__ import annotations

import gc
import re
import struct
from operator import itemgetter
from string import punctuation

import regex
from tokenizers import Tokenizer

#: A space before one of these characters (or at the end) is not a place to cut.
_DOUBT = re.compile("[ ](?:[\\x00-\\x20<\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u3000\\ufeff]|$)")
_CUT = re.compile("[ ](?=[^\\x00-\\x20<\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u3000\\ufeff])")
#: A line feed that is not a place to cut.
_LINE_DOUBT = re.compile("\n(?:[\\x00-\\x20<\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u3000\\ufeff]|\\Z)")

#: Characters whose class and lower case are the same in every Unicode library.
_PLAIN = re.compile("[!-~ \\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")

#: The published pre-token patterns of the two vocabularies (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: Control characters but for the line feed, and the codes from DEL to the no-break space.
_CONTROLS = bytes({*range(32), *range(127, 161)} - {10})


def _surely_plain(text: str) -> bool:
    """True only if every space of the text is a safe cut; quick, and may say False for others."""
    if "  " in text or " \n" in text or " <" in text or text[-1:] == " ":
        return False
    try:
        narrow = text.encode("latin-1")
    except UnicodeEncodeError:
        return _DOUBT.search(text) is None
    return len(narrow.translate(None, _CONTROLS)) == len(narrow)


def cut_before_spaces(text: str) -> list[str]:
    """Pieces for the byte-level tokenizer; each but the first lacks its leading space."""
    return text.split(" ") if _surely_plain(text) else _CUT.split(text)


def cut_before_white_space(text: str) -> list[str]:
    """As ``cut_before_spaces``, but where every line feed is a safe cut, also before these; a piece
    that begins with a line feed has no space before it."""
    if not _surely_plain(text):
        return _CUT.split(text)
    if "\n" in text and _LINE_DOUBT.search(text) is None:
        text = text.replace("\n", " \n")
    return text.split(" ")


def cut_at_white_space(text: str) -> list[str]:
    """Pieces for the tokenizer that drops white space."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class PieceIds(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.  When full it starts anew, and takes
    over the pieces of the time before as they are met again; the others go when it is full once more.

    For the byte-level tokenizer a piece stands for itself after a space, unless it begins with a line feed.
    """

    def __init__(self, path: str, capacity: int = 500_000, longest: int = 64):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        letters = byte_letters()
        self._letters, self._space = str.maketrans({b: c for b, c in enumerate(letters)}), letters[32]
        self._lower = self._tokenizer.normalizer is not None
        self._pattern = regex.compile(WORD_PATTERN if self._lower else BYTE_PATTERN)
        self._before: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._capacity, self._longest = capacity, longest

    def _merged(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        if word.isascii() and word.isprintable():
            spelt = word.replace(" ", self._space)
        else:
            spelt = word.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        ids = self._words.get(word)
        if ids is None:
            ids = self._merged(word)
            if len(self._words) >= self._capacity // 4:
                self._words.clear()
            if len(word) <= self._longest:
                self._words[word] = ids
        return ids

    def encode(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable() or _PLAIN.fullmatch(piece) is not None
        if not plain or "<|" in piece:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        if self._lower:
            piece = piece.lower()
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            return self._word(piece)
        return b"".join([self._word(w) for w in self._pattern.findall(piece)])

    def _made(self, piece: str) -> bytes:
        if piece[:1] == "\n" and not self._lower:
            return self._word("\n") + self.encode(piece[1:])
        core = piece.rstrip(punctuation)
        if core.isalpha() and (core.isascii() or _PLAIN.fullmatch(core) is not None):
            if len(core) < len(piece):
                if "<|" not in piece:  # letters and marks, of which neither takes from the other
                    return self[core] + self._word(piece[len(core) :])
            elif not self._lower:
                return self._merged(" " + core)
            else:
                low = core.lower()
                return self._merged(core) if low == core else self[low]
        return self.encode(piece if self._lower else " " + piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self._before.pop(piece, None)
        if ids is None:
            ids = self._made(piece)
        if len(self) >= self._capacity:
            self._before = dict(self)
            self.clear()
        if len(piece) <= self._longest:
            self[piece] = ids
        return ids


class TextIds:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str):
        self._pieces = PieceIds(path)
        self._lower = self._pieces._lower

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of several texts; the collector of cycles rests meanwhile, as none are made."""
        gc.disable()
        try:
            return [self(t) for t in texts]
        finally:
            gc.enable()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._lower:
            return self._of(cut_at_white_space(text))
        first, *rest = cut_before_white_space(text)
        return self._pieces.encode(first) + self._of(rest)

    def _of(self, pieces: list[str]) -> bytes:
        if len(pieces) < 2:
            return b"".join([self._pieces[p] for p in pieces])
        return b"".join(itemgetter(*pieces)(self._pieces))


_LOADED: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One per worker process and vocabulary, so its cache serves all tasks of the worker."""
    if path not in _LOADED:
        _LOADED[path] = TextIds(path)
    return _LOADED[path]
