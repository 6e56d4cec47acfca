"""Whole texts to token ids, with pieces that were seen before taken from memory."""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Words and pieces of words that a worker keeps; about 200 bytes each.
WORDS, PIECES = 400_000, 50_000
# What the vocabulary's pre-tokenizer makes of lower-case Latin-1 text without odd
# white space: the same alternatives, with Latin-1's letters and numbers spelled out.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t\n\r\x0b\x0ca-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_ODD = bytes([*range(0x1C, 0x20), 0x85, 0xA0])
_LATIN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


@lru_cache(maxsize=1)
def _spelling() -> dict[int, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip([*plain, *rest], [*plain, *range(256, 256 + len(rest))], strict=True))


def _plain(text: str) -> bool:
    """Whether the text is Latin-1 without odd white space or marks of special tokens."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(data.translate(None, _ODD)) == len(data) and b"<|" not in data


class _Words(dict):
    """Words between white space, each encoded as a whole by ids."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        if len(self) < WORDS:
            self[word] = ids
        return ids


class Encoder(dict):
    """ids(text) of a tokenizers file, as little-endian uint32.

    Where the file's normalizer and pre-tokenizer are the known ones, Latin-1 text is
    cut as they would and other text at spaces and newlines, which no token crosses;
    each distinct piece is encoded once. Any other file encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.words, self.plain = _Words(self.whole), _Words(self.plain_word)
        self.known = pre[0].get("pattern") == {"Regex": _LATIN} and pre[0].get("invert") and norm == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")

    def spelt(self, piece: str) -> bytes:
        """Ids of one piece, which is one run of merges: what is left to do is to spell its bytes."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(_spelling())
        ids = array("I", [x.id for x in self.model.tokenize(piece)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def plain_word(self, word: str) -> bytes:
        """Ids of a word of plain lower-case text; one of letters alone is one piece."""
        return self.spelt(word) if word.isalpha() else b"".join(map(self.__getitem__, _PIECES.findall(word)))

    def __missing__(self, piece: str) -> bytes:
        ids = self.spelt(piece)
        if len(self) < PIECES:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self.whole(text)
        if _plain(text):  # no piece has white space in it
            return b"".join(map(self.plain.__getitem__, text.lower().split()))
        return b"".join(map(self.words.__getitem__, filter(None, text.replace("\n", " ").split(" "))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
