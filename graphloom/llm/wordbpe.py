"""Byte-pair encoding with word ends, exact for a `tokenizers` file of that kind, by a cache of words.

The file's normaliser and splitter never look across ASCII white space, so words between it can be encoded alone
and kept. A word that isn't kept is encoded by tiktoken's merge loop: a word's end is the byte 0xFF, which UTF-8 never has,
and its merge with the last byte comes before all others.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from functools import lru_cache

import regex
import tiktoken

#: Words kept per worker; beyond that the cache starts anew (about 200 bytes a word).
KEPT_WORDS = 200_000


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        table[chr(256 + i)] = b
    return table


class WordBpe(dict):
    END = b"\xff"
    STOPS = frozenset(".,;:!?")

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, chars = spec["model"]["end_of_word_suffix"], _bytes_of_chars()
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise OSError("ids are packed as this machine holds them: little-endian 32-bit integers are needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are sought in texts as they are, with nothing around them")
        self.added = {content: array("I", [i]).tobytes() for content, i in special.items()}
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                body, end = (token[: -len(suffix)], self.END) if token.endswith(suffix) else (token, b"")
                ranks[bytes(chars[c] for c in body) + end] = i
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> WordBpe:
        return cls(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        text = word.decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # each character by itself: str.lower() would look at the neighbours of a capital sigma
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        plain = text.encode()
        if plain != word and text.isalpha():
            packed = self[plain]
        elif text[-1:] in self.STOPS and text[:-1].isalpha():
            packed = self[plain[:-1]] + self[plain[-1:]]
        else:
            packed = array("I")
            for piece in (text,) if text.isalpha() else self.split.findall(text):
                packed.extend(self.core.encode_single_piece(piece.encode() + self.END))
            packed = packed.tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Added tokens are found first; words are between them."""
        if not any(content in text for content in self.added):
            return b"".join(map(self.__getitem__, text.encode().split()))
        parts = self.around.split(text)
        return b"".join(self.added[part] if i % 2 else b"".join(map(self.__getitem__, part.encode().split())) for i, part in enumerate(parts))
