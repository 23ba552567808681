"""Token ids of whole texts, one library call per distinct piece.

A byte-level BPE encodes the pieces that its splitting pattern cuts independently of each other.  A worker keeps the ids
of the pieces it has met; new ones go to the library's model itself, which spares its offsets.  Texts that hold the string of an added token
go to the library whole, as it cuts these strings out before splitting.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the byte-level splitting pattern.  Alternatives that cannot begin alike stand in order of frequency.
SPLIT = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The most pieces that a worker keeps, within long texts too: about 60 MB.
CACHE_PIECES = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plane_class(of: str) -> str:
    """The characters up to U+FFFF that match ``of``, as ranges of a character class."""
    held = regex.compile(of)
    inside = [not 0xD800 <= c < 0xE000 and held.match(chr(c)) is not None for c in range(0x10000)]
    edges = [c for c in range(0x10001) if (c < 0x10000 and inside[c]) != (c > 0 and inside[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


class Splitter:
    """Cuts texts into pieces.  Texts without characters beyond U+FFFF, nearly all, go through a table of that plane, which
    takes half the time of looking up properties."""

    def __init__(self):
        self.any = regex.compile(SPLIT).findall
        letter, number, blank = (_plane_class(of) for of in (r"\p{L}", r"\p{N}", r"\s"))
        pattern = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]")
        for name, ranges in ((r"\p{L}", letter), (r"\p{N}", number), (r"\S", "^" + blank), (r"\s", blank)):
            pattern = pattern.replace(name, f"[{ranges}]")
        self.plane = re.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text):
            return self.plane(text)
        return self.any(text)


class Pieces(dict):
    """Ids of pieces, asked of the library's model when first met."""

    def __init__(self, tokenize):
        self.tokenize = tokenize
        self.stand_in = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        # Each byte as its stand-in, the alphabet of the vocabulary.
        letters = piece.encode().decode("latin-1").translate(self.stand_in)
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.added = [t["content"] for t in described["added_tokens"]]
        # Only this kind is cut into pieces here; others go to the library whole.
        kind = described["pre_tokenizer"] or {}
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and described["normalizer"] is None
        plain = plain and described["model"]["type"] == "BPE"
        self.split = Splitter() if plain else None
        self.pieces = Pieces(self.library.model.tokenize)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.split is None:
            return self._whole(texts)
        get, split = self.pieces.__getitem__, self.split
        return [self._whole([t])[0] if any(a in t for a in self.added) else b"".join(map(get, split(t))) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def groups(texts: list[str], characters: int = 1 << 20):
    """(start, end) of runs of texts of about that many characters, so that few pieces are held at a time."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > characters:
            yield at, i
            at = i
            held = 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)
