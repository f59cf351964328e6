"""Byte-level BPE of whole texts through a bounded cache of pre-token groups."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The split pattern of byte-level BPE tokenizers of this family: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that a worker's cache keeps at most, what an entry counts besides its own, and the longest group that is kept:
#: longer ones hardly recur, and are encoded where they stand.
CACHE, ENTRY, LONGEST = 16_000_000, 40, 64

#: A space before white space: only there does a pre-token reach across a space.
_INSIDE = re.compile(r" (?=\s)")
#: A space before anything else, where a pre-token always starts.
_CUT = re.compile(r" (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, equal to those of the tokenizer file (tests hold them side by side).

    A text is cut before each space that something else than white space follows: a pre-token starts there, whatever
    stands before, as runs of white space leave their last space to the word behind them. So each piece is a group of
    whole pre-tokens, whose ids don't depend on what stands around it. Texts with an added special token's string go to
    the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self._whole: Tokenizer | None = None

    def _tokenizer(self, text: str) -> list[int]:
        if self._whole is None:
            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """The text's groups of pre-tokens without their leading spaces, or None where only the tokenizer itself will do."""
        if any(s in text for s in self.special):
            return None
        return _CUT.split(text) if _INSIDE.search(text) else text.split(" ")

    def whole(self, text: str) -> list[int]:
        return self._tokenizer(text) if any(s in text for s in self.special) else self.core.encode_ordinary(text)


class _Kept(dict):
    """What a group of pre-tokens gives, kept while all that is kept has at most ``limit`` characters; groups beyond ``LONGEST`` never are."""

    def __init__(self, core: tiktoken.Encoding, limit: int):
        super().__init__()
        self.core, self.limit, self.held = core, limit, 0

    def of(self, piece: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        made = self.of(piece)
        if len(piece) <= LONGEST and self.held + len(piece) + ENTRY <= self.limit:
            self.held += len(piece) + ENTRY
            self[piece] = made
        return made


class _Ids(_Kept):
    def of(self, piece: str) -> bytes:
        return np.array(self.core.encode_ordinary(" " + piece), dtype="<u4").tobytes()


class _Lengths(_Kept):
    def of(self, piece: str) -> int:
        return len(self.core.encode_ordinary(" " + piece))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class IdCache:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = CACHE):
        self.encoder = encoder(path)
        self.ids = _Ids(self.encoder.core, limit)

    def __call__(self, text: str) -> bytes:
        pieces = self.encoder.pieces(text) if text else None
        if pieces is None:
            return np.array(self.encoder.whole(text), dtype="<u4").tobytes() if text else b""
        first = np.array(self.encoder.core.encode_ordinary(pieces[0]), dtype="<u4").tobytes()
        return first + b"".join(map(self.ids.__getitem__, pieces[1:]))


class LengthCache:
    """Token counts: first the given table of frequent groups, then the worker's own cache."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = CACHE):
        self.encoder = encoder(path)
        self.lengths = _Lengths(self.encoder.core, limit)
        self.lengths.update(frequent)

    def __call__(self, text: str) -> int:
        pieces = self.encoder.pieces(text) if text else None
        if pieces is None:
            return len(self.encoder.whole(text)) if text else 0
        return len(self.encoder.core.encode_ordinary(pieces[0])) + sum(map(self.lengths.__getitem__, pieces[1:]))
