import random

import numpy as np

from chronoweave.llm import common
from chronoweave.llm.common import hash_words, shingle_hashes, words_of


def test_equal_words_and_only_they_hash_alike(monkeypatch):
    rng = random.Random(1)
    pieces = ["a", "B", "é", "漢", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "word", "x" * 300, "\x1c", " "]
    seen: dict = {}
    for part in (1 << 18, 7):
        monkeypatch.setattr(common, "_PART", part)
        for _ in range(1_500):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))).encode()
            words, hashes = words_of(text), hash_words(text).tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(hash_words(None)) == len(hash_words(b"")) == len(hash_words(b" \n")) == 0


def test_parts_do_not_change_hashes(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "xyz" * 9]) for _ in range(40)).encode() for _ in range(200)] + [b"q" * 1_000, b" " + b"q" * 63 + b" "]
    whole = [hash_words(t).tolist() for t in texts]
    for part in (1, 3, 16, 64):
        monkeypatch.setattr(common, "_PART", part)
        assert [hash_words(t).tolist() for t in texts] == whole


def test_shingles():
    h = np.arange(10, dtype=np.uint64)
    assert [len(shingle_hashes(h[:n])) for n in (0, 1, 4, 5, 6, 10)] == [0, 1, 1, 1, 2, 6]
