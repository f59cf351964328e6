import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoweave.llm.bpe import IdCache, LengthCache
from chronoweave.llm.packing import best_fit, best_fit_packing, patterns, plan
from chronoweave.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", "漢", "🙂", " ", "  ", "\n", "\t", "'s", "'ll", "12", ".", "--", " ", " ", "<|endoftext|>", "the", " word", "\x00", "﻿"]
    texts = ["", " ", "\n", "a  b", " lead", "trail ", "it's we'll"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3_000)]
    ids, lengths = IdCache(PATH, limit=50), LengthCache(PATH, {}, limit=50)
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids(t), "<u4").tolist() == want, repr(t)
        assert lengths(t) == len(want)


def test_prose_with_blank_lines_takes_the_lookup(tokenizer):
    """Texts with runs of white space are cut too, and what is cut gives the tokenizer's ids."""
    rng = random.Random(9)
    gaps = [" ", " ", " ", "  ", "\n\n", "\n", " \n ", "\t", " \t", "\r\n", "\x0b ", "\x1c ", " \x1c", "\u00a0 ", " \u2003", "\u0085 ", "   \n"]
    texts = ["".join(rng.choice(("word", "it's", "12", "--", "é", "漢字", "x")) + rng.choice(gaps) for _ in range(60)) for _ in range(500)]
    ids = IdCache(PATH, limit=1_000)
    for t in texts:
        assert len(ids.encoder.pieces(t)) > 5
        assert np.frombuffer(ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts_on_nasty_rows(nasty, empty, tokenizer):
    got = token_counts(nasty, PATH).collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in nasty.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts(empty, PATH).count() == 0


def test_patterns_fill_exactly():
    p = patterns(12)
    assert (p.sum(axis=1) == 12).all() and len({tuple(r) for r in p.tolist()}) == len(p)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_length_once(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(rng.integers(1, 65, 700), minlength=65)
    used = np.zeros(65, int)
    planned = plan(h, 64)
    for pattern, n in planned:
        assert sum(pattern) <= 64
        for v in pattern:
            used[v] += n
    assert (used == h).all()
    total = sum(n for _, n in planned)
    assert -(-int((h * np.arange(65)).sum()) // 64) <= total <= 1.05 * sum(best_fit(h, 64).values())


def test_packing_on_nasty_rows(nasty, empty, tokenizer):
    got = best_fit_packing(nasty, PATH).toPandas()
    assert got["length"].between(1, 1024).all()
    by = got.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id")["length"].cumsum() - by["length"]) == by["offset"]).all()
    assert (by.groupby("sequence_id")["length"].sum() <= 1024).all()
    want = []
    for r in nasty.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r["doc_id"] or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = [(int(i) if i == i and i is not None else -1, p, s, n, c) for i, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows) == sorted(want)
    assert best_fit_packing(empty, PATH).count() == 0


def test_caches_are_bounded_in_characters(tokenizer):
    """Unbroken texts, and Chinese without spaces, are encoded whole and leave nothing behind; words fill the cache up to its limit."""
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh漢字かな") for _ in range(30_000)) for _ in range(20)] + ["漢字" * 300, "x" * 1_000_000]
    lengths, ids = LengthCache(PATH, {}, limit=5_000), IdCache(PATH, limit=5_000)
    for t in long:
        want = tokenizer.encode("a " + t, add_special_tokens=False).ids
        assert lengths("a " + t) == len(want) and np.frombuffer(ids("a " + t), "<u4").tolist() == want
    assert not lengths.lengths and not ids.ids
    words = " ".join(f"word{i}" for i in range(3_000))
    assert lengths(words) == len(tokenizer.encode(words, add_special_tokens=False).ids)
    assert 50 < len(lengths.lengths) <= 125 and lengths.lengths.held <= 5_000


def test_long_groups_are_no_counters():
    from collections import Counter

    import pyarrow as pa

    from chronoweave.llm.token_counts import _summaries

    texts = [f"the {'x' * 30_000}{i} end" for i in range(300)]
    out = list(_summaries(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), PATH))
    assert Counter(dict(zip(out[0].column(0).to_pylist()[0], out[0].column(1).to_pylist()[0], strict=True))) == {"end": 300}
