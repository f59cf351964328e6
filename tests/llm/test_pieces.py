import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from chronoweave.llm.pieces import PieceEncoder, decode, decoded, encode, piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
MIX = [*"abcdeost ", "  ", "   ", "\n", "▁", "é", "漢", "字", "日本", "🙂", "the", "ing", " \t", "0", "12", "<s>", "</s>", "<0x41>", "ß", "\x00", "﻿", " ", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(piece_model(PATH), cache_size=3_000)


def ids_of(encoder, text):
    return np.frombuffer(encoder(text), "<i4").tolist()


def test_ids_and_texts_equal_the_library(library, encoder):
    rng = random.Random(4)
    texts = ["", " ", "  ", "▁", "▁x", " a", "a ", "\n\n", "<unk>"] + ["".join(rng.choice(MIX) for _ in range(rng.randrange(1, 60))) for _ in range(4_000)]
    for t in texts:
        want = library.encode(t)
        assert ids_of(encoder, t) == want, repr(t)
        assert decoded(encoder.model, [*want, 2]) == library.decode([*want, 2]), repr(t)


def test_any_ids_decode_as_in_the_library(library, encoder):
    """Cut characters, lone bytes, control pieces, unknown pieces, spaces at the start."""
    rng = random.Random(6)
    for _ in range(4_000):
        ids = [rng.choice((rng.randrange(32_000), rng.randrange(259), 259, 28705, 0, 1, 2)) for _ in range(rng.randrange(9))]
        assert decoded(encoder.model, ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        decoded(encoder.model, [32_000])


def test_backtracking_equals_merging_on_adversarial_runs(library, encoder):
    """Runs in which the longest piece is often wrong, without cuts and beyond the cache's chunk length."""
    rng = random.Random(8)
    for alphabet in ("ab", "est", "nti", "ooof", "▁", "▁a", "01", "-=", "ha"):
        for n in (1, 2, 3, 17, 65, 400):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids_of(encoder, t) == library.encode(t), t


def test_a_position_that_leads_nowhere_is_stepped_back_from(encoder):
    """Some words need more than the longest piece at each place."""
    model, rng, stepped = encoder.model, random.Random(2), 0
    for _ in range(2_000):
        word = "▁" + "".join(rng.choice("aeioustnr") for _ in range(12))
        at, greedy = 0, []
        while at < len(word):
            piece = max((p for p in (word[at : at + n] for n in range(1, 17)) if p in model.ids), key=len)
            greedy.append(model.ids[piece])
            at += len(piece)
        got = np.frombuffer(encoder.backtrack(word), "<i4").tolist()
        stepped += got != greedy
        merged = list(word)
        while True:
            pairs = [(model.order[a + b], i) for i, (a, b) in enumerate(zip(merged, merged[1:], strict=False)) if a + b in model.order]
            if not pairs:
                break
            i = min(pairs)[1]
            merged[i : i + 2] = [merged[i] + merged[i + 1]]
        assert got == [model.ids[p] for p in merged]
    assert stepped > 200


def test_a_long_unbroken_text(library, encoder):
    for t in ("ab" * 200_000, "漢字かな" * 60_000, "x" * 300_000, "\n" * 100_000):
        began = time.perf_counter()
        got = ids_of(encoder, t)
        assert time.perf_counter() - began < 20
        assert got == library.encode(t)


def test_rows(nasty, empty, library):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    rows = decode(encode(nasty, PATH), PATH)
    assert rows.columns == ["doc_id", "ids", "text"]
    want = [(r["doc_id"], library.encode(r["text"] or "", add_eos=True)) for r in nasty.collect()]
    got = rows.collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["text"] == library.decode(r["ids"]) for r in got)
    assert encode(empty, PATH).count() == 0 and decode(encode(empty, PATH), PATH).count() == 0
    assert encode(nasty, PATH, end_id=False).where("size(ids) = 0").count() == nasty.where("text is null or text = ''").count()


def test_decode_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, [264, 2], "x"), (2, None, "y"), (3, [], "z")], "k int, ids array<int>, text string")
    assert sorted(map(tuple, decode(rows, PATH).select("k", "text").collect())) == [(1, "a"), (2, None), (3, "")]
    assert sorted(map(tuple, decode(rows, PATH, out_col="said").select("k", "text", "said").collect())) == [(1, "x", "a"), (2, "y", None), (3, "z", "")]


def test_query_digests(spark, library):
    from chronoweave.llm.queries import op13_pieces

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op13_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_eos=True)
        digests = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids)))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *digests)
