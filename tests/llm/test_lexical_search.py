import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import lexical_search as module
from chronoweave.llm.lexical_search import Block, lexical_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """docs, items: (id, text). Rows (item, rank, doc, score), items that are repeated whole once."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys((i, tuple(terms(t))) for i, t in items):
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in text if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 1, 5, 40, 300))))) for i in range(n)]


@pytest.mark.parametrize(("docs", "block"), [(1 << 15, 1 << 20), (100, 300)])
def test_against_brute_force(spark, monkeypatch, docs, block):
    rng = random.Random(1)
    texts = corpus(900, 2)
    texts += [(5_000 + i, texts[17][1]) for i in range(120)]  # more equal scores than places
    items = [(i, " ".join(f"W{rng.randrange(450)}" for _ in range(rng.choice((1, 3, 12, 130))))) for i in range(30)] + [(77, texts[17][1])]
    got = lexical_search(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), block_bytes=block)
    assert rows_of(got) == sorted(brute(texts, items), key=repr)


def test_blocks_of_one_partition(monkeypatch):
    """Several blocks in one task, many terms in few masks: the best of earlier blocks stand against later ones."""
    monkeypatch.setattr(module, "DOCS", 64)
    monkeypatch.setattr(module, "FIRST", 4)
    monkeypatch.setattr(module, "MASK", 5)
    texts = corpus(500, 7)
    names = {f"w{i}".encode(): i for i in range(60)}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t.encode() for _, t in texts])], ["doc_id", "text"])
    postings = [b for b in module._postings(names, pa.int64())(iter([batch]))]
    n_docs, n_terms = sum(b.num_rows for b in postings), sum(sum(b.column(1).to_pylist()) for b in postings)
    df = Counter(t for b in postings for row in b.column(2).to_pylist() for t in row)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i in range(60)])
    wanted = [(w, weight[w]) for w in ([1, 50, 3], list(range(20)), [59], list(range(0, 60, 7)))]
    small = [b.slice(i, 20) for b in postings for i in range(0, b.num_rows, 20)]
    found = list(module._ranked(wanted, 20, n_docs, n_terms, 60, pa.int64())(iter(small)))[0].to_pylist()
    items = [(i, " ".join(f"w{t}" for t in ts)) for i, (ts, _) in enumerate(wanted)]
    assert [(r["item"], r["doc_id"], r["score"]) for r in found] == [(i, d, s) for i, _, d, s in brute(texts, items)]


def test_masks_are_groups_and_bounds_save_work():
    texts = corpus(4_000, 11)
    names = {f"w{i}".encode(): i for i in range(400)}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t.encode() for _, t in texts])], ["doc_id", "text"])
    postings = list(module._postings(names, pa.int64())(iter([batch])))
    block = Block(postings, 4_000, 300_000, 400)
    some = [0, 3, 9, 120, 350]
    weights = np.array([100, 900, 2_000, 5_000, 8_000])
    group, bound = block.masks(some, weights)
    held = dict(texts)
    masks = [tuple(f"w{t}" in held[i].split() for t in some) for i in block.ids.to_pylist()]
    assert len(set(zip(masks, group.tolist(), strict=True))) == len(set(masks)) == len(bound)
    scores = block.scores(np.arange(block.size), some, weights)
    assert (scores <= bound[group]).all()
    docs, best, seen = block.best(some, weights, 20, 1)
    want = np.lexsort((np.arange(block.size), -scores))[:20]
    assert docs.tolist() == want.tolist() and best.tolist() == scores[want].tolist() and seen < block.size


def test_terms():
    long = ("Ab1, é漢" + "x" * 50 + " ") * 60_000
    assert [t.decode() for part in terms_of(long.encode()) for t in part] == terms(long)
    for text in ("", " ", "AÀ_b-c\x00d\x7fe", "İ ß", "\u0085 z"):
        assert [t.decode() for part in terms_of(text.encode()) for t in part] == terms(text)


def test_rows(spark, nasty, empty):
    items = spark.createDataFrame([(1, "alpha beta ONE two"), (1, "漢字 12345"), (2, None), (3, " .. "), (None, "ééé one"), (1, "alpha beta ONE two"), (4, "nowhere")], "item_id int, text string").withColumn("rank", F.lit(1))
    docs = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    got = lexical_search(nasty, items)
    assert rows_of(got) == sorted(brute(docs, [(r["item_id"], r["text"]) for r in items.collect()]), key=repr)
    assert lexical_search(empty, items).count() == 0 and lexical_search(nasty, items.limit(0)).count() == 0
