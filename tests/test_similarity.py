import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.intervals import similar_runs
from chronoweave.operators.sequence import _ranked_chain
from chronoweave.operators.similarity import hamming_pairs, nearest


def close(values, radius):
    values = sorted(set(values))
    return {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_hamming_pairs_are_all_found(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(60) for _ in range(150)]
    for v in values[:80]:
        for _ in range(2):
            for bit in rng.sample(range(60), rng.randrange(7)):
                v ^= 1 << bit
            values.append(v)
    df = spark.createDataFrame([(v,) for v in [*values, *values[:5], None]], "h bigint")
    got = hamming_pairs(df, "h", radius).collect()
    assert {(r["a"], r["b"]) for r in got} == close(values, radius) and len(got) == len({(r["a"], r["b"]) for r in got})
    assert all(r["distance"] == (r["a"] ^ r["b"]).bit_count() for r in got)


def test_hamming_candidates_stay_near_the_pairs(spark):
    """Values held against each other, by the join's own key, on two sizes: next to none beyond those of the pairs."""
    for n in (4_000, 16_000):
        rng = np.random.default_rng(n)
        own = rng.integers(0, 1 << 60, n)
        values = np.concatenate([own, own ^ 7])  # a pair of each, three bits apart
        df = spark.createDataFrame([(int(v),) for v in values], "h bigint")
        edges = [round(i * 10) for i in range(7)]
        held = 0
        from itertools import combinations

        for some in combinations(range(6), 3):
            mask = sum(((1 << 10) - 1) << edges[i] for i in some)
            _, counts = np.unique(values & mask, return_counts=True)
            held += int((counts * (counts - 1) // 2).sum())
        found = hamming_pairs(df, "h", 3).count()
        assert found >= n and held <= 12 * found


def test_nearest_over_cells(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    vectors[200:] = vectors[:100]  # equal scores
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(vectors)), (900, None)], "vec_id bigint, embedding array<double>")
    score = np.round(vectors @ vectors.T, 9)
    for same in (False, True):
        got = {}
        for r in nearest(df.where("vec_id % 10 = 0"), df, 4, "vec_id", "vec_id", same=same, block=64).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["row"], r["similarity"]))
        assert set(got) == set(range(0, 300, 10))
        for q, found in got.items():
            want = sorted((-score[q, j], j) for j in range(300) if same or j != q)[:4]
            assert [(j, -s) for s, j in want] == [(j, s) for _, j, s in sorted(found)]


def test_nearest_counts_rows_without_vectors_last(spark):
    """Over cells: null vectors come last by id, NaN first; a query's own id is passed by however often it stands there; no id, no hit."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)]
    rows = [(i, None if i in (20, 30, 31) or i > 22 and i % 3 else [float("nan"), *v[1:]] if i == 41 else v) for i, v in rows] + [(20, None)] * 9 + [(40, rows[40][1])] * 9 + [(None, [9.0] * 4)] * 9
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    known, found = [r for r in rows if r[0] is not None], {}
    for r in nearest(df.where("vec_id in (10, 20, 40, 60)"), df.where("vec_id < 200 or vec_id is null"), 60, "vec_id", "vec_id", block=16, missing=True).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["row"], r["similarity"]))

    def place(q, v):
        score = None if q is None or v is None else round(float(np.dot(q, v)), 9)
        return (2, 0.0) if score is None else (0, 0.0) if score != score else (1, -score)

    for q in (10, 20, 40, 60):
        want = sorted((*place(a, v), i) for j, a in known if j == q for i, v in known if i != q)[:60]
        got = sorted(found[q])
        assert [i for *_, i in want] == [i for _, i, _ in got] and [k for k, *_ in got] == list(range(1, 61))
        assert [w[0] == 2 for w in want] == [s is None for *_, s in got]


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 16])
def test_runs_go_on_over_blocks(spark, block):
    rng = random.Random(block)
    rows, h = [], 0
    for i in sorted(rng.sample(range(2_000), 400)):
        h = h ^ (1 << rng.randrange(60)) if rng.random() < 0.8 else rng.getrandbits(60)
        rows.append(("hot" if rng.random() < 0.9 else "cold", i, h if rng.random() < 0.97 else None))
    got = similar_runs(spark.createDataFrame(rows, "k string, id bigint, h bigint"), "k", "id", "h", 2, block)
    want = []
    for key in ("hot", "cold"):
        last = None
        for _, i, h in (r for r in rows if r[0] == key):
            if last is not None and h is not None and (h ^ last).bit_count() <= 2:
                want[-1] = (key, want[-1][1], i, want[-1][3] + 1)
            else:
                want.append((key, i, i, 1))
            last = h
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("slack", [None, 5.0])
def test_chains_equal_a_plain_table(slack):
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 120):
        for _ in range(10):
            v, c = rng.integers(0, 25, n).astype(float), np.round(rng.random(n), 2)
            first, more = (np.ones(n), 1 + 0.1 * c) if slack is None else (c, c)
            best, back = first.copy(), np.full(n, -1)
            for i in range(n):
                for j in range(i):
                    if (v[j] < v[i] if slack is None else v[j] - slack <= v[i]) and best[j] + more[i] > best[i]:
                        best[i], back[i] = best[j] + more[i], j
            values = np.unique(v)
            limits = np.searchsorted(values, v, side="left") if slack is None else np.searchsorted(values - slack, v, side="right")
            chain, score = _ranked_chain(v, c, first, more, limits, values)
            assert score == pytest.approx(best.max())
            assert sum(more[chain[1:]]) + first[chain[0]] == pytest.approx(score)
            assert all((v[a] < v[b]) if slack is None else (v[a] - slack <= v[b]) for a, b in zip(chain, chain[1:], strict=False))


def test_long_chains_take_little_time():
    rng = np.random.default_rng(1)
    v = rng.random(100_000)
    began = time.perf_counter()
    values = np.unique(v)
    _ranked_chain(v, v, np.ones(len(v)), np.ones(len(v)), np.searchsorted(values, v), values)
    assert time.perf_counter() - began < 20


def test_empty(spark):
    empty = spark.createDataFrame([], "k string, id bigint, h bigint, embedding array<double>")
    assert hamming_pairs(empty, "h", 3).count() == 0 and similar_runs(empty, "k", "id", "h", 1).count() == 0
    assert nearest(empty, empty, 3, "id", "id").where(F.col("rank") > 0).count() == 0
