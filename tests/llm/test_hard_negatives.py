import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import hard_negatives as module
from chronoweave.llm.hard_negatives import Summaries, hard_negatives, prepared, surviving


def brute(rows, is_anchor, n_positives=5, n_negatives=10):
    """rows: (id, label, vector of whole numbers), repeated rows once for each anchor."""
    out = []
    for a in sorted({(i, y, tuple(v)) for i, y, v in rows if is_anchor(i)}):
        scored = [(-sum(p * q for p, q in zip(a[2], v, strict=False)), i, y) for i, y, v in rows if i != a[0]]
        for minus, positive, _ in sorted(s for s in scored if s[2] == a[1])[:n_positives]:
            fit = sorted(s for s in scored if s[2] != a[1] and 30 * -minus <= 100 * -s[0] <= 90 * -minus)[:n_negatives]
            out += [(a[0], positive, k + 1, i, -minus, -m) for k, (m, i, _) in enumerate(fit)]
    return sorted(out)


def clustered(n, seed, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * np.linspace(2, 0.1, width)
    at = rng.integers(0, 12, n)
    return [(i, int(at[i] % 4), (centres[at[i]] + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]


def whole(rows):
    return [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows]


@pytest.mark.parametrize("blocks", [1 << 24, 4_000])
def test_against_brute_force(spark, blocks):
    rows = clustered(700, 3)
    rows += [(1_000 + i, y, v) for i, y, v in rows[:40]]  # equal scores
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5)
    got = hard_negatives(prepared(df), F.col("vec_id") % 50 == 0, block_bytes=blocks)
    assert sorted(map(tuple, got.collect())) == brute(whole(rows), lambda i: i % 50 == 0)


def test_small_tiles(monkeypatch):
    """Bounds that get tight while tiles go by, and one vector in rows of several tiles; run without Spark, so that tiles can be small."""
    monkeypatch.setattr(module, "TILE", 16)
    monkeypatch.setattr(module, "ANCHOR_TILE", 3)
    rows = whole(clustered(300, 5) + [(2_000 + i, i % 2, [0.5] * 64) for i in range(90)])
    ids, labels, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50]), pa.array(labels[i : i + 50]), pa.array(vectors[i : i + 50].tolist())], ["vec_id", "label", "vector"]) for i in range(0, len(ids), 50)]
    at = np.flatnonzero(ids % 20 == 0)
    found = next(module._positives(ids[at], labels[at], vectors[at], 5)(iter(batches)))
    keys, scores, names = (c.to_pylist() for c in found.columns)
    windows = np.array([(k, -(-30 * s // 100), 90 * s // 100) for k, s in zip(keys, scores, strict=True)])
    windowed, low, negatives = (c.to_pylist() for c in next(module._negatives(ids[at], labels[at], vectors[at], windows, 10)(iter(batches))).columns)
    got = [(int(ids[at[keys[w]]]), names[w], negatives[i], scores[w], low[i]) for i, w in enumerate(windowed)]
    assert sorted(got) == sorted((a, p, n, x, y) for a, p, _, n, x, y in brute(rows, lambda i: i % 20 == 0))


def test_bounds_hold_and_rule_pairs_out():
    vectors = np.array([v for _, _, v in whole(clustered(500, 9))])
    anchors, rows = Summaries(vectors[:20]), Summaries(vectors)
    scores = vectors[:20] @ vectors.T
    for means, deviations, means_of_rows, deviations_of_rows in zip(anchors.means, anchors.deviations, rows.means, rows.deviations, strict=True):
        centre, reach = means @ means_of_rows.T, deviations @ deviations_of_rows.T
        assert (scores <= centre + reach + 1e-6).all() and (scores >= centre - reach - 1e-6).all()
    wide = [(np.square(a @ b.T).mean()) for a, b in zip(anchors.deviations, rows.deviations, strict=True)]
    assert wide == sorted(wide, reverse=True)  # finer segments, tighter bounds
    least, most = np.quantile(scores, 0.98, axis=1), np.full(20, np.inf)
    everything = np.ones(scores.shape, bool)
    at, to, exact = surviving(anchors, rows, everything, least, most)
    want = scores >= least[:, None]
    assert (exact == scores[at, to]).all() and set(zip(*np.nonzero(want), strict=True)) <= set(zip(at.tolist(), to.tolist(), strict=True))
    centre, reach = anchors.means[1] @ rows.means[1].T, anchors.deviations[1] @ rows.deviations[1].T
    assert ((centre + reach) < least[:, None]).mean() > 0.3  # the second level alone rules out a good part


def test_nulls_lengths_and_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, 2, [0.7]), (4, 2, [0.3, 0.4, 9.0]), (5, 2, []),
        (6, None, [1.0, 1.0]), (7, 1, None), (8, 2, [1.0, None]), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (None, 2, [0.6, 0.6]),
        (1, 1, [1.0, 1.0]), (20, 3, [-1.0, -1.0]), (40, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (60, 7, []),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("score", F.lit(1)).withColumn("anchor", F.lit("x"))
    got = hard_negatives(prepared(df), F.col("vec_id") % 20 == 0)
    kept = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(map(tuple, got.collect())) == brute(whole(kept), lambda i: i % 20 == 0)
    assert hard_negatives(prepared(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives(prepared(df), F.col("vec_id") == 999).count() == 0
