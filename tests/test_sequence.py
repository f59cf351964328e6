"""Recurrences against exhaustive search and hand-worked cases."""

import itertools
import random
import time

import numpy as np
import pytest

from chronoweave.operators import sequence as Q


def test_increasing_subset_is_the_heaviest(spark):
    rng, rows = random.Random(1), []
    for g in range(12):
        rows += [(g, i, float(i), float(rng.randrange(12)), rng.random()) for i in range(9)]
    got = {r["g"]: r["score"] for r in Q.increasing_subset(spark.createDataFrame(rows, "g bigint, id bigint, t double, v double, c double"), "g", "t", "v", "c", "id").collect()}
    for g in range(12):
        mine = [r for r in rows if r[0] == g]
        best = 0.0
        for k in range(1, 10):
            for pick in itertools.combinations(mine, k):
                if all(a[3] < b[3] for a, b in zip(pick, pick[1:], strict=False)):
                    best = max(best, 1 + sum(1 + 0.1 * p[4] for p in pick[1:]))
        assert got[g] == pytest.approx(best, abs=1e-6)


def test_chain_allows_five_seconds_back(spark):
    rows = [(1, 1, 0.0, 10.0, 0.5), (1, 2, 1.0, 6.0, 0.5), (1, 3, 2.0, 0.0, 0.4), (1, 4, 3.0, 8.0, 0.5)]
    got = Q.anchor_chain(spark.createDataFrame(rows, "g bigint, id bigint, t double, v double, c double"), "g", "t", "v", "c", "id").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["t"])] == [1, 2, 4]


def one_edge(a, b, free_order=True) -> float:
    row = lambda r: np.full((1, 4), np.nan) if r is None else np.array([r], float)
    return float(Q.edges(row(a), row(b), free_order)[0, 0])


@pytest.mark.parametrize(
    ("a", "b", "free", "want"),
    [
        ((0, 2, 100, 102), (2, 4, 102, 104), True, 0.08),  # goes on where the last one ended
        ((0, 2, 100, 102), None, True, -0.05),
        (None, None, True, -0.05),
        (None, (2, 4, 5, 7), True, 0.0),
        # 45 back: 1.2 * 2; drift 47 of 120; pace -22.5 costs 0.2 * 1.2; gaps 0 and 0
        ((0, 2, 145, 147), (2, 4, 100, 102), True, -(2.4 + 47 / 120 + 0.24)),
        # one of two seconds shown twice: 0.55 * 1.5; drift 1 of 50; pace 0.5; narration's gap 0, source's 0
        ((0, 2, 100, 102), (2, 4, 101, 103), False, -(0.55 * 1.5 + 1 / 50)),
        # pace 13 over 1.8: 0.15 * 1.2 at most; drift 24 of 50; gaps 24 against 0: 0.45 at most; goes on: 0.08
        ((0, 2, 100, 102), (2, 4, 126, 128), False, 0.08 - (24 / 50 + 0.18 + 0.45)),
        # the narration barely moves: no pace, no gap; overlap of 1.5 in 2
        ((0, 2, 100, 102), (0.5, 2.5, 100.5, 102.5), True, -0.55 * 1.75),
        # narration overlaps itself: its gap counts as none
        ((0, 4, 100, 101), (2, 4, 103, 105), True, 0.08 - (1 / 120 + 2 / 8)),
    ],
)
def test_edges_worked_by_hand(a, b, free, want):
    assert one_edge(a, b, free) == pytest.approx(want, abs=1e-9)


def test_viterbi_equals_exhaustive_search(spark):
    rng, rows = random.Random(3), []
    for g in range(3):
        for seg in range(4):
            for cand in (0, 1, 2, None)[(seg + g) % 2 :]:  # segments differ in their number of candidates
                start = None if cand is None else rng.uniform(0, 60)
                rows.append((g, seg, cand, seg * 4.0, seg * 4.0 + 3, start, None if start is None else start + 3, rng.uniform(-1, 1) if cand is not None else -2.2))
    got = Q.viterbi(spark.createDataFrame(rows, "g bigint, segment bigint, cand bigint, n_start double, n_end double, s_start double, s_end double, node double"), "g", "segment").collect()

    def total(pick):
        score = sum(p[7] for p in pick)
        for a, b in zip(pick, pick[1:], strict=False):
            score += one_edge(None if a[2] is None else a[3:7], None if b[2] is None else b[3:7])
        return score

    for g in range(3):
        best = max(itertools.product(*[[r for r in rows if r[0] == g and r[1] == s] for s in range(4)]), key=total)
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["segment"])
        assert mine[0]["total"] == pytest.approx(total(best), abs=1e-6)
        assert [r["cand"] for r in mine] == [p[2] for p in best]


def test_unmatched_where_only_none_is_offered(spark):
    rows = [(1, 0, None, 0.0, 1.0, None, None, -2.0)]
    got = Q.viterbi(spark.createDataFrame(rows, "g bigint, segment bigint, cand bigint, n_start double, n_end double, s_start double, s_end double, node double"), "g", "segment").first()
    assert got["cand"] is None and got["total"] == -2.0


def test_local_alignment_finds_the_shifted_run(spark):
    rng = random.Random(9)
    a = [rng.getrandbits(60) for _ in range(12)]
    left = spark.createDataFrame([(1, i, h) for i, h in enumerate(a)], "g bigint, p bigint, h bigint")
    right = spark.createDataFrame([(1, i + 100, h ^ 3) for i, h in enumerate([rng.getrandbits(60)] * 3 + a[2:9])], "g bigint, p bigint, h bigint")
    r = Q.local_alignment(left, right, "g", "p", "h").first()
    assert (r["pairs"], r["q_from"], r["q_to"], r["r_from"], r["r_to"], r["score"]) == (7, 2, 8, 103, 109, 35.0)


def test_speed_of_an_even_series_is_one(spark):
    rows = [(1, float(i), 50.0 + i) for i in range(20)]
    r = Q.warp_speed(spark.createDataFrame(rows, "g bigint, q double, s double"), "g", "q", "s").first()
    assert r["speed"] == 1.0 and not r["changed"] and r["confidence"] == 1.0


def plain_alignment(a: list[int], b: list[int]) -> float:
    """Best local score cell by cell, gaps of every length tried."""
    score = lambda x, y: (5 if (d := bin(x ^ y).count("1")) <= 5 else 2 if d <= 10 else -3)
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            gap = lambda k: -10 - 0.5 * (k - 1)
            h[i][j] = max([0.0, h[i - 1][j - 1] + score(a[i - 1], b[j - 1])] + [h[i - k][j] + gap(k) for k in range(1, i + 1)] + [h[i][j - k] + gap(k) for k in range(1, j + 1)])
    return max(map(max, h))


def test_local_alignment_matches_a_plain_table(spark):
    """One table on both sides, counted and collected; gaps pay where runs are long."""
    rng, rows = random.Random(12), []
    for g in range(6):
        a = [rng.getrandbits(60) for _ in range(14)]
        b = [h ^ (1 << rng.randrange(60)) for h in a[:6]] + [rng.getrandbits(60) for _ in range(g % 3)] + [h ^ 7 for h in a[6 + g % 2 :]]
        rows += [(g, 0, i, h) for i, h in enumerate(a)] + [(g, 1, i, h) for i, h in enumerate(b)]
    df = spark.createDataFrame(rows, "g bigint, side int, p bigint, h bigint")
    out = Q.local_alignment(df.where("side = 0"), df.where("side = 1"), "g", "p", "h")
    assert out.count() == 6
    got = {r["g"]: r["score"] for r in out.collect()}
    assert got == {g: plain_alignment(*[[r[3] for r in rows if r[:2] == (g, side)] for side in (0, 1)]) for g in range(6)}


def test_warping_matches_a_plain_table(spark):
    rng, rows = random.Random(13), []
    for g in range(5):
        q, s = sorted(rng.uniform(0, 50) for _ in range(15)), sorted(rng.uniform(0, 60) for _ in range(15))
        rows += [(g, a, b) for a, b in zip(q, s, strict=True)]
    got = {r["g"]: (r["speed"], r["confidence"]) for r in Q.warp_speed(spark.createDataFrame(rows, "g bigint, q double, s double"), "g", "q", "s").collect()}
    for g in range(5):
        q, s = sorted(r[1] for r in rows if r[0] == g), sorted(r[2] for r in rows if r[0] == g)
        x, y = [(v - q[0]) / (q[-1] - q[0]) for v in q], [(v - s[0]) / (s[-1] - s[0]) for v in s]
        n = len(q)
        cost = {(i, j): abs(x[i] - y[j]) for i in range(n) for j in range(n)}
        d = {}
        for i in range(n):
            for j in range(n):
                if i == 0 or j == 0:
                    d[i, j] = sum(cost[k, 0] for k in range(i + 1)) if j == 0 else sum(cost[0, k] for k in range(j + 1))
                elif i - 10 <= j < i + 10:
                    d[i, j] = cost[i, j] + min(d.get(p, np.inf) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        at, path = (n - 1, n - 1), {}
        while at != (0, 0):
            path[at[0]] = at[1]
            at = min((p for p in ((at[0] - 1, at[1] - 1), (at[0] - 1, at[1]), (at[0], at[1] - 1)) if min(p) >= 0), key=lambda p: d.get(p, np.inf))
        rows_at = sorted(path)
        slopes = [(s[path[b]] - s[path[a]]) / (q[b] - q[a]) for a, b in zip(rows_at, rows_at[1:], strict=False)]
        assert got[g] == (pytest.approx(float(np.clip(np.median(slopes), 0.8, 1.2)), abs=1e-6), pytest.approx(float(np.exp(-np.std(np.clip(slopes, 0, 10)))), abs=1e-6))


def test_line_worked_by_hand(spark):
    """Four anchors on y = 1.2 x + 30 and one far off; a source that ends early moves the line; two anchors too close give no slope."""
    line = [(1, i, float(x), 30 + 1.2 * x, 1.0) for i, x in enumerate((0, 5, 10, 15))] + [(1, 9, 7.0, 90.0, 0.9)]
    short = [(2, *r[1:]) for r in line]
    close = [(3, 0, 0.0, 10.0, 1.0), (3, 1, 0.5, 10.9, 1.0)]
    weak = [(4, 0, 0.0, 10.0, 0.5)]
    rows = [(*r, 20.0, {1: 0.0, 2: 50.0}.get(r[0], 0.0)) for r in line + short + close + weak]
    got = {r["g"]: r for r in Q.fit_line(spark.createDataFrame(rows, "g bigint, id bigint, x double, y double, w double, len double, stop double"), "g", "x", "y", "w", "id", "len", "stop").collect()}
    assert (got[1]["speed"], got[1]["intercept"], got[1]["inliers"], got[1]["score"]) == (1.2, 30.0, 4, pytest.approx(4 - 0.06))
    assert got[2]["intercept"] == pytest.approx(50 - 1.2 * 20)
    assert got[3]["speed"] == 1.0 and got[3]["inliers"] == 2
    assert 4 not in got


def test_many_short_keys_are_worked_on_in_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 60_000, numPartitions=4).select((F.col("id") / 3).cast("long").alias("g"), (F.col("id") % 3).alias("segment"))
    rows = rows.unionByName(rows.limit(1).selectExpr("cast(null as bigint) as g", "segment"))
    counted = Q._in_blocks(rows, "g", [F.col("segment")], lambda t: {"keys": [len(set(t.column("g").to_pylist()))], "rows": [t.num_rows]}, "keys bigint, rows bigint").collect()
    assert sum(r["rows"] for r in counted) == 60_001 and sum(r["keys"] for r in counted) == 20_001  # no key is cut
    assert len(counted) < 20


def test_paths_of_keys_of_different_lengths_match_one_key_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(g, s, k if k < 2 else None, s * 2.0, s * 2.0 + 1, float(rng.uniform(0, 40)) if k < 2 else None, 1.0, float(rng.random())) for g in range(40) for s in range(1 + g % 6) for k in range(3)]
    schema = "g bigint, segment bigint, cand bigint, n_start double, n_end double, s_start double, s_end double, node double"
    together = Q.viterbi(spark.createDataFrame(rows, schema), "g", "segment").collect()
    assert len(together) == len({r[:2] for r in rows})
    for g in (0, 5, 17):
        alone = Q.viterbi(spark.createDataFrame([r for r in rows if r[0] == g], schema), "g", "segment").collect()
        assert sorted(map(str, alone)) == sorted(str(r) for r in together if r["g"] == g)


def test_lines_of_many_groups_are_fitted_at_once():
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0, 9, (50, 6)), axis=1)
    y, w = 4 + 1.1 * x + rng.choice([0.0, 3.0], (50, 6), p=[0.8, 0.2]), rng.uniform(1, 2, (50, 6))
    length, end = np.full(50, 9.0), np.where(np.arange(50) % 2, 0.0, 13.0)
    fits, lines = Q._fitted(x, y, w, length, end)
    assert fits.sum() > 40
    for g, line in zip(np.flatnonzero(fits), lines.T, strict=True):
        _, alone = Q._fitted(x[g : g + 1], y[g : g + 1], w[g : g + 1], length[g : g + 1], end[g : g + 1])
        assert (alone[:, 0] == line).all()


def test_light_anchors_count_in_the_line(spark):
    """Two dozen heavy anchors far from each other, and lighter ones on y = 1.2 x + 30 that together outweigh any of them; groups of two sizes, one with rows that are no anchors."""
    rows, nan = [], float("nan")
    for g, n in ((1, 20), (2, 200)):
        rows += [(g, i, i * 0.7, 1000.0 + 97 * i * (-1) ** i, 2.0) for i in range(24)]
        rows += [(g, 100 + i, 0.7 * i, 30 + 1.2 * 0.7 * i, 0.5) for i in range(n)]
    rows += [(2, 900, None, 5.0, 9.0), (2, 901, 1.0, nan, 9.0), (2, 902, 1.0, 5.0, None), (2, 903, 1.0, 5.0, nan), (3, 904, nan, 5.0, 9.0)]
    df = spark.createDataFrame([(*r, 20.0, 0.0) for r in rows], "g bigint, id bigint, x double, y double, w double, len double, stop double")
    got = {r["g"]: r for r in Q.fit_line(df, "g", "x", "y", "w", "id", "len", "stop").collect()}
    for g, n in ((1, 20), (2, 200)):
        assert (got[g]["speed"], got[g]["intercept"], got[g]["inliers"]) == (pytest.approx(1.2, abs=1e-6), pytest.approx(30, abs=1e-6), n)
        assert got[g]["score"] == pytest.approx(0.5 * n - 0.06, abs=1e-6)
    assert set(got) == {1, 2}


def test_best_line_of_many_equals_all_lines():
    rng = np.random.default_rng(3)
    for t in range(60):
        n = int(rng.integers(1, 120))
        a = np.round(rng.uniform(0, 40, n), 1) if t % 3 else rng.uniform(0, rng.choice([5, 700]), n)
        b = 30 + rng.choice([1.0, 1.2, 0.8]) * a + rng.choice([0, 1e-3, 0.3]) * rng.normal(size=n) + rng.choice([0, 0, 0, 8, -30], n)
        w, tolerance = -np.sort(-rng.uniform(-0.3, 3, n)), float(rng.choice([0.45, 1.8]))
        whole = Q._best_lines(a[None], b[None], w[None], np.full((1, 1, 1), tolerance))
        assert Q._best_line_of_many(a, b, w, tolerance) == pytest.approx([float(v[0]) for v in whole], abs=1e-9)


def test_long_groups_take_little_time():
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 700, 3_000)
    b, began = 30 + 1.1 * a + rng.choice([0, 0, 0, 80, -30], 3_000), time.perf_counter()
    speed, through, _ = Q._best_line_of_many(a, b, rng.uniform(0, 3, 3_000), 1.8)
    assert (speed, through) == (pytest.approx(1.1), pytest.approx(30)) and time.perf_counter() - began < 60
