import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.operators import coarse as S
from chronoweave.queries.coarse import pixels, similarity


@pytest.fixture(scope="module")
def sides(spark):
    """Source a with most of the frames, b with a few, c asked for but without frames; each query is a noisy frame."""
    rng = np.random.default_rng(3)
    frames, queries = [], []
    for movie, n in (("a", 1200), ("b", 30)):
        v = rng.normal(size=(n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        frames += [(movie, i * 0.5, x.tolist()) for i, x in enumerate(v)]
        for i in range(0, n, 25):
            q = v[i] + 0.08 * rng.normal(size=64)
            queries.append((movie, len(queries), i * 0.5, (q / np.linalg.norm(q)).tolist()))
    queries.append(("c", 999, 0.0, queries[0][3]))
    h = V.sign_bits(F.col("vector"))
    f = spark.createDataFrame(frames, "movie string, time double, vector array<double>").withColumn("hash", h)
    q = spark.createDataFrame(queries, "movie string, query int, q_time double, vector array<double>").withColumn("hash", h)
    return q.cache(), f.cache()


def test_blocks_do_not_change_hits(sides):
    q, f = sides
    whole = sorted(map(tuple, S.coarse_hits(q, f, "movie", 7).collect()))
    assert whole == sorted(map(tuple, S.coarse_hits(q, f, "movie", 7, block=40.0).collect()))
    assert len(whole) == 50 * 7
    asked = {(m, k): x for m, k, x in q.where("movie <> 'c'").select("movie", "query", "vector").collect()}
    shown = f.select("movie", "time", "hash", "vector").toPandas()
    for (movie, query), vector in list(asked.items())[:5]:
        own = shown[shown["movie"] == movie]
        bits = np.array([sum(1 << i for i in range(60) if vector[i] > 0)])
        score = S.coarse_scores(bits, np.array([vector]), own["hash"].to_numpy(), np.stack(own["vector"]))[0]
        want = sorted(zip(-score, own["time"], strict=True))[:7]
        assert sorted((-c, t) for m, k, t, c in whole if (m, k) == (movie, query)) == [(pytest.approx(s), t) for s, t in want]


def test_recall_of_the_coarse_pass(sides):
    """What exact scores of all frames put first is nearly always among what the coarse pass lets through."""
    q, f = sides
    hits = S.frame_hits(q, f, "movie", F.greatest(F.lit(0.0), similarity()), pixels(), limit=3, floor=0.3).where("rank = 1")
    best = q.join(f.select("movie", "time", F.col("vector").alias("frame")), "movie").withColumn("s", similarity()).groupBy("movie", "query").agg(F.max_by("time", "s").alias("want"))
    j = hits.join(best, ["movie", "query"])
    assert j.count() == 50 and j.where("time = want").count() >= 0.9 * 50


def test_hits_are_apart_and_floors_hold(sides):
    q, f = sides
    near = f.unionByName(f.where("movie = 'b'").withColumn("time", F.col("time") + 0.1))
    got = S.frame_hits(q.where("movie = 'b'"), near, "movie", F.greatest(F.lit(0.0), similarity()), pixels(), limit=5, floor=0.0)
    for query in {r["query"] for r in got.collect()}:
        times = sorted(r["time"] for r in got.where(F.col("query") == query).collect())
        assert all(b - a >= S.APART for a, b in zip(times, times[1:], strict=False))
    assert S.coarse_hits(q, f, "movie", 5, floor=1.1).count() == 0
    assert S.coarse_hits(q.limit(0), f, "movie", 5).count() == 0 and S.coarse_hits(q, f.limit(0), "movie", 5).count() == 0


def test_verified_places(sides):
    q, f = sides
    got = S.verified_sources(q, f, "movie", pixels(), radius=1.0, step=0.5).join(q.select("query", "q_time"), "query")
    # The similarity of the frame that led there holds for its whole neighbourhood, and the later of equal places is taken.
    assert got.count() == 50 and got.where("abs(time - q_time) <= 1.0").count() >= 45
    assert got.where("score < 0.9").count() == 0


def test_cells_are_scored_in_small_parts():
    rng = np.random.default_rng(6)
    whole, parts = np.round(rng.random((300, 5_000)), 2), []

    def score(some, columns):
        parts.append((some.stop - some.start) * (columns.stop - columns.start))
        return whole[some, columns]

    for n, floor in ((7, None), (3, 0.995)):
        got = [np.concatenate(x) for x in zip(*S._best_of_cell(score, 300, 5_000, n, floor), strict=True)]
        row, place = S._best_of_rows(whole, n, floor)
        assert (got[0] == row).all() and (got[1] == place).all() and (got[2] == whole[row, place]).all()
    assert max(parts) <= 256 * 2_048
