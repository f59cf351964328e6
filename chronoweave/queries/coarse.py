"""Coarse-to-fine searches of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.functions.scoring import clip
from chronoweave.operators import coarse as S
from chronoweave.tables import table

c = F.col
#: Frames of one source, seconds between frames, hits of a query and their least coarse score.
SOURCE, PACE, LIMIT, FLOOR = 1000, 0.25, 6, 0.3


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each row is a frame, four a second; each fiftieth is asked for, mixed with the row behind it."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    frames = e.select(F.floor(c("vec_id") / SOURCE).alias("movie"), (c("vec_id") % SOURCE * PACE).alias("time"), V.sign_bits(c("vector")).alias("hash"), "vector")
    behind = e.select((c("vec_id") - 1).alias("vec_id"), c("vector").alias("behind"))
    mixed = e.where("vec_id % 50 = 0").join(behind, "vec_id", "left").withColumn("vector", F.when(c("behind").isNull(), c("vector")).otherwise(F.zip_with("vector", "behind", lambda a, b: a * 0.8 + b * 0.6)))
    return mixed.select(F.floor(c("vec_id") / SOURCE).alias("movie"), c("vec_id").alias("query"), (c("vec_id") % SOURCE * PACE).alias("q_time"), V.sign_bits(c("vector")).alias("hash"), "vector"), frames


def similarity() -> Column:
    return F.round(V.dot(c("vector"), c("frame")), 9)


def pixels() -> Column:
    """One less a sixteenth of the differences of all elements."""
    return F.round(clip(1 - F.aggregate(F.zip_with("vector", "frame", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 16), 9)


def frame_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best frames of each query in its source, none next to a better one."""
    out = S.frame_hits(*_sides(spark, sf_dir), "movie", clip(similarity()), pixels(), LIMIT, FLOOR)
    return out.select("movie", "query", c("rank").cast("long").alias("rank"), "time", F.round("score", 6).alias("score"))


def verified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of each query within half a second of its eight nearest frames."""
    out = S.verified_sources(*_sides(spark, sf_dir), "movie", pixels(), radius=0.5)
    return out.select("movie", "query", "time", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (frame_hits, verified_sources)}

_BITS = "list_sum(list_transform(range(0, 60), lambda i: CASE WHEN v[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"
_UNIT = "list_transform(v[1:16], lambda x: x / greatest(sqrt(list_dot_product(v[1:16], v[1:16])), 1e-12))"
_BASE = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT vec_id // {SOURCE} AS movie, vec_id % {SOURCE} * {PACE}e0 AS time, {_BITS} AS h, v, {_UNIT} AS u FROM e),
m AS (SELECT a.vec_id, CASE WHEN b.v IS NULL THEN a.v ELSE list_transform(list_zip(a.v, b.v), lambda z: z[1] * 0.8e0 + z[2] * 0.6e0) END AS v FROM e AS a LEFT JOIN e AS b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
q AS (SELECT vec_id // {SOURCE} AS movie, vec_id AS query, {_BITS} AS h, v, {_UNIT} AS u FROM m),
p AS (SELECT q.movie, query, time, round(list_dot_product(q.v, f.v), 9) AS sim, round(greatest(0e0, least(1e0, 1 - list_sum(list_transform(list_zip(q.v, f.v), lambda z: abs(z[1] - z[2]))) / 16)), 9) AS pixel,
 round(0.20 * (1 - bit_count(xor(q.h, f.h) >> 28) / 32e0) + 0.28 * (1 - bit_count(xor(q.h, f.h) & 268435455) / 28e0) + 0.49 * greatest(0e0, least(1e0, list_dot_product(q.u, f.u))) + 0.03 * (1 - abs(bit_count(q.h)::INT - bit_count(f.h)::INT) / 60e0), 9) AS coarse FROM q JOIN f USING (movie))"""

ORACLES = {
    # Suppression goes by falling score: a row stays if no kept one is near, which each recursion settles for the best row left.
    "frame_hits": f"""{_BASE.replace("WITH e", "WITH RECURSIVE e", 1)}, c AS (SELECT * FROM p WHERE coarse >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY movie, query ORDER BY coarse DESC, time) <= 48),
s AS (SELECT movie, query, time, round(CASE WHEN pixel > 0 THEN (greatest(0e0, least(1e0, sim)) * 0.25 + pixel * 0.75) * CASE WHEN pixel < 0.45 THEN 0.62 ELSE 1 END ELSE greatest(0e0, least(1e0, sim)) END, 9) AS score FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY movie, query ORDER BY score DESC, time DESC) AS k FROM s),
n AS (SELECT movie, query, k, [time] AS kept, TRUE AS stays FROM o WHERE k = 1 UNION ALL SELECT o.movie, o.query, o.k, CASE WHEN free THEN list_append(kept, time) ELSE kept END, free FROM n JOIN o ON o.movie = n.movie AND o.query = n.query AND o.k = n.k + 1, LATERAL (SELECT len(list_filter(kept, lambda t: abs(t - time) < 0.35)) = 0 AS free) AS x)
SELECT movie, query, row_number() OVER (PARTITION BY movie, query ORDER BY k) AS rank, time, round(score, 6) AS score FROM n JOIN o USING (movie, query, k) WHERE stays QUALIFY rank <= {LIMIT}""",
    "verified_sources": f"""{_BASE}, c AS (SELECT movie, query, time AS base, sim FROM p QUALIFY row_number() OVER (PARTITION BY movie, query ORDER BY sim DESC, time) <= 8),
g AS (SELECT movie, query, round(greatest(0e0, base + k * 0.25e0), 3) AS time, max(sim) AS sim FROM (SELECT *, unnest(range(-2, 3)) AS k FROM c) GROUP BY ALL),
s AS (SELECT g.*, round(greatest(greatest(0e0, least(1e0, (g.sim - 0.46) / 0.28)), CASE WHEN g.sim >= 0.72 THEN 0.985 WHEN g.sim >= 0.66 THEN 0.955 WHEN g.sim >= 0.6 THEN 0.9 ELSE 0 END, pixel), 9) AS score FROM g JOIN p USING (movie, query, time))
SELECT movie, query, time, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY movie, query ORDER BY s.score DESC, time DESC) = 1""",
}
