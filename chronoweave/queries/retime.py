"""Ranges fitted to the source's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.functions.scoring import clip
from chronoweave.operators import retime as R
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
FILM, STEP = 500, 0.25


def _film(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A film's frames, four a second; a target that shows them a tenth faster; ranges of it, each a little off its source."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.floor(c("vec_id") / FILM).alias("film"), (c("vec_id") % FILM).alias("frame"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    frames = e.select("film", (c("frame") * STEP).alias("time"), "vector")
    shown = e.select("film", c("frame").alias("from"), "vector")
    looks = e.select("film", "frame", F.floor(c("frame") * 11 / 10).alias("from")).join(shown, ["film", "from"]).select("film", "frame", "vector")
    ranges = e.where("frame % 16 = 0").select("film", c("frame").alias("id"), (c("frame") * STEP).alias("t0"), (c("frame") * STEP + 1.0 + c("label") * 0.25).alias("t1"), (c("frame") * STEP * 1.1 + (c("label") % 4) * 0.5 - 0.5).alias("s0"), F.lit(0.5).alias("score"))
    return ranges.withColumn("s0", F.greatest(F.lit(0.0), c("s0"))).withColumn("s1", c("s0") + c("t1") - c("t0")), looks, frames


def alike():
    return clip(F.round(V.dot(c("asked"), c("shown")), 9))


def pixels():
    return F.round(clip(1 - F.aggregate(F.zip_with("asked", "shown", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 16), 9)


def range_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each range at its start and half a second on."""
    ranges, looks, frames = _film(spark, sf_dir)
    starts = ranges.select("film", "id", "t0", (c("t1") - c("t0")).alias("duration"), F.explode(F.array(c("s0"), c("s0") + 0.5)).alias("start"))
    out = R.range_scores(starts, looks, frames, "film", alike(), pixels(), STEP)
    return out.select("film", "id", E6(c("start")).alias("start"), F.round("score", 6).alias("score"))


def retimed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges, looks, frames = _film(spark, sf_dir)
    out = R.retimed_ranges(ranges, looks, frames, "film", alike(), pixels(), FILM * STEP, STEP)
    return out.select("film", "id", E6(c("s0")).alias("s0"), E6(c("s1")).alias("s1"), F.round("score", 6).alias("score"), "fitted")


QUERIES = {f.__name__: f for f in (range_scores, retimed_ranges)}

_SIM = "greatest(0e0, least(1e0, round(list_dot_product({a}, {b}), 9)))"
_PIX = "round(greatest(0e0, least(1e0, 1 - list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / 16)), 9)"
_SIMS = f"{_SIM.format(a='a.v', b='f.v')} AS f, {_PIX.format(a='a.v', b='f.v')} AS p"
_FILM = f"""e AS (SELECT vec_id // {FILM} AS film, vec_id % {FILM} AS frame, label, embedding::DOUBLE[] AS v FROM embeddings), fr AS (SELECT film, frame * {STEP}e0 AS time, v FROM e),
lk AS (SELECT a.film, a.frame, b.v FROM e AS a JOIN e AS b ON b.film = a.film AND b.frame = a.frame * 11 // 10),
rg0 AS (SELECT film, frame AS id, frame * {STEP}e0 AS t0, frame * {STEP}e0 + 1e0 + label * 0.25e0 AS t1, greatest(0e0, frame * {STEP}e0 * 1.1e0 + (label % 4) * 0.5e0 - 0.5e0) AS s0, 0.5e0 AS score FROM e WHERE frame % 16 = 0), rg AS (SELECT *, s0 + t1 - t0 AS s1 FROM rg0)"""


def _scored(name: str, starts: str) -> str:
    """Scores of ranges at starts (film, id, t0, duration, start)."""
    return f"""{name}_s AS (SELECT s.*, at_, start + duration * at_ AS place, lk.v FROM (SELECT *, unnest(CASE WHEN duration < 1.2 THEN [0.5e0] WHEN duration < 2.5 THEN [0.33e0, 0.67e0] ELSE [0.22e0, 0.5e0, 0.78e0] END) AS at_ FROM {starts}) AS s JOIN lk ON lk.film = s.film AND lk.frame = floor((t0 + duration * at_) / {STEP} + 0.5)::BIGINT),
{name}_n AS (SELECT a.film, id, start, at_, f.time, f.time < place AS behind, {_SIMS} FROM {name}_s AS a JOIN fr AS f ON f.film = a.film AND abs(f.time - a.place) <= 1.35),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY film, id, start, at_, behind ORDER BY CASE WHEN behind THEN -time ELSE time END) AS k FROM {name}_n),
{name}_b AS (SELECT film, id, start, at_, (f * 0.35 + p * 0.65) * CASE WHEN p < 0.45 THEN 0.72 ELSE 1 END AS s FROM (SELECT * FROM {name}_k WHERE k <= CASE WHEN behind THEN 1 ELSE 2 END AND f > 0) QUALIFY row_number() OVER (PARTITION BY film, id, start, at_ ORDER BY f DESC, time) = 1),
{name} AS (SELECT film, id, start, round(avg(coalesce(s, 0)), 9) AS score FROM {name}_s LEFT JOIN {name}_b USING (film, id, start, at_) GROUP BY ALL)"""


ORACLES = {
    "range_scores": f"WITH {_FILM}, st AS (SELECT film, id, t0, t1 - t0 AS duration, unnest([s0, s0 + 0.5e0]) AS start FROM rg), {_scored('sc', 'st')} SELECT film, id, round(start + 1e-9, 6) AS start, round(score, 6) AS score FROM sc",
    "retimed_ranges": f"""WITH {_FILM}, d AS (SELECT *, t1 - t0 AS duration, least(0.45e0, greatest(0.18e0, (t1 - t0) * 0.16)) AS o FROM rg WHERE t1 - t0 >= 1.4 AND s1 > s0),
ed AS (SELECT film, id, 'in' AS edge, t0 + o AS at_, s0 + o AS hint FROM d UNION ALL SELECT film, id, 'out', t1 - o, s1 - o FROM d), ea AS (SELECT ed.*, lk.v FROM ed JOIN lk ON lk.film = ed.film AND lk.frame = floor(at_ / {STEP} + 0.5)::BIGINT),
en AS (SELECT film, id, edge, time, round(CASE WHEN p > 0 THEN f * 0.25 + p * 0.75 ELSE f END, 9) AS s FROM (SELECT a.film, id, edge, f.time, {_SIMS} FROM ea AS a JOIN fr AS f ON f.film = a.film AND abs(f.time - a.hint) <= 1.35)),
eb AS (SELECT * FROM en WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY film, id, edge ORDER BY s DESC, time) = 1),
ef AS (SELECT d.*, i.s AS si, u.s AS su, greatest(0e0, i.time - o) AS g0, u.time + o AS g1 FROM d JOIN eb AS i ON i.film = d.film AND i.id = d.id AND i.edge = 'in' JOIN eb AS u ON u.film = d.film AND u.id = d.id AND u.edge = 'out' WHERE i.s >= 0.64 AND u.s >= 0.64),
eg AS (SELECT *, greatest(g0 + 0.05, g1) AS g2 FROM ef), eh AS (SELECT *, CASE WHEN g2 > {FILM * STEP} THEN greatest(0e0, g0 - (g2 - {FILM * STEP})) ELSE g0 END AS f0, least(g2, {FILM * STEP}) AS f1 FROM eg), ei AS (SELECT * FROM eh WHERE (f1 - f0) / greatest(duration, 0.05) BETWEEN 0.55 AND 1.85),
st AS (SELECT film, id, t0, duration, s0 AS start FROM ei UNION SELECT film, id, t0, duration, f0 FROM ei), {_scored('sc', 'st')},
ok AS (SELECT ei.film, ei.id, f0, f1, least(si, su, n.score) AS w FROM ei JOIN sc AS o ON o.film = ei.film AND o.id = ei.id AND o.start = s0 JOIN sc AS n ON n.film = ei.film AND n.id = ei.id AND n.start = f0 WHERE n.score >= o.score - 0.075)
SELECT film, id, round(coalesce(f0, s0) + 1e-9, 6) AS s0, round(coalesce(f1, s1) + 1e-9, 6) AS s1, round(CASE WHEN f0 IS NULL THEN score ELSE greatest(score, w) END, 6) AS score, f0 IS NOT NULL AS fitted FROM rg LEFT JOIN ok USING (film, id)""",
}
