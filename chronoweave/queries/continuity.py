"""Repairs of chunks by their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import continuity as K
from chronoweave.plans.bindings import SHOT_SQL, shots

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
END = 640.0

#: Scored places of a shot: a grid around its natural place and its match; scores from its value. The same in both engines.
_PLACES = "sequence(-8, 8)"
_SCORE = "0.5 + ((CAST(floor(value * 100) AS BIGINT) + k * k * 13 + id) % 50) / 1e2"
_CHUNK = "id % 19 = 0 AS breaks, id % 3 = 0 AS corrected, 0.8 + visual / 5 AS identity, (id * 43 % 100) / 1e2 AS follows"


def _chunks(spark: SparkSession, sf_dir: str, confidence: str = "confidence") -> tuple[DataFrame, DataFrame]:
    s = shots(spark, sf_dir)
    chunks = s.selectExpr("project", "id", "idx", "t0", "t1", "m0 as s0", "m1 as s1", f"{confidence} as confidence", "stability", "low_info", *_CHUNK.split(", "))
    # A shot's places as one array from the start, so that they are neither spread over rows nor grouped again.
    places = f"concat(transform({_PLACES}, k -> struct(home + k * 0.75 as place, {_SCORE} as score)), filter(array(struct(m0 as place, confidence as score)), p -> p.place is not null)) as places"
    return chunks, s.selectExpr("id", places)


def _mended(spark: SparkSession, sf_dir: str, *repairs: str, confidence: str = "confidence") -> DataFrame:
    out = K.mended_chunks(*_chunks(spark, sf_dir, confidence), ["project"], END, repairs)
    return out.select("project", "id", E6(c("s0")).alias("s0"), E6(c("s1")).alias("s1"), E6(c("confidence")).alias("confidence"), "state")


def chunk_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots carried on from the one before, as it was carried on itself, where they jump or have no match."""
    return _mended(spark, sf_dir, "carry")


def source_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots that jump away between two that agree, moved in between."""
    return _mended(spark, sf_dir, "islands")


def neighbour_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak shots far from both neighbours, moved between them."""
    return _mended(spark, sf_dir, "bridges")


def mended_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three repairs in turn: how many shots each moved, by project."""
    return _mended(spark, sf_dir, "carry", "islands", "bridges").groupBy("project").pivot("state", ["kept", "none", "carried", "filled", "island", "bridge"]).count().na.fill(0)


def refined_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched shots moved by up to 1.25 seconds to where they score best."""
    return _mended(spark, sf_dir, "refine")


QUERIES = {f.__name__: f for f in (refined_offsets, chunk_continuity, source_islands, neighbour_bridges, mended_chunks)}

_BASE = f"""WITH RECURSIVE {SHOT_SQL}, tab AS (SELECT id, list({{'p': place, 's': score}} ORDER BY place, score) AS tab FROM (
 SELECT id, home + k * 0.75 AS place, {_SCORE} AS score FROM (SELECT *, unnest(range(-8, 9)) AS k FROM shot) UNION ALL SELECT id, m0, confidence FROM shot WHERE m0 IS NOT NULL) GROUP BY id),
b0 AS (SELECT project, id, idx AS k, t0, t1, m0 AS s0, m1 AS s1, confidence, stability, low_info, {_CHUNK}, tab, CASE WHEN m0 IS NULL THEN 'none' ELSE 'kept' END AS state, greatest(0.2, t1 - t0) AS len FROM shot JOIN tab USING (id)),
b1 AS (SELECT *, lead(t0) OVER w AS n_t0, lead(s0) OVER w AS n_s0, lead(breaks) OVER w AS n_breaks FROM b0 WINDOW w AS (PARTITION BY project ORDER BY k))"""
_SHOW = "round(s0 + 1e-9, 6) AS s0, round(s1 + 1e-9, 6) AS s1, round(confidence + 1e-9, 6) AS confidence, state"


def _look(at: str, reach: str) -> str:
    return f"coalesce(list_max(list_transform(list_filter(b.tab, lambda x: abs(x.p - ({at})) <= {reach}), lambda x: x.s)), 0e0)"


def _fold(name: str, source: str, steps: str) -> str:
    """Rows in order, each mended by ``steps`` (which gives n_s0, n_s1, n_c, n_state or nulls) with a, the row before as mended."""
    return f"""{name} AS (SELECT project, id, k, t1, len, s0, s1, confidence, state FROM {source} WHERE k = 0
 UNION ALL SELECT b.project, b.id, b.k, b.t1, b.len, coalesce(z.x0, b.s0), coalesce(z.x1, b.s1), coalesce(z.xc, b.confidence), coalesce(z.xs, b.state) FROM {name} AS a JOIN {source} AS b ON b.project = a.project AND b.k = a.k + 1, {steps})"""


_CARRY = f"""LATERAL (SELECT greatest(greatest(0e0, a.s0) + 0.05, a.s1) AS until) AS u, LATERAL (SELECT b.t0 - a.t1 AS g, greatest(0e0, until + greatest(0e0, b.t0 - a.t1)) AS at_) AS y,
 LATERAL (SELECT [struct_pack(o := 0e0, p := at_, s := {_look("at_", "0.95")}), {", ".join(f"struct_pack(o := {o}, p := greatest(0e0, at_ + {o}), s := {_look(f'greatest(0e0, at_ + {o})', '0.55')})" for o in ("-6e0", "-4e0", "-2e0", "-1e0", "1e0", "2e0", "4e0", "6e0"))}] AS tried0) AS t0_,
 LATERAL (SELECT list_filter(tried0, lambda x: x.o = 0 OR x.p + b.len <= {END}) AS tried) AS t1_, LATERAL (SELECT list_transform(tried, lambda x: x.s - least(0.05, abs(x.o) * 0.006)) AS net) AS t2_,
 LATERAL (SELECT tried[list_position(net, list_max(net))] AS best) AS t3_, LATERAL (SELECT b.s0 - until AS step, b.follows >= 0.58 AS alike) AS t4_, LATERAL (SELECT abs(step - greatest(0e0, g)) AS off, step < -0.12 AS back) AS t5_,
 LATERAL (SELECT a.s0 IS NOT NULL AND until <= {END} AND NOT b.breaks AND g >= -0.05 AND g <= 0.35 AND at_ + b.len <= {END} AND NOT (a.len < 0.85 AND a.confidence < 0.78)
  AND CASE WHEN b.s0 IS NULL THEN best.s >= 0.7 ELSE off > greatest(0.38, b.len * 0.48) AND NOT (b.confidence >= 0.86 AND b.stability >= 0.48 AND b.low_info <= 0.48 AND best.s < b.confidence + 0.035)
   AND NOT (b.corrected AND b.identity >= 0.9 AND b.confidence >= 0.94 AND NOT back AND off <= greatest(2e0, b.len * 2.5))
   AND best.s >= CASE WHEN NOT alike THEN 0.76 WHEN back THEN 0.68 ELSE 0.7 END AND best.s + CASE WHEN NOT alike THEN 0.08 WHEN back THEN 0.22 ELSE 0.16 END >= b.confidence END AS moves) AS t6_,
 LATERAL (SELECT CASE WHEN moves THEN best.p END AS x0, CASE WHEN moves THEN best.p + b.len END AS x1, CASE WHEN moves THEN best.s END AS xc, CASE WHEN moves THEN CASE WHEN b.s0 IS NULL THEN 'filled' ELSE 'carried' END END AS xs) AS z"""
_ISLAND = f"""LATERAL (SELECT greatest(a.s0 + 0.05, a.s1) AS until, greatest(0.05, b.s1 - b.s0) AS shown, b.t0 - a.t1 AS g, b.n_t0 - b.t1 AS h) AS u, LATERAL (SELECT greatest(0e0, until + greatest(0e0, g)) AS at_) AS y,
 LATERAL (SELECT list_filter([struct_pack(o := 0e0, p := at_, s := {_look("at_", "0.58")}), {", ".join(f"struct_pack(o := {o}, p := greatest(0e0, at_ + {o}), s := {_look(f'greatest(0e0, at_ + {o})', '0.5')})" for o in ("-75e-2", "-5e-1", "-25e-2", "25e-2", "5e-1", "75e-2"))}], lambda x: x.o = 0 OR x.p + shown <= {END}) AS tried) AS t1_,
 LATERAL (SELECT list_transform(tried, lambda x: x.s) AS net) AS t2_, LATERAL (SELECT tried[list_position(net, list_max(net))] AS best) AS t3_,
 LATERAL (SELECT a.s0 IS NOT NULL AND b.s0 IS NOT NULL AND b.n_s0 IS NOT NULL AND NOT b.breaks AND NOT b.n_breaks AND g >= -0.05 AND g <= 0.45 AND h >= -0.05 AND h <= 0.45 AND at_ + shown <= {END}
  AND abs(b.n_s0 - (at_ + shown + greatest(0e0, h))) <= greatest(1.2, b.len * 0.85) AND abs(b.s0 - at_) > greatest(1.1, b.len * 0.8)
  AND NOT (b.confidence >= 0.86 AND best.s < b.confidence + 0.035) AND best.s >= 0.66 AND best.s + 0.13 >= b.confidence AS moves) AS t4_,
 LATERAL (SELECT CASE WHEN moves THEN best.p END AS x0, CASE WHEN moves THEN best.p + shown END AS x1, CASE WHEN moves THEN least(b.confidence, greatest(0.7, best.s)) END AS xc, CASE WHEN moves THEN 'island' END AS xs) AS z"""
_BRIDGE = f"""LATERAL (SELECT greatest(a.s0 + 0.05, a.s1) AS until, b.t0 - a.t1 AS g, b.n_t0 - b.t1 AS h) AS u, LATERAL (SELECT greatest(0e0, until + greatest(0e0, g)) AS at_, greatest(0e0, b.n_s0 - b.len - greatest(0e0, h)) AS latest) AS y,
 LATERAL (SELECT least(abs(b.s0 - at_), abs(b.s0 - latest)) AS jump, [at_, latest, greatest(0e0, (at_ + greatest(at_, latest)) * 0.5)] AS bases) AS y1,
 LATERAL (SELECT list_sort(list_distinct(flatten(list_transform(bases, lambda v: list_transform([0e0, -1e0, -5e-1, 5e-1, 1e0, 2e0, 35e-1], lambda o: round(greatest(0e0, v + o), 3)))))) AS places) AS y2,
 LATERAL (SELECT list_filter(list_transform(places, lambda v: struct_pack(p := v, s := {_look("v", "0.7")})), lambda x: x.p + b.len <= {END} AND x.s > 0) AS tried) AS t1_, LATERAL (SELECT list_transform(tried, lambda x: x.s) AS net) AS t2_, LATERAL (SELECT tried[list_position(net, list_max(net))] AS best) AS t3_,
 LATERAL (SELECT coalesce(a.s0 IS NOT NULL AND b.s0 IS NOT NULL AND b.n_s0 IS NOT NULL AND b.confidence < 0.72 AND g >= -0.08 AND g <= 0.55 AND h >= -0.08 AND h <= 0.55 AND b.n_s0 - until >= -0.3 AND b.n_s0 - until <= greatest(14e0, b.len * 9)
  AND jump >= greatest(8e0, b.len * 5) AND best.s >= 0.56 AND NOT (best.s + 0.08 < b.confidence AND jump < 60), FALSE) AS moves) AS t4_,
 LATERAL (SELECT CASE WHEN moves THEN best.p END AS x0, CASE WHEN moves THEN best.p + b.len END AS x1, CASE WHEN moves THEN greatest(b.confidence, least(0.74, best.s)) END AS xc, CASE WHEN moves THEN 'bridge' END AS xs) AS z"""


def _again(name: str, before: str) -> str:
    """The next repair's rows: what the repair before left, with the following row's."""
    return f"""{name} AS (SELECT b0.* EXCLUDE (s0, s1, confidence, state), f.s0, f.s1, f.confidence, f.state, lead(t0) OVER w AS n_t0, lead(f.s0) OVER w AS n_s0, lead(breaks) OVER w AS n_breaks FROM b0 JOIN {before} AS f USING (project, id) WINDOW w AS (PARTITION BY project ORDER BY b0.k))"""


ORACLES = {
    "refined_offsets": f"""{_BASE}, r AS (SELECT b.*, [struct_pack(p := greatest(0e0, b.s0), s := {_look("greatest(0e0, b.s0)", "0.45")}), {", ".join(f"struct_pack(p := greatest(0e0, greatest(0e0, b.s0) + {o}), s := {_look(f'greatest(0e0, greatest(0e0, b.s0) + {o})', '0.45')})" for o in ("-125e-2", "-1e0", "-75e-2", "-5e-1", "-25e-2", "25e-2", "5e-1", "75e-2", "1e0", "125e-2"))}] AS tried FROM b1 AS b),
f0 AS (SELECT *, list_concat(tried[1:1], list_filter(tried[2:], lambda x: x.p + len <= {END})) AS ok FROM r), f1 AS (SELECT *, list_transform(ok, lambda x: x.s) AS net FROM f0), f2 AS (SELECT *, ok[list_position(net, list_max(net))] AS best, ok[1] AS now FROM f1),
f3 AS (SELECT *, s0 IS NOT NULL AND abs(best.p - now.p) >= 0.08 AND best.s >= 0.58 AND (best.s >= now.s + 0.035 OR now.s < 0.68 AND best.s >= now.s + 0.02) AS m FROM f2),
f AS (SELECT project, id, CASE WHEN m THEN best.p ELSE s0 END AS s0, CASE WHEN m THEN best.p + len ELSE s1 END AS s1, CASE WHEN m THEN greatest(confidence, best.s) ELSE confidence END AS confidence, CASE WHEN m THEN 'refined' ELSE state END AS state FROM f3) SELECT project, id, {_SHOW} FROM f""",
    "chunk_continuity": f"{_BASE}, {_fold('f', 'b1', _CARRY)} SELECT project, id, {_SHOW} FROM f",
    "source_islands": f"{_BASE}, {_fold('f', 'b1', _ISLAND)} SELECT project, id, {_SHOW} FROM f",
    "neighbour_bridges": f"{_BASE}, {_fold('f', 'b1', _BRIDGE)} SELECT project, id, {_SHOW} FROM f",
    "mended_chunks": f"""{_BASE}, {_fold('f1', 'b1', _CARRY)}, {_again('b2', 'f1')}, {_fold('f2', 'b2', _ISLAND)}, {_again('b3', 'f2')}, {_fold('f3', 'b3', _BRIDGE)}
SELECT project, {", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ("kept", "none", "carried", "filled", "island", "bridge"))} FROM f3 GROUP BY project""",
}
