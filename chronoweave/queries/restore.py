"""Ranges of the source along the target: locked, filled, smoothed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import ranges as R
from chronoweave.plans.bindings import SHOT_SQL, shots

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
SOURCE_END = 640.0
#: Scored places of a shot around its own, and their scores: the same in both engines.
_STEPS, _FOUND = ("-3e0", "-1e0", "0e0", "5e-1", "2e0"), "0.5 + ((CAST(floor(value * 100) AS BIGINT) + CAST(floor(o * 10) AS BIGINT) + 30) % 50) / 1e2"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("project", "place", *[E6(c(x)).alias(x) for x in ("t0", "t1", "s0", "s1")], "inferred", E6(c("score")).alias("score"))


def smoothed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched shots after the five smoothing rules; purchases of even numbers cut a little behind their start."""
    s = shots(spark, sf_dir)
    cuts = s.where("event_type = 'purchase' and id % 2 = 0").select("project", (c("t0") + 0.05).alias("at"))
    ranges = s.where("m0 is not null").select("project", "id", "t0", "t1", c("m0").alias("s0"), c("m1").alias("s1"), (c("event_type") == "error").alias("inferred"), c("visual").alias("score"))
    return _shown(R.smoothed_ranges(ranges, cuts, ["project"]))


def locked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots as ranges, locked together where both are sure; clicks may change speed, views are no part of it."""
    s = shots(spark, sf_dir).where("event_type <> 'view'")
    rows = s.select("project", "id", "t0", "t1", "m0", "m1", (c("id") % 17 == 0).alias("review"), (c("id") % 5 != 0).alias("exact"), (c("id") % 11 == 0).alias("inferred_match"), (0.8 + c("visual") / 5).alias("visual"), (0.8 + c("confidence") / 5).alias("confidence"), (c("event_type") == "click").alias("speed"))
    return _shown(R.locked_ranges(rows, ["project"], target_end=90.0, source_end=585.0))


def continuous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots filled from anchors, those with a good look; clicks and errors begin at a cut."""
    s = shots(spark, sf_dir)
    rows = s.select("project", "id", "t0", "t1", "m0", (c("m0").isNotNull() & (c("visual") >= 0.5) & (c("idx") > 1)).alias("anchor"), c("event_type").isin("click", "error").alias("cut"))
    out = R.continuous_ranges(rows, ["project"], source_end=590.0)
    return out.select("project", "id", E6(c("s0")).alias("s0"), E6(c("s1")).alias("s1"), "inferred")


def _rechecked(spark: SparkSession, sf_dir: str, checks: int) -> tuple[DataFrame, DataFrame]:
    s = shots(spark, sf_dir).where("m0 is not null")
    ranges = s.select("project", "id", "t0", "t1", c("m0").alias("s0"), c("m1").alias("s1"), (c("event_type") == "error").alias("inferred"), c("confidence").alias("score"))
    rows = s.where("id % 2 = 0").select("project", c("id").alias("row"), c("t0").alias("r0"), c("t1").alias("r1"), c("home").alias("m0"), c("visual").alias("base"))
    seeds = R.restore_seeds(ranges, rows, ["project"], SOURCE_END)
    grid = s.selectExpr("id", f"explode(array({', '.join(_STEPS)})) as o", "home", "value").selectExpr("id", "home + o as place", f"{_FOUND} as score")
    cuts = s.where("event_type = 'purchase' and id % 2 = 0").select("project", (c("t0") + 0.05).alias("at"))
    return seeds, R.rechecked_ranges(ranges, seeds, grid.unionByName(s.select("id", c("m0").alias("place"), c("stability").alias("score"))), cuts, ["project"], SOURCE_END, checks)


def restore_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source starts that shots of even numbers propose for the ranges around them."""
    seeds, _ = _rechecked(spark, sf_dir, 0)
    return seeds.select("project", "id", F.posexplode("seeds").alias("k", "s")).select("project", "id", c("k").cast("long").alias("k"), E6(c("s.start")).alias("start"), E6(c("s.score")).alias("score"))


def rechecked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful ranges, the first 30 of each project, held against their seeds."""
    _, out = _rechecked(spark, sf_dir, 30)
    return out.select("project", "id", E6(c("s0")).alias("s0"), E6(c("s1")).alias("s1"), "inferred", E6(c("score")).alias("score"), "state")


def repaired_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched shots after the repairs of excursions, of jumps without a cut and of steps back."""
    s = shots(spark, sf_dir).where("m0 is not null")
    grid = s.selectExpr("id", f"explode(array({', '.join(_STEPS)})) as o", "home", "value").selectExpr("id", "home + o as place", f"{_FOUND} as score")
    cuts = s.where("event_type = 'purchase' and id % 2 = 0").select("project", (c("t0") + 0.05).alias("at"))
    ranges = s.select("project", "id", "t0", "t1", c("m0").alias("s0"), c("m1").alias("s1"), (c("event_type") == "error").alias("inferred"), c("confidence").alias("score"))
    return _shown(R.repaired_ranges(ranges, grid.unionByName(s.select("id", c("m0").alias("place"), c("stability").alias("score"))), cuts, ["project"], SOURCE_END))


QUERIES = {f.__name__: f for f in (smoothed_ranges, locked_ranges, continuous_ranges, restore_seeds, rechecked_ranges, repaired_ranges)}

_FIELDS = ("t0", "t1", "s0", "s1", "inferred", "score", "cut_in", "cut_out")
_MEET = "abs(b.t0 - a.t1) <= 0.05 AND NOT b.cut_in"
_ON = f"{_MEET} AND abs(b.s0 - a.s1) <= 0.8"
_LONG = "greatest(0e0, b.t1 - b.t0)"


def _joining(name: str, source: str, joins: str, inferred: str = "a.inferred OR b.inferred") -> str:
    """One joining rule as a recursion over the rows of ``source``: a is the range so far, b the next row."""
    merged = {"t0": "a.t0", "t1": "b.t1", "s0": "a.s0", "s1": "a.s0 + greatest(0e0, b.t1 - a.t0)", "inferred": inferred, "score": "least(a.score, b.score)", "cut_in": "a.cut_in", "cut_out": "b.cut_out"}
    step = ", ".join(f"CASE WHEN j THEN {v} ELSE b.{k} END" for k, v in merged.items())
    return f"""{name}_f AS (SELECT project, k, {", ".join(_FIELDS)}, k AS run FROM {source} WHERE k = 1
 UNION ALL SELECT b.project, b.k, {step}, CASE WHEN j THEN a.run ELSE b.k END FROM {name}_f AS a JOIN {source} AS b ON b.project = a.project AND b.k = a.k + 1, LATERAL (SELECT coalesce({joins}, FALSE) AS j)),
{name}_l AS (SELECT * FROM {name}_f QUALIFY k = max(k) OVER (PARTITION BY project, run)),
{name} AS (SELECT project, row_number() OVER w AS k, {", ".join(_FIELDS)}, lead(t0) OVER w AS n_t0, lead(s0) OVER w AS n_s0 FROM {name}_l WINDOW w AS (PARTITION BY project ORDER BY run))"""


_FLICKER = f"b.n_t0 IS NOT NULL AND {_LONG} <= 0.9 AND {_MEET} AND abs(b.n_t0 - b.t1) <= 0.05 AND NOT b.cut_out AND abs(b.n_s0 - a.s1) <= 1.25 AND (abs(b.s0 - a.s1) >= 1.5 OR abs(b.n_s0 - b.s1) >= 1.5)"
_AGAIN = f"{_MEET} AND a.s1 - b.s0 > 0.35 AND a.s1 - b.s0 >= 1 AND (a.s1 - b.s0) / greatest({_LONG}, 0.1) >= 0.45"
_SEEDS = f"""s AS (SELECT * FROM shot WHERE m0 IS NOT NULL),
sj AS (SELECT a.project, a.id, a.t0, a.t1, b.id AS row, b.home + (a.t0 - b.t0) AS start0, b.visual AS base, greatest(0e0, least(a.t1, b.t1 + 0.45) - greatest(a.t0, b.t0 - 0.45)) AS overlap, abs((a.t0 + a.t1) * 0.5 - (b.t0 + b.t1) * 0.5) AS distance FROM s AS a JOIN s AS b ON a.project = b.project AND b.id % 2 = 0),
sk AS (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY overlap DESC, distance, row) AS rk FROM sj WHERE overlap > 0 OR distance <= greatest(1.6e0, (t1 - t0) * 1.2) QUALIFY rk <= 4),
sc AS (SELECT *, least(greatest(0e0, start0), greatest(0e0, {SOURCE_END} - (t1 - t0))) AS start, greatest(0e0, least(1e0, base * 0.62 + greatest(0e0, least(1e0, overlap / greatest(0.2e0, t1 - t0))) * 0.38)) AS score FROM sk),
so AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY project, id, floor(start * 10 + 0.5) ORDER BY score DESC, rk) = 1),
sd AS (SELECT project, id, start, score, row_number() OVER (PARTITION BY project, id ORDER BY score DESC, start) - 1 AS k FROM so QUALIFY k <= 3)"""
_LOOKED = lambda at: f"coalesce(list_max(list_transform(list_filter(b.tab, lambda x: abs(x.p - ({at})) <= 0.3), lambda x: x.s)), 0e0)"
_OUT = "round(t0 + 1e-9, 6) AS t0, round(t1 + 1e-9, 6) AS t1, round(s0 + 1e-9, 6) AS s0, round(s1 + 1e-9, 6) AS s1, inferred, round(score + 1e-9, 6) AS score"



def _carried(name: str, source: str, judged: str, margin: str) -> str:
    """Ranges that go on from the one before instead, and join then: a is the range so far, b the next row, n what it becomes."""
    return f"""{name}_f AS (SELECT project, k, t0, t1, s0, s1, inferred, score, cut_in, tab, len, k AS run FROM {source} WHERE k = 1
 UNION ALL SELECT b.project, b.k, CASE WHEN j THEN a.t0 ELSE b.t0 END, b.t1, CASE WHEN j THEN m.x0 ELSE n.s0 END, CASE WHEN j THEN m.x1 ELSE n.s1 END, CASE WHEN j THEN a.inferred OR n.inferred ELSE n.inferred END, CASE WHEN j THEN least(a.score, n.score) ELSE n.score END,
  CASE WHEN j THEN a.cut_in ELSE b.cut_in END, CASE WHEN j THEN a.tab ELSE b.tab END, CASE WHEN j THEN greatest(0e0, b.t1 - a.t0) ELSE b.len END, CASE WHEN j THEN a.run ELSE b.k END FROM {name}_f AS a JOIN {source} AS b ON b.project = a.project AND b.k = a.k + 1,
 LATERAL (SELECT {_LOOKED("b.s0")} AS now, {_LOOKED("a.s1")} AS then_) AS l, LATERAL (SELECT b.len >= 0.18 AND {_MEET} AND {judged} AND a.s1 + b.len <= {SOURCE_END} AND then_ >= now - {margin} AS moves) AS v,
 LATERAL (SELECT CASE WHEN moves THEN a.s1 ELSE b.s0 END AS s0, CASE WHEN moves THEN a.s1 + b.len ELSE b.s1 END AS s1, b.inferred OR moves AS inferred, CASE WHEN moves THEN greatest(then_, least(b.score, now)) ELSE b.score END AS score) AS n,
 LATERAL (SELECT {_MEET} AND abs(n.s0 - a.s1) <= 0.8 AS j, greatest(0e0, b.t1 - a.t0) AS total) AS g,
 LATERAL (SELECT CASE WHEN a.s0 + total > {SOURCE_END} THEN greatest(0e0, {SOURCE_END} - total) ELSE a.s0 END AS x0, CASE WHEN a.s0 + total > {SOURCE_END} THEN {SOURCE_END} ELSE a.s0 + total END AS x1) AS m),
{name}_l AS (SELECT * FROM {name}_f QUALIFY k = max(k) OVER (PARTITION BY project, run)),
{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY project ORDER BY run) AS k) FROM {name}_l)"""


ORACLES = {
    "smoothed_ranges": f"""WITH RECURSIVE {SHOT_SQL}, cut AS (SELECT project, t0 + 0.05 AS mark FROM shot WHERE event_type = 'purchase' AND id % 2 = 0),
near AS (SELECT s.id, bool_or(mark >= t0 - 0.08 AND mark <= t0 + 0.08) AS cut_in, bool_or(mark >= t1 - 0.08 AND mark <= t1 + 0.08) AS cut_out FROM shot AS s JOIN cut USING (project) GROUP BY s.id),
r0 AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY t0, id) AS k, t0, t1, m0 AS s0, m1 AS s1, event_type = 'error' AS inferred, visual AS score, coalesce(cut_in, FALSE) AS cut_in, coalesce(cut_out, FALSE) AS cut_out FROM shot LEFT JOIN near USING (id) WHERE m0 IS NOT NULL),
{_joining("r1", "r0", f"{_MEET} AND (abs(b.s0 - a.s1) <= 0.8 OR {_LONG} < 0.55 AND abs(b.s0 - a.s1) <= 4)")},
{_joining("r2", "r1", f"{_MEET} AND {_LONG} < 0.35 AND abs(b.s0 - a.s1) <= 6")},
{_joining("r3", "r2", _FLICKER, "TRUE")},
{_joining("r4", "r3", _ON)},
r5 AS (SELECT project, k, {", ".join(_FIELDS)} FROM r4 WHERE k = 1
 UNION ALL SELECT b.project, b.k, b.t0, b.t1, CASE WHEN j THEN a.s1 ELSE b.s0 END, CASE WHEN j THEN a.s1 + {_LONG} ELSE b.s1 END, b.inferred OR j, CASE WHEN j THEN least(a.score, b.score) ELSE b.score END, b.cut_in, b.cut_out
 FROM r5 AS a JOIN r4 AS b ON b.project = a.project AND b.k = a.k + 1, LATERAL (SELECT {_AGAIN} AS j))
SELECT project, k - 1 AS place, {_OUT} FROM r5""",
    "locked_ranges": f"""WITH RECURSIVE {SHOT_SQL}, u AS (SELECT project, id, t0, least(t1, 90e0) AS t1, m0, m1, id % 17 = 0 OR id % 11 = 0 AS inferred, id % 17 = 0 AS review, id % 5 <> 0 AS exact, 0.8 + visual / 5 AS score, 0.8 + confidence / 5 AS conf, event_type = 'click' AS speed FROM shot WHERE event_type <> 'view' AND t0 < 90),
v AS (SELECT *, m0 IS NOT NULL AS matched, m0 IS NOT NULL AND NOT inferred AND NOT review AND exact AND score >= 0.82 AND conf >= 0.82 AS safe FROM u WHERE t1 > t0 QUALIFY bool_or(m0 IS NOT NULL) OVER (PARTITION BY project ORDER BY t0, t1, id)),
n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t0, t1, id) AS k FROM v),
f AS (SELECT project, k, t0, t1, y.s0, y.s1, inferred, score, t1 AS t_last, y.s1 AS s_last, safe, speed, k AS run, NULL::DOUBLE AS g_t0, NULL::DOUBLE AS g_s0, FALSE AS g
  FROM n, LATERAL (SELECT CASE WHEN NOT speed OR m1 <= m0 THEN m0 + (t1 - t0) ELSE m1 END AS e) AS x, LATERAL (SELECT CASE WHEN e > 585 THEN greatest(0e0, m0 - (e - 585)) ELSE m0 END AS s0, least(e, 585e0) AS s1) AS y WHERE k = 1
 UNION ALL SELECT b.project, b.k, CASE WHEN j THEN h.t0 ELSE b.t0 END, b.t1, CASE WHEN j THEN h.s0 ELSE y.s0 END, y.s1, CASE WHEN j THEN h.inferred OR z.inferred ELSE z.inferred END, CASE WHEN j THEN least(h.score, z.score) ELSE z.score END,
  b.t1, y.s1, b.safe, b.speed, CASE WHEN NOT j THEN b.k WHEN bridged THEN b.k ELSE a.run END, a.t_last, a.s_last, bridged AND NOT j
  FROM f AS a JOIN n AS b ON b.project = a.project AND b.k = a.k + 1,
  LATERAL (SELECT CASE WHEN b.matched THEN b.m0 ELSE a.s_last END AS m0, CASE WHEN b.matched THEN b.m1 ELSE a.s_last + (b.t1 - b.t0) END AS m1, CASE WHEN b.matched THEN b.inferred ELSE TRUE END AS inferred, CASE WHEN b.matched THEN b.score ELSE 0 END AS score) AS z,
  LATERAL (SELECT CASE WHEN NOT b.speed OR z.m1 <= z.m0 THEN z.m0 + (b.t1 - b.t0) ELSE z.m1 END AS e) AS x,
  LATERAL (SELECT CASE WHEN e > 585 THEN greatest(0e0, z.m0 - (e - 585)) ELSE z.m0 END AS s0, least(e, 585e0) AS s1) AS y,
  LATERAL (SELECT b.t0 - a.t_last > 0.05 AND b.t0 - a.t_last <= 0.18 AND a.s_last + (b.t0 - a.t_last) <= 585 AS bridged) AS q,
  LATERAL (SELECT CASE WHEN bridged THEN a.t_last ELSE a.t0 END AS t0, CASE WHEN bridged THEN b.t0 ELSE a.t1 END AS t1, CASE WHEN bridged THEN a.s_last ELSE a.s0 END AS s0, CASE WHEN bridged THEN a.s_last + (b.t0 - a.t_last) ELSE a.s1 END AS s1, bridged OR a.inferred AS inferred, CASE WHEN bridged THEN 0 ELSE a.score END AS score) AS h,
  LATERAL (SELECT abs(b.t0 - h.t1) <= 0.05 AND abs(y.s0 - h.s1) <= 0.18 AND b.speed = a.speed AND a.safe AND b.safe AS j) AS w),
o AS (SELECT project, t0, t1, s0, s1, inferred, score FROM (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY project, run))
 UNION ALL SELECT f.project, g_t0, n.t0, g_s0, g_s0 + (n.t0 - g_t0), TRUE, 0 FROM f JOIN n USING (project, k) WHERE g)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY t0, t1) - 1 AS place, {_OUT} FROM o""",
    "continuous_ranges": f"""WITH RECURSIVE {SHOT_SQL}, a AS (SELECT *, m0 IS NOT NULL AND visual >= 0.5 AND idx > 1 AS anchor, event_type IN ('click', 'error') AS cut FROM shot),
n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t0, id) AS k, first(CASE WHEN anchor THEN {{'m': m0, 't': t0}} END IGNORE NULLS) OVER (PARTITION BY project ORDER BY t0, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM a WHERE t1 > t0),
f AS (SELECT project, id, k, x.s0, x.s1, NOT anchor AS inferred FROM n, LATERAL (SELECT CASE WHEN anchor THEN m0 WHEN nx IS NOT NULL THEN greatest(0e0, nx.m - greatest(0e0, nx.t - t0)) ELSE coalesce(m0, 0) END AS s) AS y,
  LATERAL (SELECT CASE WHEN s + (t1 - t0) > 590 THEN greatest(0e0, 590 - (t1 - t0)) ELSE s END AS s0, CASE WHEN s + (t1 - t0) > 590 THEN 590 ELSE s + (t1 - t0) END AS s1) AS x WHERE k = 1
 UNION ALL SELECT b.project, b.id, b.k, x.s0, x.s1, NOT keeps FROM f JOIN n AS b ON b.project = f.project AND b.k = f.k + 1,
  LATERAL (SELECT b.anchor AND NOT (abs(b.m0 - f.s1) > greatest(4e0, 2 * (b.t1 - b.t0)) AND NOT b.cut) AS keeps) AS w, LATERAL (SELECT CASE WHEN keeps THEN b.m0 ELSE f.s1 END AS s) AS y,
  LATERAL (SELECT CASE WHEN s + (b.t1 - b.t0) > 590 THEN greatest(0e0, 590 - (b.t1 - b.t0)) ELSE s END AS s0, CASE WHEN s + (b.t1 - b.t0) > 590 THEN 590 ELSE s + (b.t1 - b.t0) END AS s1) AS x)
SELECT project, id, round(s0 + 1e-9, 6) AS s0, round(s1 + 1e-9, 6) AS s1, inferred FROM f""",
    "restore_seeds": f"WITH {SHOT_SQL}, {_SEEDS} SELECT project, id, k, round(start + 1e-9, 6) AS start, round(score + 1e-9, 6) AS score FROM sd",
    "rechecked_ranges": f"""WITH RECURSIVE {SHOT_SQL}, {_SEEDS}, cut AS (SELECT project, t0 + 0.05 AS mark FROM s WHERE event_type = 'purchase' AND id % 2 = 0), near AS (SELECT s.id, bool_or(mark >= t0 - 0.08 AND mark <= t0 + 0.08) AS cut_in FROM s JOIN cut USING (project) GROUP BY s.id),
tab AS (SELECT id, list({{'p': place, 's': score}}) AS tab FROM (SELECT id, home + o AS place, {_FOUND} AS score FROM (SELECT *, unnest([{", ".join(_STEPS)}]) AS o FROM s) UNION ALL SELECT id, m0, stability FROM s) GROUP BY id),
sl AS (SELECT id, list({{'a': start, 'w': score}}) AS seeds FROM sd GROUP BY id),
n0 AS (SELECT s.project, s.id, t0, t1, m0 AS s0, m1 AS s1, event_type = 'error' AS inferred, confidence AS score, coalesce(cut_in, FALSE) OR t0 <= 0.08 AS cut, coalesce(seeds, []) AS seeds, tab, greatest(0.05e0, t1 - t0) AS len FROM s LEFT JOIN near USING (id) LEFT JOIN sl USING (id) JOIN tab USING (id)),
b AS (SELECT b.*, row_number() OVER (PARTITION BY project ORDER BY t0, id) AS k, {_LOOKED("b.s0")} AS now FROM n0 AS b),
f AS (SELECT project, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::DOUBLE AS t1, NULL::DOUBLE AS s0, NULL::DOUBLE AS s1, FALSE AS inferred, 0e0 AS score, '' AS state, 30 AS checks FROM (SELECT DISTINCT project FROM b)
 UNION ALL SELECT b.project, b.k, b.id, b.t1, CASE WHEN ok THEN g.x0 ELSE b.s0 END, CASE WHEN ok THEN g.x1 ELSE b.s1 END, b.inferred, CASE WHEN ok THEN greatest(b.score, top.new) ELSE b.score END, CASE WHEN ok THEN 'moved' WHEN due THEN 'checked' ELSE 'kept' END, a.checks - due::INT
 FROM f AS a JOIN b ON b.project = a.project AND b.k = a.k + 1, LATERAL (SELECT a.s1 + greatest(0e0, b.t0 - a.t1) AS e) AS x, LATERAL (SELECT coalesce(b.s0 - e, 0e0) AS jump) AS y,
 LATERAL (SELECT e IS NOT NULL AND NOT b.cut AND abs(jump) > greatest(1.2e0, b.len * 1.35) AND b.now < 0.88 AS jumps) AS z,
 LATERAL (SELECT (b.now < 0.7 OR b.score < 0.78 OR b.len <= 1.25 AND (b.now < 0.82 OR b.score < 0.86) OR jumps OR b.inferred) AND a.checks > 0 AS due) AS d,
 LATERAL (SELECT list_sort(list_transform(CASE WHEN a.s1 IS NOT NULL AND NOT b.cut THEN list_append(b.seeds, {{'a': a.s1, 'w': 0.45e0}}) ELSE b.seeds END, lambda q: {{'new': {_LOOKED("q.a")}, 'w': q.w, 'm': -q.a}}), 'DESC')[1] AS top) AS t,
 LATERAL (SELECT CASE WHEN -top.m + b.len > {SOURCE_END} THEN greatest(0e0, {SOURCE_END} - b.len) ELSE -top.m END AS x0, CASE WHEN -top.m + b.len > {SOURCE_END} THEN {SOURCE_END} ELSE -top.m + b.len END AS x1) AS g,
 LATERAL (SELECT coalesce(due AND top.new >= CASE WHEN b.now < 0.62 THEN 0.66 ELSE 0.72 END AND top.new >= b.now + CASE WHEN b.now < 0.62 THEN 0.01 WHEN jumps OR coalesce(abs(x0 - e) + 0.4 < abs(jump), FALSE) THEN 0.018 ELSE 0.035 END, FALSE) AS ok) AS w)
SELECT project, id, round(s0 + 1e-9, 6) AS s0, round(s1 + 1e-9, 6) AS s1, inferred, round(score + 1e-9, 6) AS score, state FROM f WHERE k > 0""",
    "repaired_ranges": f"""WITH RECURSIVE {SHOT_SQL}, s AS (SELECT * FROM shot WHERE m0 IS NOT NULL), cut AS (SELECT project, t0 + 0.05 AS mark FROM s WHERE event_type = 'purchase' AND id % 2 = 0), near AS (SELECT s.id, bool_or(mark >= t0 - 0.08 AND mark <= t0 + 0.08) AS cut_in FROM s JOIN cut USING (project) GROUP BY s.id),
tab AS (SELECT id, list({{'p': place, 's': score}}) AS tab FROM (SELECT id, home + o AS place, {_FOUND} AS score FROM (SELECT *, unnest([{", ".join(_STEPS)}]) AS o FROM s) UNION ALL SELECT id, m0, stability FROM s) GROUP BY id),
r0 AS (SELECT s.project, row_number() OVER w AS k, t0, t1, m0 AS s0, m1 AS s1, event_type = 'error' AS inferred, confidence AS score, coalesce(cut_in, FALSE) AS cut_in, tab, lead(t0) OVER w AS n_t0, lead(m0) OVER w AS n_s0, greatest(0e0, t1 - t0) AS len FROM s LEFT JOIN near USING (id) JOIN tab USING (id) WINDOW w AS (PARTITION BY s.project ORDER BY t0, s.id)),
x AS (SELECT project, k, t0, t1, s0, s1, inferred, score, cut_in, tab, len FROM r0 WHERE k = 1
 UNION ALL SELECT b.project, b.k, b.t0, b.t1, CASE WHEN j THEN best.p ELSE b.s0 END, CASE WHEN j THEN best.p + b.len ELSE b.s1 END, b.inferred OR j, CASE WHEN j THEN best.s ELSE b.score END, b.cut_in, b.tab, b.len FROM x AS a JOIN r0 AS b ON b.project = a.project AND b.k = a.k + 1,
 LATERAL (SELECT coalesce(b.len <= 2.25 AND abs(b.t0 - a.t1) <= 0.05 AND abs(b.n_t0 - b.t1) <= 0.05 AND abs(b.s0 - a.s1) >= 20 AND abs(b.n_s0 - b.s1) >= 20 AND (b.s0 - a.s1) * (b.n_s0 - b.s1) < 0 AND abs(b.n_s0 - a.s1) <= 8, FALSE) AS j) AS c1,
 LATERAL (SELECT list_filter([{{'p': a.s1, 's': {_LOOKED("a.s1")}}}, {{'p': greatest(0e0, b.n_s0 - b.len), 's': {_LOOKED("greatest(0e0, b.n_s0 - b.len)")}}}], lambda q: q.p + b.len <= {SOURCE_END}) AS ok) AS c2,
 LATERAL (SELECT coalesce(ok[list_position(list_transform(ok, lambda q: q.s), list_max(list_transform(ok, lambda q: q.s)))], {{'p': a.s1, 's': 0e0}}) AS best) AS c3),
{_carried("y", "x", "abs(b.s0 - a.s1) > 0.35 AND abs(b.s0 - a.s1) <= 18", "0.18")},
{_carried("z", "y", "a.s1 - b.s0 > 0.35 AND a.s1 - b.s0 <= 120", "(0.13 + CASE WHEN b.len <= 0.9 THEN 0.05 ELSE 0 END)")}
SELECT project, k - 1 AS place, {_OUT} FROM z""",
}
