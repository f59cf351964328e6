"""Hints of a second search, searches by windows of sound, courses of motion, variants of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import audio as A
from chronoweave.operators import hints as H
from chronoweave.plans.bindings import SHOT_SQL, shots
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)


def recheck_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of each shot: the shot before it as the neighbour, and six candidates around its natural place."""
    s = shots(spark, sf_dir).selectExpr("*", "lag(m0) over (partition by project order by idx) as neighbour")
    cand = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.struct(((c("id") * k * 7 % 100) / 100).alias("score"), (c("home") + k * (c("id") % 5) * 2.5 - 10).alias("start"), (c("home") + k * (c("id") % 5) * 2.5 - 10 + k).alias("end")))
    cand = F.when(c("id") % 8 != 0, cand)
    out = s.select("project", "id", F.posexplode(H.recheck_hints(c("neighbour"), c("m0"), c("m1"), cand, c("dur"))).alias("k", "hint"))
    return out.select("project", "id", c("k").cast("long").alias("k"), E6(c("hint")).alias("hint"))


def window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours of each type's events of even users, every thirty minutes, against those of odd users."""
    e = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value", "event_id").withColumn("ts", c("ts").cast("timestamp"))
    e = e.selectExpr("ts", "event_type", "user_id % 2 as side", "least(value, 200) as c1", "event_id * 37 % 101 as c2", "user_id * 1e0 as c3")
    w = A.windowed_features(e, ["event_type", "side"], "ts", ["c1", "c2", "c3"], "2 hours", "30 minutes").withColumn("time", F.unix_seconds("at").cast("double"))
    queries = w.where("side = 0").select("event_type", c("time").cast("long").alias("query"), c("time").alias("q_time"), "feature")
    out = A.window_hits(queries, w.where("side = 1").select("event_type", "time", "feature"), "event_type", 0.9)
    return out.select("event_type", "query", c("time").cast("long").alias("found"), F.round("confidence", 6).alias("confidence"))


def flow_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion of each row, its elements in pairs as steps, against that of the row behind it, of which every seventh is short."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    flow = F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.struct(F.round(F.hypot(F.element_at("embedding", i).cast("double"), F.element_at("embedding", i + 1).cast("double")), 9).alias("length"), F.round(F.atan2(F.element_at("embedding", i + 1).cast("double"), F.element_at("embedding", i).cast("double")), 9).alias("direction")))
    f = e.select("vec_id", flow.alias("flow"))
    behind = f.select((c("vec_id") - 1).alias("vec_id"), F.slice("flow", F.lit(1), F.when(c("vec_id") % 7 == 0, (c("vec_id") % 3).cast("int")).otherwise(F.lit(32))).alias("other"))
    return f.join(behind, "vec_id").select("vec_id", F.round(A.flow_consistency(c("flow"), c("other")), 6).alias("consistency"))


QUERIES = {f.__name__: f for f in (recheck_hints, window_hits, flow_consistency)}

_KEEP = lambda kept, values: f"list_reduce(list_prepend({kept}, list_transform(list_filter({values}, lambda v: v IS NOT NULL), lambda v: [v])), lambda a, x: CASE WHEN len(list_filter(a, lambda k: abs(k - x[1]) <= 3)) > 0 THEN a ELSE list_concat(a, x) END)"
_FEATURE = ", ".join([*(f"avg({x})" for x in ("c1", "c2", "c3")), *(f"stddev_pop({x})" for x in ("c1", "c2", "c3"))])

ORACLES = {
    "recheck_hints": f"""WITH {SHOT_SQL}, n AS (SELECT *, lag(m0) OVER (PARTITION BY project ORDER BY idx) AS nb FROM shot),
k AS (SELECT *, CASE WHEN id % 8 <> 0 THEN list_sort(list_transform(range(1, 7), lambda k: {{'o': -(id * k * 7 % 100) / 100e0, 'k': k}}))[1:4] ELSE [] END AS cs FROM n),
v AS (SELECT *, list_concat([greatest(0e0, nb + 0), CASE WHEN m0 IS NOT NULL THEN greatest(0e0, m0) END, CASE WHEN m0 IS NOT NULL THEN greatest(0e0, (m0 + m1) / 2) END],
 flatten(list_transform(cs, lambda x: [greatest(0e0, home + x.k * (id % 5) * 2.5e0 - 10), greatest(0e0, (home + x.k * (id % 5) * 2.5e0 - 10 + (home + x.k * (id % 5) * 2.5e0 - 10 + x.k)) / 2)]))) AS vals0 FROM k),
v1 AS (SELECT *, CASE WHEN nb IS NULL THEN vals0[2:] ELSE vals0 END AS vals FROM v),
s AS (SELECT *, {_KEEP("[]::DOUBLE[]", "vals")} AS seeds, greatest(1e0, dur) AS len FROM v1),
w AS (SELECT *, {_KEEP("seeds", "flatten(list_transform(seeds[1:6], lambda y: [greatest(0e0, y - 45), greatest(0e0, y - 15), greatest(0e0, y - len), greatest(0e0, y + len), greatest(0e0, y + 15), greatest(0e0, y + 45)]))")} AS hints FROM s)
SELECT project, id, unnest(range(0, len(hints[1:12]))) AS k, round(unnest(hints[1:12]) + 1e-9, 6) AS hint FROM w""",
    "window_hits": f"""WITH e AS (SELECT (epoch_us(ts::TIMESTAMP) // 1000000) AS sec, event_type, user_id % 2 AS side, least(value, 200) AS c1, event_id * 37 % 101 AS c2, user_id * 1e0 AS c3 FROM events),
w AS (SELECT event_type, side, sec // 1800 * 1800 - k * 1800 AS at_, {_FEATURE} FROM (SELECT *, unnest(range(0, 4)) AS k FROM e) GROUP BY ALL),
f AS (SELECT event_type, side, at_, [{", ".join(f'"{x}"' for x in _FEATURE.split(", "))}] AS raw FROM w),
u AS (SELECT event_type, side, at_, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v FROM f),
p AS (SELECT q.event_type, q.at_ AS query, i.at_ AS found, round(list_dot_product(q.v, i.v), 9) AS s FROM u AS q JOIN u AS i ON q.event_type = i.event_type AND q.side = 0 AND i.side = 1 QUALIFY row_number() OVER (PARTITION BY q.event_type, q.at_ ORDER BY s DESC, found) = 1)
SELECT event_type, query, found, round((s + 1) / 2, 6) AS confidence FROM p WHERE (s + 1) / 2 >= 0.9""",
    "flow_consistency": """WITH f AS (SELECT vec_id, list_transform(range(1, 64, 2), lambda i: {'m': round(sqrt(embedding[i]::DOUBLE * embedding[i] + embedding[i + 1]::DOUBLE * embedding[i + 1]), 9), 'd': round(atan2(embedding[i + 1]::DOUBLE, embedding[i]::DOUBLE), 9)}) AS f FROM embeddings),
j AS (SELECT a.vec_id, a.f AS a, CASE WHEN b.vec_id % 7 = 0 THEN b.f[1:b.vec_id % 3] ELSE b.f END AS b FROM f AS a JOIN f AS b ON b.vec_id = a.vec_id + 1), n AS (SELECT vec_id, b, a[1:len(b)] AS a, len(b) AS n FROM j),
r AS (SELECT *, list_transform(list_filter(list_zip(a, b), lambda p: p[1].m > 0.1 AND p[2].m > 0.1), lambda p: least(p[1].m, p[2].m) / greatest(p[1].m, p[2].m)) AS ratio,
 list_transform(range(1, n), lambda i: 1 - least(abs((a[i + 1].d - a[i].d) - (b[i + 1].d - b[i].d)) / pi(), 1e0)) AS turn FROM n)
SELECT vec_id, round(CASE WHEN n = 0 THEN 0 ELSE coalesce(list_sum(ratio) / nullif(len(ratio), 0), 0.5) * 0.6 + coalesce(list_sum(turn) / nullif(len(turn), 0), 0.5) * 0.4 END, 6) AS consistency FROM r""",
}
