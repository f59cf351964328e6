"""Ordered scans and interval operators over segments and line intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import folds as G
from chronoweave.operators import intervals as I
from chronoweave.plans.bindings import INTERVAL_SQL, SEGMENT_SQL, intervals, segments

c = F.col
R6 = lambda x: F.round(x, 6)


def _seg(spark, sf_dir) -> DataFrame:
    return segments(spark, sf_dir).withColumn("end", c("start") + c("dur"))


def gap_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.inject_gaps(_seg(spark, sf_dir), ["project"], "start", "end", F.lit(760.0), 1.2)
    return out.select("project", R6("start").alias("start"), R6("end").alias("end"))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.merge_ranges(intervals(spark, sf_dir), ["grp"], "a", "b")
    return out.select("grp", R6("a").alias("a"), R6("b").alias("b"), "n")


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.split_long(_seg(spark, sf_dir).select("id", "start", "end"), "start", "end", 3.2)
    return out.select("id", "part", "parts", R6("start").alias("start"), R6("end").alias("end"))


def neighbor_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.neighbour_hint(segments(spark, sf_dir), ["project"], "start", "movie_start").where("movie_start is null")
    return out.select("id", R6("prev_value").alias("prev_value"), R6("next_value").alias("next_value"), R6("hint").alias("hint"))


def temporal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.temporal_outliers(segments(spark, sf_dir), ["project"], "start", "movie_start", 25.0)
    return out.select("id", R6("expected").alias("expected"))


def source_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seg(spark, sf_dir).where("movie_start is not null").withColumn("movie_end", c("movie_start") + c("dur"))
    out = I.source_jumps(s, ["project"], "idx", "start", "end", "movie_start", "movie_end")
    return out.select("id", R6("target_gap").alias("target_gap"), R6("jump").alias("jump"), "flagged")


def low_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("project", c("start").alias("time"), "visual")
    out = I.low_groups(s, ["project"], "time", "visual", 0.66, 10.0)
    return out.select("project", *[F.round(c(x) + 1e-9, 6).alias(x) for x in ("start", "end", "mean", "least", "worst_at")], "n")


def locate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seg(spark, sf_dir)
    probes = s.select("project").distinct().select("project", F.explode(F.transform(F.sequence(F.lit(0), F.lit(700), F.lit(25)), lambda x: x.cast("double"))).alias("at"))
    found = I.locate_asof(probes, s.where("movie_start is not null"), ["project"], "at", "start", ["id", "start", "end", "movie_start"])
    inside = c("at") <= c("end")
    return found.where("id is not null").select("project", "at", "id", inside.alias("inside"), R6(F.when(inside, c("movie_start") + c("at") - c("start"))).alias("source"))


def interval_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and hull IoU of each interval with the group's next one."""
    w = Window.partitionBy("grp").orderBy("a", "b", "part")
    d = intervals(spark, sf_dir).distinct()
    d = d.withColumn("a2", F.lead("a").over(w)).withColumn("b2", F.lead("b").over(w)).where("a2 is not null")
    return d.select("grp", "part", R6("a").alias("a"), R6(I.overlap(c("a"), c("b"), c("a2"), c("b2"))).alias("overlap"), R6(I.hull_iou(c("a"), c("b"), c("a2"), c("b2"))).alias("iou"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside an order's intervals, counted by order."""
    iv = intervals(spark, sf_dir)
    points = iv.select("grp", F.round("a", 0).alias("t")).distinct()
    return I.range_join(points, iv, ["grp"], "t", "a", "b", 2.0).groupBy("grp").agg(F.count("*").alias("hits"), R6(F.sum("t")).alias("sum_t"))


def monotonic_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("movie_start is not null").withColumn("movie_end", c("movie_start") + c("dur"))
    out = G.monotonic_guard(s, ["project"], "idx", "movie_start", "movie_end")
    return out.select("id", F.round(c("guarded_start") + 1e-9, 6).alias("guarded_start"), F.round(c("guarded_end") + 1e-9, 6).alias("guarded_end"))


def nms_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.nms(segments(spark, sf_dir), ["project"], "visual", "start", "id", 12.0)
    return out.select("project", c("rank").cast("long").alias("rank"), "id", R6("visual").alias("visual"))


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("project", "idx", (c("start") / 10).alias("start"), (c("start") / 10 + c("dur") / 12).alias("end"))
    out = G.chunk_pack(s, ["project"], "idx", "start", "end", max_gap=1.0)
    return out.groupBy("project", "chunk").agg(F.count("*").alias("n"), R6(F.min("start")).alias("start"), R6(F.max("end")).alias("end"))


def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("project", "idx", (c("start") / 10).alias("start"), (c("start") / 10 + c("dur") / 6).alias("end"), "kind")
    out = G.merge_short(s, ["project"], "idx", "start", "end", "kind", max_gap=1.0)
    return out.select("project", "place", R6("start").alias("start"), R6("end").alias("end"), "kind", "n")


def fill_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.interpolate_anchors(segments(spark, sf_dir), ["project"], "start", "movie_start")
    return out.select("id", R6("hint").alias("estimate"), R6("confidence").alias("confidence"))


def running_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("project").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = segments(spark, sf_dir).where("kind <> 'non_movie'")
    return s.select("id", R6(F.coalesce(F.sum("dur").over(w), F.lit(0.0))).alias("record_in"))


def sparse_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth matched row of a project, its first and its last."""
    w = Window.partitionBy("project")
    s = segments(spark, sf_dir).where("movie_start is not null").withColumn("rn", (F.row_number().over(w.orderBy("idx")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    return s.where("rn % 5 = 0 or rn = n - 1").select("id", "rn")


def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 rows that overlap by four, each row kept where it is nearest the middle."""
    s = segments(spark, sf_dir)
    ch = s.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((c("idx") - 3) / 16)), F.floor(c("idx") / 16))))
    at = c("idx") - c("chunk") * 16
    ch = ch.where((at >= 0) & (at < 20)).withColumn("off", F.abs(at - 9.5))
    best = ch.groupBy("id").agg(F.min_by("chunk", F.struct("off", "chunk")).alias("chunk"))
    return best


QUERIES = {f.__name__: f for f in (gap_injection, merge_ranges, split_long, neighbor_hint, temporal_outliers, source_jumps, low_groups, locate_asof, interval_iou, interval_join, monotonic_guard, nms_dedupe, chunk_packing, merge_short, fill_interpolate, running_timeline, sparse_anchors, overlapping_chunks)}

_SEG_END = SEGMENT_SQL + ", sge AS (SELECT *, start + dur AS end_ FROM seg)"
ORACLES = {
    "gap_injection": f"""WITH {_SEG_END},
g AS (SELECT project, coalesce(max(end_) OVER (PARTITION BY project ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, least(start, 760e0) AS b FROM sge
  UNION ALL SELECT project, max(end_), 760e0 FROM sge GROUP BY project)
SELECT project, round(a, 6) AS start, round(b, 6) AS "end" FROM g WHERE b - a >= 1.2""",
    "merge_ranges": f"""WITH {INTERVAL_SQL}, r AS (SELECT *, max(b) OVER (PARTITION BY grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
f AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT grp, round(min(a), 6) AS a, round(max(b), 6) AS b, count(*) AS n FROM f GROUP BY grp, island""",
    "split_long": f"""WITH {_SEG_END}, p AS (SELECT id, start, end_, greatest(1, ceil((end_ - start) / 3.2))::INT AS parts FROM sge), q AS (SELECT *, unnest(range(0, parts)) AS k FROM p)
SELECT id, k::INT AS part, parts, round(start + (end_ - start) * k / parts, 6) AS start, round(start + (end_ - start) * (k + 1) / parts, 6) AS "end" FROM q""",
    "neighbor_hint": f"""WITH {SEGMENT_SQL}, n AS (SELECT *, last_value(CASE WHEN movie_start IS NOT NULL THEN start END IGNORE NULLS) OVER p AS po, last_value(movie_start IGNORE NULLS) OVER p AS pv,
 first_value(CASE WHEN movie_start IS NOT NULL THEN start END IGNORE NULLS) OVER x AS no, first_value(movie_start IGNORE NULLS) OVER x AS nv FROM seg
 WINDOW p AS (PARTITION BY project ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x AS (PARTITION BY project ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT id, round(pv, 6) AS prev_value, round(nv, 6) AS next_value, round(coalesce(pv + (nv - pv) * (start - po) / nullif(no - po, 0), pv, nv), 6) AS hint FROM n WHERE movie_start IS NULL""",
    "temporal_outliers": f"""WITH {SEGMENT_SQL}, k AS (SELECT * FROM seg WHERE movie_start IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, (lag(start, 2) OVER w + lag(start) OVER w) / 2 AS lo, (lag(movie_start, 2) OVER w + lag(movie_start) OVER w) / 2 AS lv,
 (lead(start, 2) OVER w + lead(start) OVER w) / 2 AS ro, (lead(movie_start, 2) OVER w + lead(movie_start) OVER w) / 2 AS rv FROM k WINDOW w AS (PARTITION BY project ORDER BY start)),
e AS (SELECT *, lv + (rv - lv) * (start - lo) / nullif(ro - lo, 0) AS expected FROM n)
SELECT id, round(expected, 6) AS expected FROM e WHERE n >= 7 AND abs(movie_start - expected) > 25""",
    "source_jumps": f"""WITH {_SEG_END}, k AS (SELECT *, movie_start + dur AS me FROM sge WHERE movie_start IS NOT NULL),
n AS (SELECT id, start, end_, start - lag(end_) OVER w AS g, movie_start - lag(me) OVER w AS j FROM k WINDOW w AS (PARTITION BY project ORDER BY idx))
SELECT id, round(g, 6) AS target_gap, round(j, 6) AS jump, coalesce(abs(g) > 0.08 OR j < -0.25 OR abs(j) > 8 OR end_ - start < 0.5, false) AS flagged FROM n""",
    "low_groups": f"""WITH {SEGMENT_SQL}, l AS (SELECT project, start AS t, visual AS v FROM seg WHERE visual < 0.66),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 16 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY project ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT project, round(min(t) + 1e-9, 6) AS start, round(max(t) + 1e-9, 6) AS "end", round(avg(v) + 1e-9, 6) AS mean, round(min(v) + 1e-9, 6) AS least, round(arg_min(t, (v, t)) + 1e-9, 6) AS worst_at, count(*) AS n FROM i GROUP BY project, island""",
    "locate_asof": f"""WITH {_SEG_END}, p AS (SELECT project, unnest(range(0, 701, 25))::DOUBLE AS "at" FROM (SELECT DISTINCT project FROM seg)), k AS (SELECT * FROM sge WHERE movie_start IS NOT NULL)
SELECT p.project, p."at", k.id, p."at" <= k.end_ AS inside, round(CASE WHEN p."at" <= k.end_ THEN k.movie_start + p."at" - k.start END, 6) AS source
FROM p ASOF JOIN k ON p.project = k.project AND p."at" >= k.start""",
    "interval_iou": f"""WITH {INTERVAL_SQL}, d AS (SELECT DISTINCT * FROM iv), n AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM d WINDOW w AS (PARTITION BY grp ORDER BY a, b, part))
SELECT grp, part, round(a, 6) AS a, round(greatest(0e0, least(b, b2) - greatest(a, a2)), 6) AS overlap,
 round(CASE WHEN greatest(b, b2) - least(a, a2) > 0 THEN greatest(0e0, least(b, b2) - greatest(a, a2)) / (greatest(b, b2) - least(a, a2)) ELSE 0 END, 6) AS iou FROM n WHERE a2 IS NOT NULL""",
    "interval_join": f"""WITH {INTERVAL_SQL}, p AS (SELECT DISTINCT grp, round(a, 0) AS t FROM iv)
SELECT p.grp, count(*) AS hits, round(sum(t), 6) AS sum_t FROM p JOIN iv ON p.grp = iv.grp AND t BETWEEN a AND b GROUP BY p.grp""",
    "monotonic_guard": f"""WITH {SEGMENT_SQL}, k AS (SELECT *, movie_start + dur AS me FROM seg WHERE movie_start IS NOT NULL),
g AS (SELECT *, greatest(movie_start, coalesce(max(greatest(movie_start, me)) OVER (PARTITION BY project ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), movie_start)) AS gs FROM k)
SELECT id, round(gs + 1e-9, 6) AS guarded_start, round(greatest(me, gs) + 1e-9, 6) AS guarded_end FROM g""",
    "nms_dedupe": f"""WITH RECURSIVE {SEGMENT_SQL}, o AS (SELECT project, id, start, visual, row_number() OVER (PARTITION BY project ORDER BY visual DESC, id) AS rn FROM seg),
f AS (SELECT project, 0::BIGINT AS rn, []::DOUBLE[] AS kept, false AS keep, NULL::BIGINT AS id, NULL::DOUBLE AS visual FROM (SELECT DISTINCT project FROM o)
 UNION ALL SELECT f.project, o.rn, CASE WHEN len(list_filter(f.kept, lambda y: abs(y - o.start) < 12)) = 0 THEN list_append(f.kept, o.start) ELSE f.kept END, len(list_filter(f.kept, lambda y: abs(y - o.start) < 12)) = 0, o.id, o.visual
 FROM f JOIN o ON o.project = f.project AND o.rn = f.rn + 1)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY rn) AS rank, id, round(visual, 6) AS visual FROM f WHERE keep""",
    "chunk_packing": f"""WITH RECURSIVE {SEGMENT_SQL}, s AS (SELECT project, idx, start / 10 AS a, start / 10 + dur / 12 AS b FROM seg),
f AS (SELECT project, idx, 0 AS chunk, a AS first, b AS last, 1 AS n, a, b FROM s WHERE idx = 0
 UNION ALL SELECT s.project, s.idx, f.chunk + x.new, CASE WHEN x.new = 1 THEN s.a ELSE f.first END, CASE WHEN x.new = 1 THEN s.b ELSE greatest(f.last, s.b) END, CASE WHEN x.new = 1 THEN 1 ELSE f.n + 1 END, s.a, s.b
 FROM f JOIN s ON s.project = f.project AND s.idx = f.idx + 1,
 LATERAL (SELECT CASE WHEN s.a - f.last > 1.0 OR (f.n >= 8 AND f.last - f.first >= 2.2) OR greatest(f.last, s.b) - f.first > 3.2 THEN 1 ELSE 0 END AS new) AS x)
SELECT project, chunk, count(*) AS n, round(min(a), 6) AS start, round(max(b), 6) AS "end" FROM f GROUP BY project, chunk""",
    "merge_short": f"""WITH RECURSIVE {SEGMENT_SQL}, s AS (SELECT project, idx, start / 10 AS a, start / 10 + dur / 6 AS b, kind FROM seg),
f AS (SELECT project, idx, 0 AS place, a, b, kind, 1 AS n FROM s WHERE idx = 0
 UNION ALL SELECT s.project, s.idx, f.place + 1 - x.j, CASE WHEN x.j = 1 THEN f.a ELSE s.a END, CASE WHEN x.j = 1 THEN greatest(f.b, s.b) ELSE s.b END, s.kind, CASE WHEN x.j = 1 THEN f.n + 1 ELSE 1 END
 FROM f JOIN s ON s.project = f.project AND s.idx = f.idx + 1,
 LATERAL (SELECT CASE WHEN f.kind = s.kind AND s.a - f.b <= 1.0 AND greatest(f.b, s.b) - f.a <= 8 AND (f.b - f.a < 1.2 OR s.b - s.a < 1.2) THEN 1 ELSE 0 END AS j) AS x)
SELECT project, place, round(arg_max(a, idx), 6) AS start, round(arg_max(b, idx), 6) AS "end", arg_max(kind, idx) AS kind, max(n) AS n FROM f GROUP BY project, place""",
    "fill_interpolate": f"""WITH {SEGMENT_SQL}, n AS (SELECT *, last_value(CASE WHEN movie_start IS NOT NULL THEN start END IGNORE NULLS) OVER p AS po, last_value(movie_start IGNORE NULLS) OVER p AS pv,
 first_value(CASE WHEN movie_start IS NOT NULL THEN start END IGNORE NULLS) OVER x AS no, first_value(movie_start IGNORE NULLS) OVER x AS nv FROM seg
 WINDOW p AS (PARTITION BY project ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x AS (PARTITION BY project ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT id, round(coalesce(pv + (nv - pv) * (start - po) / nullif(no - po, 0), pv, nv), 6) AS estimate, round(greatest(0.2e0, least(0.7e0, 0.7 * exp(-least(start - po, no - start) / 60) + 0.2)), 6) AS confidence FROM n WHERE movie_start IS NULL""",
    "running_timeline": f"""WITH {SEGMENT_SQL} SELECT id, round(coalesce(sum(dur) OVER (PARTITION BY project ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS record_in FROM seg WHERE kind <> 'non_movie'""",
    "sparse_anchors": f"""WITH {SEGMENT_SQL}, s AS (SELECT id, row_number() OVER (PARTITION BY project ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY project) AS n FROM seg WHERE movie_start IS NOT NULL)
SELECT id, rn FROM s WHERE rn % 5 = 0 OR rn = n - 1""",
    "overlapping_chunks": f"""WITH {SEGMENT_SQL}, k AS (SELECT id, idx, unnest(range(greatest(0, floor((idx - 3) / 16))::BIGINT, (idx // 16) + 1)) AS chunk FROM seg)
SELECT id, arg_min(chunk, (abs(idx - chunk * 16 - 9.5), chunk)) AS chunk FROM k WHERE idx - chunk * 16 BETWEEN 0 AND 19 GROUP BY id""",
}
