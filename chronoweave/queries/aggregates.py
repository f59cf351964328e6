"""Reports: key figures, benchmark evaluation, percentiles, medians, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators.intervals import hull_iou
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)


def audit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, floor-index tenth percentile, least and counts below three thresholds by event type.

    Ranks are looked up in two steps, so no type is sorted whole: counts of 1,024 ranges of the score tell the range
    that a rank falls in, and the distinct scores of that range alone are counted up to it.
    """
    e = table(spark, sf_dir, "events", "event_type", "value").select("event_type", F.least(c("value") / 100, F.lit(1.0)).alias("s"))
    plain = e.groupBy("event_type").agg(F.count("s").alias("n"), E6(F.avg("s")).alias("mean"), E6(F.min("s")).alias("least"), *[F.count_if(c("s") < t).alias(f"below_{int(t * 100)}") for t in (0.66, 0.74, 0.82)])
    e = e.withColumn("range", F.floor(c("s") * 1024))
    counts = e.groupBy("event_type", "range").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("event_type").orderBy("range")
    counts = counts.withColumn("before", F.sum("k").over(upto) - c("k"))
    ranks = F.array(F.struct(F.lit("p10").alias("name"), F.least(F.floor(c("n") * 0.10), c("n") - 1).alias("rank")), F.struct(F.lit("low").alias("name"), F.floor((c("n") - 1) / 2).alias("rank")), F.struct(F.lit("high").alias("name"), F.ceil((c("n") - 1) / 2).alias("rank")))
    wanted = counts.join(plain.select("event_type", F.explode(ranks).alias("r")), "event_type").where("r.rank >= before and r.rank < before + k").select("event_type", "range", "r.name", (c("r.rank") - c("before")).alias("left"))
    inside = e.join(wanted.select("event_type", "range").distinct(), ["event_type", "range"]).groupBy("event_type", "range", "s").agg(F.count("*").alias("k"))
    reach = Window.partitionBy("event_type", "range").orderBy("s")
    at = inside.withColumn("upto", F.sum("k").over(reach)).join(wanted, ["event_type", "range"]).where("upto > left").groupBy("event_type", "name").agg(F.min("s").alias("s"))
    value = lambda name: F.max(F.when(c("name") == name, c("s")))
    found = at.groupBy("event_type").agg(E6((value("low") + value("high")) / 2).alias("median"), E6(value("p10")).alias("p10"))
    return plain.drop("n").join(found, "event_type")


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First price of a part at which the running quantity reaches half of all; equal prices are summed first."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice", "l_quantity").groupBy("l_partkey", "l_extendedprice").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey").orderBy("l_extendedprice")
    r = li.withColumn("run", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("q").over(Window.partitionBy("l_partkey")))
    return r.where("run >= total / 2").groupBy("l_partkey").agg(F.round(F.min("l_extendedprice"), 6).alias("weighted_median"))


def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against true intervals: right if the IoU is 0.8 or both ends are within 1.5; by order status and in all.

    Truth and prediction are two events' intervals of a user; rows without a prediction count as missing and wrong.
    """
    s = segments(spark, sf_dir)
    truth_start, truth_end = c("start") * 3, c("start") * 3 + c("dur")
    pred_start, pred_end = truth_start + c("gap") - 1, truth_end + c("gap") / 2 - 0.5
    have = c("movie_start").isNotNull()
    non_movie = c("kind") == "non_movie"
    near = (F.abs(pred_start - truth_start) <= 1.5) & (F.abs(pred_end - truth_end) <= 1.5)
    right = F.when(non_movie, ~have).otherwise(have & ((hull_iou(pred_start, pred_end, truth_start, truth_end) >= 0.8) | near))
    x = s.select("kind", right.alias("right"), (have & ~right).alias("false_match"), (~have & ~non_movie).alias("missing"), (~right & (c("visual") < 0.5)).alias("caught"))
    g = x.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("total"), F.count_if("right").alias("correct"), F.count_if("false_match").alias("false_matches"), F.count_if("missing").alias("missing"), F.count_if("caught").alias("caught"))
    wrong = c("total") - c("correct")
    return g.select(F.coalesce("kind", F.lit("all")).alias("scenario"), "total", "correct", "false_matches", "missing", F.round(c("correct") / c("total"), 6).alias("accuracy"), F.round(F.when(wrong == 0, F.lit(1.0)).otherwise(c("caught") / wrong), 6).alias("error_recall"))


def monotonic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of steps that don't fall back more than three seconds, and whether the project counts as sequential."""
    w = Window.partitionBy("project").orderBy("idx")
    s = segments(spark, sf_dir).where("movie_start is not null")
    s = s.withColumn("step", c("movie_start") - F.lag("movie_start").over(w))
    g = s.groupBy("project").agg(F.count("*").alias("anchors"), F.round(F.coalesce(F.avg(F.when(c("step").isNotNull(), (c("step") >= -3).cast("double"))), F.lit(1.0)), 6).alias("monotonic"), F.round(F.avg((c("visual") >= 0.45).cast("double")), 6).alias("strong"))
    return g.withColumn("mode", F.when((c("anchors") >= 10) & (c("monotonic") >= 0.74) & (c("strong") >= 0.45), "sequential").otherwise("free"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the mean of its type's values over the minute up to it.

    A window holds ten minutes of a type and the minute before them, not all rows of the type.
    """
    minute = 60_000_000
    e = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value").withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    part = lambda us: F.floor(us / (10 * minute))
    e = e.withColumn("part", F.explode(F.array_distinct(F.array(part(c("us")), part(c("us") + minute)))))
    w = Window.partitionBy("event_type", "part").orderBy("us").rangeBetween(-minute, 0)
    out = e.select("event_id", (c("part") == part(c("us"))).alias("own"), E6(F.avg("value").over(w)).alias("avg_60s"), F.count("*").over(w).alias("n_60s"))
    return out.where("own").drop("own")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that are under 30 minutes apart."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "value")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), E6(F.sum("value")).alias("total"))
    return g.select("user_id", F.unix_micros(c("w.start").cast("timestamp")).alias("start_us"), "n", "total")


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), E6(F.avg("value")).alias("avg_value"))
    return g.select(F.unix_micros(c("w.start").cast("timestamp")).alias("start_us"), "event_type", "n", "avg_value")


def confidence_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).groupBy("project").agg(F.avg("visual").alias("m"), F.stddev_pop("visual").alias("sd"))
    return g.select("project", E6(c("m")).alias("mean"), E6(c("m") - c("sd")).alias("low"), E6(c("m") + c("sd")).alias("high"))


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each metric with its alert level."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    g = e.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
    return g.select("event_type", F.round("latest", 6).alias("latest"), F.when(c("latest") >= 90, "critical").when(c("latest") >= 50, "warning").otherwise("ok").alias("level"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, statuses without any included."""
    known = spark.createDataFrame([(x,) for x in ("F", "O", "P", "X")], "status string")
    o = table(spark, sf_dir, "orders", "o_orderstatus").groupBy(c("o_orderstatus").alias("status")).count()
    return known.join(o, "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def hash_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.functions.scoring import hash_consistency as rule

    w = Window.partitionBy("project").orderBy("idx")
    s = segments(spark, sf_dir).where("movie_start is not null").withColumn("step", c("movie_start") - F.lag("movie_start").over(w))
    g = s.groupBy("project").agg(F.avg(F.when(c("step").isNotNull(), (c("step") >= -5).cast("double"))).alias("m"), F.var_pop("step").alias("v"), F.var_pop(c("gap") * 10).alias("d"))
    return g.where("m is not null").select("project", F.round(rule(c("m"), c("v"), c("d")), 5).alias("score"))


def project_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).where("kind <> 'non_movie'").groupBy("project").agg(F.max(F.round(c("start") + c("dur"), 9)).alias("e"))
    return g.select("project", (c("e") * 1_000_000).cast("long").alias("duration_us"))


QUERIES = {f.__name__: f for f in (audit_percentiles, weighted_median, benchmark_eval, monotonic_ratio, moving_average, sessions, tumbling_counts, confidence_interval, latest_metrics, status_counts, hash_consistency, project_duration)}

ORACLES = {
    "audit_percentiles": """WITH e AS (SELECT event_type, event_id, least(value / 100, 1e0) AS s FROM events),
l AS (SELECT event_type, list_sort(list(s)) AS a, count(*) AS n FROM e GROUP BY event_type)
SELECT event_type, round(avg(s) + 1e-9, 6) AS mean, round(quantile_cont(s, 0.5) + 1e-9, 6) AS median, round(any_value(a[least(floor(n * 0.10), n - 1)::BIGINT + 1]) + 1e-9, 6) AS p10, round(min(s) + 1e-9, 6) AS least,
 count_if(s < 0.66)::BIGINT AS below_66, count_if(s < 0.74)::BIGINT AS below_74, count_if(s < 0.82)::BIGINT AS below_82 FROM e JOIN l USING (event_type) GROUP BY event_type""",
    "weighted_median": """WITH g AS (SELECT l_partkey, l_extendedprice, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS run, sum(q) OVER (PARTITION BY l_partkey) AS total FROM g)
SELECT l_partkey, round(min(l_extendedprice), 6) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY l_partkey""",
    "benchmark_eval": f"""WITH {SEGMENT_SQL}, p AS (SELECT *, start * 3 AS t1, start * 3 + dur AS t2, start * 3 + gap - 1 AS p1, start * 3 + dur + gap / 2 - 0.5 AS p2, movie_start IS NOT NULL AS have, kind = 'non_movie' AS nm FROM seg),
r AS (SELECT *, CASE WHEN nm THEN NOT have ELSE have AND (CASE WHEN greatest(p2, t2) - least(p1, t1) > 0 THEN greatest(0e0, least(p2, t2) - greatest(p1, t1)) / (greatest(p2, t2) - least(p1, t1)) ELSE 0 END >= 0.8
  OR (abs(p1 - t1) <= 1.5 AND abs(p2 - t2) <= 1.5)) END AS ok FROM p),
g AS (SELECT coalesce(kind, 'all') AS scenario, count(*) AS total, count_if(ok)::BIGINT AS correct, count_if(have AND NOT ok)::BIGINT AS false_matches, count_if(NOT have AND NOT nm)::BIGINT AS missing, count_if(NOT ok AND visual < 0.5)::BIGINT AS caught FROM r GROUP BY GROUPING SETS ((kind), ()))
SELECT scenario, total, correct, false_matches, missing, round(correct / total, 6) AS accuracy, round(CASE WHEN total = correct THEN 1e0 ELSE caught / (total - correct) END, 6) AS error_recall FROM g""",
    "monotonic_ratio": f"""WITH {SEGMENT_SQL}, k AS (SELECT *, movie_start - lag(movie_start) OVER (PARTITION BY project ORDER BY idx) AS step FROM seg WHERE movie_start IS NOT NULL),
g AS (SELECT project, count(*) AS anchors, round(coalesce(avg(CASE WHEN step IS NOT NULL THEN (step >= -3)::INT END), 1), 6) AS monotonic, round(avg((visual >= 0.45)::INT), 6) AS strong FROM k GROUP BY project)
SELECT *, CASE WHEN anchors >= 10 AND monotonic >= 0.74 AND strong >= 0.45 THEN 'sequential' ELSE 'free' END AS mode FROM g""",
    "moving_average": """SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS avg_60s, count(*) OVER w AS n_60s FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""",
    "sessions": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value) + 1e-9, 6) AS total FROM i GROUP BY user_id, k""",
    "tumbling_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(avg(value) + 1e-9, 6) AS avg_value FROM events GROUP BY ALL",
    "confidence_interval": f"WITH {SEGMENT_SQL} SELECT project, round(avg(visual) + 1e-9, 6) AS mean, round(avg(visual) - stddev_pop(visual) + 1e-9, 6) AS low, round(avg(visual) + stddev_pop(visual) + 1e-9, 6) AS high FROM seg GROUP BY project",
    "latest_metrics": """WITH l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY event_type)
SELECT event_type, round(latest, 6) AS latest, CASE WHEN latest >= 90 THEN 'critical' WHEN latest >= 50 THEN 'warning' ELSE 'ok' END AS level FROM l""",
    "status_counts": "SELECT s AS status, count(o_orderstatus) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s",
    "hash_consistency": f"""WITH {SEGMENT_SQL}, k AS (SELECT *, movie_start - lag(movie_start) OVER (PARTITION BY project ORDER BY idx) AS step FROM seg WHERE movie_start IS NOT NULL),
g AS (SELECT project, avg(CASE WHEN step IS NOT NULL THEN (step >= -5)::INT END) AS m, var_pop(step) AS v, var_pop(gap * 10) AS d FROM k GROUP BY project)
SELECT project, round(0.4 * m + 0.3 / (1 + v / 10) + 0.3 / (1 + d / 25), 5) AS score FROM g WHERE m IS NOT NULL""",
    "project_duration": f"WITH {SEGMENT_SQL} SELECT project, CAST(trunc(max(round(start + dur, 9)) * 1000000) AS BIGINT) AS duration_us FROM seg WHERE kind <> 'non_movie' GROUP BY project",
}
