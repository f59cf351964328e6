"""Views that give the supplied tables the roles of segments, candidates and anchors; the same expressions serve Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.tables import table

#: name, expression. A segment is an event of a user; the clock runs in hours since the first day.
SEGMENT = (
    ("project", "user_id"),
    ("id", "event_id"),
    ("idx", "row_number() over (partition by user_id order by ts, event_id) - 1"),
    ("start", "{micros} / 3.6e9"),
    ("dur", "4e-1 + (event_id % 80) / 1e1"),
    ("visual", "least(value / 1e2, 1e0)"),
    ("temporal", "(event_id * 37 % 100) / 1e2"),
    ("stability", "(event_id * 53 % 100) / 1e2"),
    ("rank_gap", "(event_id * 29 % 100) / 1e3"),
    ("audio", "(event_id * 31 % 100) / 1e2"),
    ("gap", "(event_id * 17 % 50) / 1e1"),
    ("verify", "(event_id * 71 % 100) / 1e2"),
    ("movie_start", "case when event_id % 7 = 0 then null else {micros} / 1.2e9 + (event_id * 13 % 600) / 1e1 end"),
    ("kind", "case when event_type = 'error' then 'no_narration' when event_type = 'view' then 'non_movie' else 'has_narration' end"),
    ("event_type", "event_type"),
    ("value", "value"),
    ("ts", "ts"),
)
_MICROS = {"spark": "(unix_micros(cast(ts as timestamp)) - 1704067200000000)", "sql": "(epoch_us(ts) - 1704067200000000)"}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e.format(micros=_MICROS['spark'])} as {n}" for n, e in SEGMENT])


SEGMENT_SQL = "seg AS (SELECT " + ", ".join(f"{e.format(micros=_MICROS['sql'])} AS {n}" for n, e in SEGMENT) + " FROM events)"

#: Intervals of an order's lines on a day axis.
INTERVAL = (
    ("grp", "l_orderkey"),
    ("part", "l_partkey"),
    ("a", "l_linenumber * 3e0 + l_quantity / 1e1"),
    ("b", "l_linenumber * 3e0 + l_quantity / 1e1 + l_discount * 4e1"),
)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount").selectExpr(*[f"{e} as {n}" for n, e in INTERVAL])


INTERVAL_SQL = "iv AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in INTERVAL) + " FROM lineitem)"

#: Shots on a target's clock, one behind the other but for small gaps, and where each was found in a source: most go on
#: from the one before, some jump. Durations, gaps and jumps come from an event's value and number, in hundredths of a second.
SHOT_QUERY = """SELECT project, id, idx, event_type, value, t_c / 1e2 AS t0, (t_c + d) / 1e2 AS t1,
 CASE WHEN id % 10 <> 3 THEN (t_c + 50000 + jump) / 1e2 END AS m0, CASE WHEN id % 10 <> 3 THEN (t_c + 50000 + jump + d + CASE WHEN event_type = 'click' THEN 9 ELSE 0 END) / 1e2 END AS m1,
 (t_c + 50000) / 1e2 AS home, d / 1e2 AS dur, LEAST(value / 1e2, 1e0) AS visual, (id * 37 % 100) / 1e2 AS confidence, (id * 53 % 100) / 1e2 AS stability, (id * 29 % 100) / 1e2 AS low_info
 FROM (SELECT *, CAST(sum(d + g) OVER (PARTITION BY project ORDER BY ts, id) - d AS BIGINT) AS t_c, CAST(row_number() OVER (PARTITION BY project ORDER BY ts, id) - 1 AS BIGINT) AS idx
  FROM (SELECT user_id AS project, event_id AS id, ts, event_type, value, 12 + 10 * (CAST(floor(value * 10) AS BIGINT) % 24) AS d,
   CASE WHEN event_id % 9 = 0 THEN 10 WHEN event_id % 13 = 0 THEN 50 ELSE 0 END AS g,
   CASE CAST(floor(value * 7) AS BIGINT) % 12 WHEN 7 THEN 60 WHEN 8 THEN 300 WHEN 9 THEN -160 WHEN 10 THEN 4000 WHEN 11 THEN -90 ELSE 0 END AS jump FROM {events}) AS e) AS s"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHOT_QUERY, events=table(spark, sf_dir, "events"))


SHOT_SQL = "shot AS (" + SHOT_QUERY.format(events="events") + ")"
