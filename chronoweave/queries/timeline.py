"""Timeline segments from events and their key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.tables import table


def timeline_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "events", "event_type", "value")
    conf = F.col("value") / 500
    return seg.groupBy("event_type").agg(
        F.count("*").alias("total"),
        F.count_if(conf >= 0.82).alias("auto_accepted"),
        F.count_if(conf < 0.78).alias("needs_review"),
        F.round(F.avg(conf), 6).alias("avg_confidence"),
    )


QUERIES = {"timeline_kpis": timeline_kpis}
ORACLES = {
    "timeline_kpis": """
SELECT event_type, count(*) AS total, count_if(value / 500 >= 0.82)::BIGINT AS auto_accepted, count_if(value / 500 < 0.78)::BIGINT AS needs_review,
  round(avg(value / 500), 6) AS avg_confidence FROM events GROUP BY event_type"""
}
