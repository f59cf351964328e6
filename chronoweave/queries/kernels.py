"""Image kernels over embeddings read as 8 x 8 grey images, and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import kernels as K
from chronoweave.functions import vectors as V
from chronoweave.streaming.windows import metric_windows
from chronoweave.tables import table

c = F.col


def mean_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.bit_count(K.mean_hash(c("embedding"))).cast("long").alias("ones"), F.round(K.quality(c("embedding"), 8) + 1e-9, 5).alias("quality"))


def dct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the low frequencies, and how far each is from its label's first one."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("vec_id", "label", K.dct_hash(8)("embedding").alias("h"))
    first = e.groupBy("label").agg(F.min_by("h", "vec_id").alias("h0"))
    return e.join(first, "label").select("vec_id", "h", V.hamming(c("h"), c("h0")).cast("long").alias("distance"))


def layout_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the four quarters of each image."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    quarter = F.floor(c("i") / 32) * 2 + F.floor(c("i") % 8 / 4)
    return e.groupBy("vec_id", quarter.alias("quarter")).agg(F.round(F.avg(c("x").cast("double")) + 1e-9, 5).alias("mean"))


def sliding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "ts", "value").withColumn("ts", c("ts").cast("timestamp"))
    return metric_windows(e).select(F.unix_micros("start").alias("start_us"), "event_type", F.round(c("avg_value") + 1e-9, 6).alias("avg_value"), "n")


QUERIES = {f.__name__: f for f in (mean_hashes, dct_hashes, layout_descriptor, sliding_means)}

ORACLES = {
    "mean_hashes": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, embedding AS f FROM embeddings), m AS (SELECT *, list_sum(e) / len(e) AS m FROM e),
s AS (SELECT vec_id, len(list_filter(e[1:60], lambda x: x >= m)) AS ones, sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e)) AS sd, list_sum(list_transform(range(1, len(e)), lambda i: abs(e[i] - e[i + 1]))) / (len(e) - 1) AS ed,
 len(list_filter(f, lambda x: x < -0.2)) / len(e) AS dark FROM m)
SELECT vec_id, ones::BIGINT AS ones, round(0.42 * least(1e0, sd) + 0.38 * least(1e0, ed) + 0.2 * (1 - dark) + 1e-9, 5) AS quality FROM s""",
    "layout_descriptor": """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, (i // 32) * 2 + (i % 8) // 4 AS quarter, round(avg(x) + 1e-9, 5) AS mean FROM e GROUP BY ALL""",
    "sliding_means": """WITH w AS (SELECT event_type, value, (epoch_us(ts) // 10000000 - unnest([0, 1, 2, 3, 4, 5])) * 10000000 AS start_us FROM events)
SELECT start_us, event_type, round(avg(value) + 1e-9, 6) AS avg_value, count(*) AS n FROM w GROUP BY ALL""",
}
