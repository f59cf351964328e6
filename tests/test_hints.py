import math

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.audio import flow_consistency, window_hits, windowed_features
from chronoweave.operators.hints import recheck_hints

KIND = "k int, neighbour double, start double, stop double, candidates array<struct<score:double,start:double,end:double>>, duration double"


def hints(spark, *row):
    df = spark.createDataFrame([(0, *row)], KIND)
    return df.select(recheck_hints(F.col("neighbour"), F.col("start"), F.col("stop"), F.col("candidates"), F.col("duration"))).first()[0]


def test_hints_come_in_order_and_apart(spark):
    # the neighbour, the start; the middle is within three seconds of the start
    got = hints(spark, 100.0, 200.0, 202.0, [(0.1, 1.0, 2.0), (0.9, 300.0, 310.0), (0.5, 201.0, 203.0)], 2.0)
    # of the candidates: the best one's start and middle, nothing of the second, the start of the third; then around the seeds
    assert got[:5] == [100, 200, 300, 305, 1]
    assert got[5:] == [55, 85, 115, 145, 155, 185, 215]  # 98 and 102 are too near
    assert all(abs(a - b) > 3 for i, a in enumerate(got) for b in got[:i])


def test_hints_stop_at_twelve_and_expand_six_seeds(spark):
    many = [(1 - i / 10, 1_000.0 * (i + 1), 1_000.0 * (i + 1) + 200) for i in range(6)]
    got = hints(spark, 50.0, 20_000.0, 20_100.0, many, 9.0)
    assert len(got) == 12 and got[:11] == [50, 20_000, 20_050, 1_000, 1_100, 2_000, 2_100, 3_000, 3_100, 4_000, 4_100] and got[11] == 5


def test_hints_without_anything(spark):
    assert hints(spark, None, None, None, None, 1.0) == []
    assert hints(spark, None, -5.0, None, [], None or 0.2) == [0, 15, 45]  # clamped at 0; a second at least


def flow(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<struct<length:double,direction:double>>, b array<struct<length:double,direction:double>>")
    return df.select(flow_consistency(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(1.0, 0.0), (2.0, 1.0)], [(1.0, 2.0), (2.0, 3.0)], 1.0),  # turns count, not directions
        ([(1.0, 0.0), (2.0, 1.0), (9.0, 9.0)], [(2.0, 0.0), (2.0, 1.0 + math.pi / 2)], 0.6 * 0.75 + 0.4 * 0.5),
        ([(0.05, 0.0), (0.05, 0.0)], [(1.0, 0.0), (1.0, 0.0)], 0.6 * 0.5 + 0.4),
        ([(1.0, 0.0)], [(4.0, 0.0)], 0.6 * 0.25 + 0.4 * 0.5),
        ([], [(1.0, 0.0)], 0.0),
    ],
)
def test_flow_consistency(spark, a, b, want):
    assert flow(spark, a, b) == pytest.approx(want)


def test_windows_find_their_source_in_batch_and_stream(spark, tmp_path):
    """A stretch of the source, played again elsewhere, is found where it came from; features of a stream equal those of the table."""
    rows = [("src", i * 0.25, math.sin(i * i / 50) + 2, math.cos(i / 3) * 3) for i in range(240)]
    rows += [("query", 1_000 + i * 0.25, *rows[80 + i][2:]) for i in range(40)]
    df = spark.createDataFrame(rows, "side string, sec double, a double, b double").withColumn("ts", F.timestamp_seconds("sec"))
    batch = windowed_features(df, ["side"], "ts", ["a", "b"])
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = windowed_features(spark.readStream.schema(df.schema).parquet(path).withWatermark("ts", "1 day"), ["side"], "ts", ["a", "b"])
    run = stream.writeStream.format("memory").queryName("features").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    run.awaitTermination()
    plain = lambda d: sorted((r["side"], r["at"], [round(x, 9) for x in r["feature"]]) for r in d.collect())
    assert plain(batch) == plain(spark.table("features"))
    at = batch.withColumn("sec", F.unix_millis("at") / 1000.0).withColumn("film", F.lit("f"))
    hits = window_hits(at.where("side = 'query'").select("film", F.col("sec").alias("query"), F.col("sec").alias("q_time"), "feature"), at.where("side = 'src'").select("film", F.col("sec").alias("time"), "feature"), "film", 0.99)
    found = {r["query"]: (r["time"], round(r["confidence"], 6)) for r in hits.collect()}
    whole = [1_000 + k * 0.5 for k in range(17)]
    assert all(found[q] == (q - 1_000 + 20, 1.0) for q in whole)
    assert window_hits(at.limit(0).select("film", F.col("sec").alias("query"), F.col("sec").alias("q_time"), "feature"), at.select("film", F.col("sec").alias("time"), "feature"), "film").count() == 0
