import pytest
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.operators import retime as R


def code(k, n=40):
    return [1.0 if i == k else 0.0 for i in range(n)]


@pytest.fixture(scope="module")
def film(spark):
    """A source of 40 frames, four a second, each unlike all others; a target that shows it at 1.2 times the speed from 1 s on."""
    frames = spark.createDataFrame([("f", i * 0.25, code(i)) for i in range(40)], "k string, time double, vector array<double>")
    looks = spark.createDataFrame([("f", i, code(min(39, 4 + round(i * 1.2)))) for i in range(20)], "k string, frame bigint, vector array<double>")
    return looks, frames


def alike():
    return V.dot(F.col("asked"), F.col("shown"))


def test_scores_are_best_where_the_source_is(spark, film):
    starts = spark.createDataFrame([("f", 1, 0.0, 1.0, s) for s in (0.0, 1.0, 5.0)] + [("f", 2, 100.0, 1.0, 1.0), ("f", 3, 0.0, 1.0, 90.0)], "k string, id int, t0 double, duration double, start double")
    got = {(r["id"], r["start"]): r["score"] for r in R.range_scores(starts, *film, "k", alike(), alike(), 0.25).collect()}
    # one sample at 0.5 s, which shows the frame at 1.5 s: three frames from 1.25 on are looked at
    assert got[1, 1.0] == 1.0 and got[1, 0.0] == 0.0 and got[1, 5.0] == 0.0
    assert (2, 1.0) not in got and got[3, 90.0] == 0.0  # nothing shown by the target; nothing near in the source


def test_retimed_to_the_speed_of_the_target(spark, film):
    rows = spark.createDataFrame([("f", 1, 0.0, 3.0, 1.1, 4.1, 0.5), ("f", 2, 0.0, 1.0, 1.0, 2.0, 0.5), ("f", 3, 0.0, 3.0, 60.0, 63.0, 0.5)], "k string, id int, t0 double, t1 double, s0 double, s1 double, score double")
    got = {r["id"]: r for r in R.retimed_ranges(rows, *film, "k", alike(), alike(), 10.0).collect()}
    assert got[1]["fitted"] and 1.1 <= (got[1]["s1"] - got[1]["s0"]) / 3 <= 1.25 and got[1]["score"] > 0.6
    assert not got[2]["fitted"] and (got[2]["s0"], got[2]["s1"]) == (1.0, 2.0)  # too short
    assert not got[3]["fitted"] and got[3]["score"] == 0.5  # no frame near
    assert R.retimed_ranges(rows.limit(0), *film, "k", alike(), alike()).count() == 0


def test_local_best_takes_the_earliest_of_equals(spark, film):
    _, frames = film
    asked = spark.createDataFrame([("f", 1, "in", 2.0, [0.5 if i in (6, 9) else 0.0 for i in range(40)]), ("f", 2, "in", 2.0, code(39))], "k string, id int, edge string, hint double, asked array<double>")
    got = R.local_best(asked, frames, "k", 1.35, alike(), F.lit(0.0)).collect()
    assert [(r["id"], r["time"], r["score"]) for r in got] == [(1, 1.5, 0.5)]
