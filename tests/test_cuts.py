import pytest
from pyspark.sql import functions as F

from chronoweave.operators import cuts as C


def frames(spark, looks, step=0.25):
    """One frame for each letter: upper case and lower case of a letter differ little."""
    rows = []
    for i, x in enumerate(looks):
        hist = [1.0] * 4
        hist["abcd".index(x.lower())] = 20.0 if x.islower() else 19.0
        rows.append(("f", i, i * step, len(looks) * step, hist, [float(255 * (x.lower() == k)) for k in "abcd"], [0.0] * 4))
    return spark.createDataFrame(rows, "film string, frame bigint, time double, duration double, hist array<double>, pixels array<double>, edges array<double>")


def test_differences(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(C.chi_square(F.col("a"), F.col("b"))).collect()] == [0, 1, round(0.04 / 0.6 + 0.04 / 0.8, 4)]
    assert [round(r[0], 4) for r in df.select(C.mean_difference(F.col("a"), F.col("b"), 1.0)).collect()] == [0, 1, 1]


def test_scenes_have_a_least_length(spark):
    # cuts at 0.5 (too early), 1.0, 1.5 (too early after 1.0) and 2.25; a cut that is passed over moves no later one
    got = C.scenes(frames(spark, "aabbccdddaaa"), "film", threshold=1.0)
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [(0, 1.0), (1.0, 2.25), (2.25, 3.0)]
    assert [(r["start"], r["end"]) for r in C.scenes(frames(spark, "aAaA"), "film", threshold=1.0).collect()] == [(0, 1.0)]
    assert C.scenes(frames(spark, "aA").limit(0), "film").count() == 0


def rows(spark, *spans):
    return spark.createDataFrame([("f", i, a, b, k) for i, (a, b, k) in enumerate(spans)], "film string, id int, start double, stop double, keep boolean")


@pytest.mark.parametrize(
    ("looks", "span", "parts"),
    [
        ("aaaabbbbccccc", (0.0, 3.0), [(0, 1.0), (1.0, 2.0), (2.0, 3.0)]),
        ("aabbbbbbbbbbb", (0.0, 3.0), [(0, 3.0)]),  # half a second is no part
        ("aaaaaaaaaaabb", (0.0, 3.0), [(0, 3.0)]),  # the cut at 2.75 moves to 2.5, where half a second is left
        ("aaabacccccccc", (0.0, 3.0), [(0, 0.75), (0.75, 3.0)]),  # 1.0 and 1.25 come too soon behind 0.75
    ],
)
def test_rows_are_split_where_parts_are_long_enough(spark, looks, span, parts):
    got = C.split_on_cuts(rows(spark, (*span, False)), frames(spark, looks), "film").collect()
    assert sorted((r["start"], r["stop"]) for r in got) == parts
    assert sorted(r["part"] for r in got) == ([0] if len(parts) == 1 else list(range(1, len(parts) + 1)))


def test_rows_that_stay_whole(spark):
    f = frames(spark, "aaaabbbbccccc")
    got = C.split_on_cuts(rows(spark, (0.0, 3.0, True), (0.7, 1.4, False), (50.0, 53.0, False)), f, "film")
    assert sorted((r["id"], r["part"], r["parts"]) for r in got.collect()) == [(0, 0, 1), (1, 0, 1), (2, 0, 1)]
    assert C.split_on_cuts(rows(spark, (0.0, 3.0, True)).limit(0), f, "film").count() == 0


def test_both_rules_act_on_the_tables(spark):
    from chronoweave.queries.cuts import THRESHOLD, cut_rows, film_frames, scenes

    sf = "/root/testdata/sf0.01"
    all_cuts = C.scenes(film_frames(spark, sf), "film", THRESHOLD, least=0.0).count()
    assert 10 < scenes(spark, sf).count() < all_cuts
    assert {r["parts"] for r in cut_rows(spark, sf).collect()} >= {1, 2, 3}
