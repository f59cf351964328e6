import pytest
from pyspark.sql import functions as F

from chronoweave.operators import matches as M

KIND = "id int, movie_start double, match_confidence double, review_required boolean, alignment_status string, match_type string, match_candidates array<struct<id:string>>, skip_matching boolean, is_manual_match boolean, note string"


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, 10.0, 0.9, False, "auto_accepted", "exact", [("c",)], False, True, "n") for i in range(3)] + [(3, None, None, None, None, None, None, None, None, None)], KIND)


def one(df, i):
    return df.where(F.col("id") == i).first().asDict()


def test_cleared(rows):
    out = M.cleared(rows, F.col("movie_start") + F.col("id") >= 11, "unmatched", "lost")
    assert out.columns == rows.columns and one(out, 0) == one(rows, 0) and one(out, 3) == one(rows, 3)  # null: not cleared
    r = one(out, 1)
    assert (r["movie_start"], r["match_confidence"], r["review_required"], r["alignment_status"], r["match_type"], r["note"]) == (None, 0, True, "unmatched", "fallback", "n")
    assert one(M.cleared(rows, F.lit(True), "auto_accepted", ""), 1)["match_type"] == "inferred"


def test_skipped_and_reset(rows):
    r = one(M.skipped(rows, F.col("movie_start") == 10), 2)
    assert (r["match_candidates"], r["skip_matching"], r["is_manual_match"], r["alignment_status"], r["review_required"]) == (None, True, False, "skipped", False)
    r = one(M.reset(rows, F.col("id") == 2), 2)
    assert (r["alignment_status"], r["match_type"], r["match_candidates"], r["movie_start"], r["skip_matching"]) == ("pending", "exact", None, None, False)


def share(spark, chunk, *members, end=0.0):
    m = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(members)], "k string, id int, t0 double, t1 double")
    c = spark.createDataFrame([("c", *chunk)], "k string, c0 double, c1 double, start double, length double, confidence double, inferred boolean, speed_changed boolean")
    return sorted((r["id"], round(r["s0"], 3), round(r["s1"], 3), r["status"], r["match_type"]) for r in M.shared_out(m, c, "k", end).collect())


def test_members_share_the_chunk(spark):
    assert share(spark, (0.0, 4.0, 100.0, None, 0.8, False, False), (0, 1), (1, 4), (4, 4)) == [(0, 100, 101, "auto_accepted", "exact"), (1, 101, 104, "auto_accepted", "exact")]
    assert share(spark, (0.0, 4.0, 100.0, 8.0, 0.7, False, True), (0, 1), (1, 4)) == [(0, 100, 102, "needs_review", "inferred"), (1, 102, 108, "needs_review", "inferred")]
    assert share(spark, (0.0, 4.0, 100.0, 8.0, 0.8, False, True), (2, 4), end=106.0) == [(0, 102, 106, "auto_accepted", "speed_changed")]
    assert share(spark, (0.0, 4.0, None, None, 0.8, False, False), (0, 1)) == []


def test_put_first(spark):
    df = spark.createDataFrame([(("b", 1), [("a", 0), ("b", 0), *((f"x{i}", 0) for i in range(9))]), (("b", 1), None), (("b", 1), [])], "c struct<id:string,v:int>, o array<struct<id:string,v:int>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(M.put_first(F.col("c"), F.col("o"))).collect()]
    assert got == [[("b", 1), ("a", 0), *((f"x{i}", 0) for i in range(6))], [("b", 1)], [("b", 1)]]


def test_frame_score(spark):
    kind = "ah array<bigint>, ap bigint, ag array<double>, bh array<bigint>, bp bigint, bg array<double>"
    rows = [([0, 0, 0, 0], 0, [1.0, 2.0], [0, 0, 0, 0], 0, [2.0, 4.0]), ([-1, -1, 0, 0], -1, [1.0, 2.0], [0, 0, 0, 0], 0, [2.0, 1.0]), ([0, 0, 0, 0], 0, [3.0, 3.0], [0, 0, 0, 0], 0, [2.0, 1.0])]
    got = [round(r[0], 6) for r in spark.createDataFrame(rows, kind).select(M.frame_score(*map(F.col, ("ah", "ap", "ag", "bh", "bp", "bg")))).collect()]
    assert got == [1.0, 0.175, 1.0]
