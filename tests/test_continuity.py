"""Hand-worked cases of the chunk repairs; the queries are held against recursive SQL elsewhere."""

from collections import namedtuple

import pytest

from chronoweave.operators.continuity import bridged, carried_on, mended_chunks, off_islands

Chunk = namedtuple("Chunk", "id t0 t1 s0 s1 confidence breaks stability low_info identity corrected follows places state", defaults=(False, 0.0, 1.0, 0.0, False, 0.0, (), "kept"))


def at(*places):
    return [{"place": p, "score": s} for p, s in sorted(places)]


def told(rows):
    return [(r.state, None if r.s0 is None else round(r.s0, 3)) for r in rows]


def test_a_repaired_row_changes_the_next_one():
    rows = [
        Chunk(1, 0, 1, 100.0, 101.0, 0.9),
        Chunk(2, 1, 2, 300.0, 301.0, 0.7, places=at((101.0, 0.8))),
        Chunk(3, 2, 3, 400.0, 401.0, 0.7, places=at((102.0, 0.8), (301.0, 0.9))),
    ]
    assert told(carried_on(rows, 1_000)) == [("kept", 100), ("carried", 101), ("carried", 102)]
    apart = [rows[0], rows[1]._replace(places=()), rows[2]]  # the second stays at 300, so the third is expected at 301
    assert told(carried_on(apart, 1_000)) == [("kept", 100), ("kept", 300), ("carried", 301)]


def test_rows_without_a_match_are_filled():
    rows = [Chunk(1, 0, 1, 100.0, 101.0, 0.9), Chunk(2, 1, 2, None, None, 0.0, places=at((103.0, 0.75)), state="none"), Chunk(3, 2, 3, None, None, 0.0, places=at((104.0, 0.69)), state="none")]
    # a place two seconds on costs 0.012 and is taken as nothing nearer scores; 0.69 does not fill
    assert told(carried_on(rows, 1_000)) == [("kept", 100), ("filled", 103), ("none", None)]


@pytest.mark.parametrize(
    "change",
    [
        {"breaks": True},
        {"t0": 1.5},
        {"confidence": 0.95},  # too sure to be moved for 0.8
        {"s0": 101.3, "s1": 102.3},  # hardly off
    ],
)
def test_rows_that_stay(change):
    rows = [Chunk(1, 0, 1, 100.0, 101.0, 0.9), Chunk(2, 1, 2, 300.0, 301.0, 0.7, places=at((101.0, 0.8)))._replace(**change)]
    assert told(carried_on(rows, 1_000))[1][0] == "kept"
    assert told(carried_on([rows[0]], 0)) == [("kept", 100)]


def test_no_carrying_on_behind_a_weak_short_row_or_the_end():
    rows = [Chunk(1, 0, 0.5, 100.0, 100.5, 0.7), Chunk(2, 0.5, 1.5, 300.0, 301.0, 0.7, places=at((100.5, 0.8)))]
    assert told(carried_on(rows, 1_000))[1] == ("kept", 300)
    rows[0] = rows[0]._replace(confidence=0.9)
    assert told(carried_on(rows, 1_000))[1] == ("carried", 100.5)
    assert told(carried_on(rows, 101.4))[1] == ("kept", 300)
    assert told(carried_on(rows, 0.0))[1] == ("kept", 300)  # an unknown end allows nothing


def test_an_island_is_judged_by_the_mended_row_before_it():
    rows = [
        Chunk(1, 0, 1, 100.0, 101.0, 0.9),
        Chunk(2, 1, 2, 500.0, 501.0, 0.7, places=at((101.25, 0.8))),
        Chunk(3, 2, 3, 102.0, 103.0, 0.7),
    ]
    mended = list(off_islands(rows, 1_000))
    assert told(mended) == [("kept", 100), ("island", 101), ("kept", 102)] and mended[1].confidence == 0.7
    assert told(off_islands([r._replace(breaks=r.id == 3) for r in rows], 1_000))[1] == ("kept", 500)
    assert told(off_islands([rows[0], rows[1]._replace(confidence=0.94), rows[2]], 1_000))[1] == ("kept", 500)
    # the fourth row is between the mended third and the fifth
    more = [rows[0], rows[1], rows[2]._replace(s0=700.0, s1=701.0, places=at((102.0, 0.8))), Chunk(4, 3, 4, 103.0, 104.0, 0.9)]
    assert told(off_islands(more, 1_000))[1] == ("kept", 500)  # its own follower jumps away


def test_bridges():
    rows = [Chunk(1, 0, 1, 100.0, 101.0, 0.9), Chunk(2, 1, 2, 500.0, 501.0, 0.6, places=at((103.0, 0.7))), Chunk(3, 2, 3, 104.0, 105.0, 0.9)]
    mended = list(bridged(rows, 1_000))
    # places are tried in order and reach 0.7 s: 102.5 is the first that sees the score at 103
    assert told(mended)[1] == ("bridge", 102.5) and mended[1].confidence == 0.7
    assert told(bridged([rows[0], rows[1]._replace(confidence=0.73), rows[2]], 1_000))[1] == ("kept", 500)
    assert told(bridged([rows[0], rows[1]._replace(s0=106.0, s1=107.0), rows[2]], 1_000))[1] == ("kept", 106)
    assert told(bridged(rows[:2], 1_000)) == [("kept", 100), ("kept", 500)]


def test_frames(spark):
    kind = "project string, id int, idx bigint, t0 double, t1 double, s0 double, s1 double, confidence double, breaks boolean, stability double, low_info double, identity double, corrected boolean, follows double"
    rows = [("p", i, i, float(i), i + 1.0, s, None if s is None else s + 1, 0.7, False, None, None, None, False, None) for i, s in enumerate((100.0, 300.0, None, 103.0))]
    chunks = spark.createDataFrame([*rows, ("q", 9, 0, 0.0, 1.0, 5.0, None, 0.7, False, 0.1, 0.1, 0.1, False, 0.1)], kind)
    scores = spark.createDataFrame([(1, 101.0, 0.9), (2, 102.0, 0.9), (2, None, 1.0), (77, 1.0, 1.0)], "id int, place double, score double")
    got = mended_chunks(chunks, scores, ["project"], 1_000.0)
    assert sorted((r["id"], r["s0"], r["s1"], r["state"]) for r in got.collect()) == [(0, 100, 101, "kept"), (1, 101, 102, "carried"), (2, 102, 103, "filled"), (3, 103, 104, "kept"), (9, 5, 6, "kept")]
    assert mended_chunks(chunks.limit(0), scores, ["project"]).count() == 0
    with pytest.raises(ValueError, match="no such repair"):
        mended_chunks(chunks, scores, ["project"], repairs=("none",))


def test_every_repair_acts_on_the_tables(spark):
    from chronoweave.queries.continuity import mended_chunks as query

    total = query(spark, "/root/testdata/sf0.01").groupBy().sum().first().asDict()
    assert all(total[f"sum({s})"] > 0 for s in ("kept", "carried", "filled", "island", "bridge"))


def test_places_as_arrays_give_the_same_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, i, i, float(i), i + 1.0, 100.0 + i if i % 3 else 300.0, None, 0.7, False, 0.0, 1.0, 0.0, False, 0.0) for i in range(1, 40)]
    chunks = spark.createDataFrame(rows, "project int, id int, idx int, t0 double, t1 double, s0 double, s1 double, confidence double, breaks boolean, stability double, low_info double, identity double, corrected boolean, follows double")
    scores = spark.createDataFrame([(i, 100.0 + i + k / 2, (50 + i % 7 * 7 - abs(k)) / 100 if k < 5 else None) for i in range(1, 36) for k in range(5, -6, -1)], "id int, place double, score double")
    arrays = scores.groupBy("id").agg(F.collect_list(F.struct("place", "score")).alias("places"))
    once = mended_chunks(chunks, scores, ["project"], 1_000.0).collect()
    assert sorted(once) == sorted(mended_chunks(chunks, arrays, ["project"], 1_000.0).collect())
    assert {"kept", "carried"} <= {r["state"] for r in once}
