"""Hand-worked cases of the ranges' rules; the queries are held against recursive SQL elsewhere."""

from collections import namedtuple

import pytest

from chronoweave.operators import ranges as R
from chronoweave.operators.scans import joined, near_any, ordered_scan, with_neighbours

Range = namedtuple("Range", "t0 t1 s0 s1 inferred score cut_in cut_out", defaults=(False, 0.9, False, False))


def line(*parts):
    """(length, source start) one behind the other on the target."""
    out, t = [], 0.0
    for length, s0, *more in parts:
        out.append(Range(round(t, 3), round(t + length, 3), s0, s0 + length, **(more[0] if more else {})))
        t += length
    return out


def smooth(rows, end=0.0):
    return [tuple(round(x, 3) for x in r[1:5]) + (r[5],) for r in R._smooth(rows, end)]


def test_what_goes_on_joins_and_a_cut_keeps_apart():
    assert smooth(line((2, 10), (2, 12.5), (2, 20))) == [(0, 4, 10, 14, False), (4, 6, 20, 22, False)]
    assert smooth(line((2, 10), (2, 12.5, {"cut_in": True}))) == [(0, 2, 10, 12, False), (2, 4, 12.5, 14.5, False)]


def test_short_and_tiny_ranges_join_over_larger_jumps():
    assert smooth(line((2, 10), (0.5, 15))) == [(0, 2.5, 10, 12.5, False)]
    assert smooth(line((2, 10), (0.5, 17))) == [(0, 2, 10, 12, False), (2, 2.5, 17, 17.5, False)]
    assert smooth(line((2, 10), (0.3, 17.5))) == [(0, 2.3, 10, 12.3, False)]  # only the second rule


def test_a_flicker_goes_and_what_follows_joins_then():
    """The third rule takes the short jump over, and the fourth joins what now goes on: two rules in a row."""
    assert smooth(line((2, 10), (0.8, 90), (2, 12.6))) == [(0, 4.8, 10, 14.8, True)]
    assert smooth(line((2, 10), (0.8, 90, {"cut_out": True}), (2, 12.6, {"cut_in": True}))) == [(0, 2, 10, 12, False), (2, 2.8, 90, 90.8, False), (2.8, 4.8, 12.6, 14.6, False)]
    assert len(smooth(line((2, 10), (1.0, 90), (2, 12.6)))) == 3  # too long for a flicker


def test_repeats_go_on_instead():
    assert smooth(line((4, 10), (3, 12))) == [(0, 4, 10, 14, False), (4, 7, 14, 17, True)]
    assert smooth(line((4, 10), (3, 13.1)))[1][2] == 13.1  # less than a second again: left alone
    assert smooth(line((4, 10), (3, 12, {"cut_in": True})))[1] == (4, 7, 12, 15, False)
    # the next range is judged by the one that was moved
    assert [r[2] for r in smooth(line((4, 10), (3, 12), (3, 14)))] == [10, 14, 17]


def test_gaps_and_the_end_of_the_source():
    apart = [Range(0, 2, 10, 12), Range(2.2, 4, 12, 13.8)]
    assert len(smooth(apart)) == 2 and smooth([]) == []
    assert smooth(line((2, 10), (2, 12)), end=13.0) == [(0, 4, 9, 13, False)]


Matched = namedtuple("Matched", "id t0 t1 m0 m1 inferred score safe speed", defaults=(False, 0.9, True, False))


def lock(*rows, end=0.0):
    return [tuple(round(x, 3) for x in r[1:5]) + r[5:] for r in R._lock(rows, end)]


def test_locked_ranges():
    assert lock(Matched(1, 0, 2, 10, 12), Matched(2, 2, 3, 12.1, 13.1)) == [(0, 3, 10, 13.1, False, 0.9)]
    assert lock(Matched(1, 0, 2, None, None), Matched(2, 2, 3, 5, 6), Matched(3, 3, 4, None, None, safe=False)) == [(2, 3, 5, 6, False, 0.9), (3, 4, 6, 7, True, 0.0)]
    # a gap of a tenth of a second is bridged where the source's end is known, and the sure row behind it locks on
    assert lock(Matched(1, 0, 2, 10, 12), Matched(2, 2.1, 3, 12.1, 13), end=100.0) == [(0, 2, 10, 12, False, 0.9), (2, 3, 12, 13, True, 0.0)]
    assert len(lock(Matched(1, 0, 2, 10, 12), Matched(2, 2.1, 3, 12.1, 13))) == 2
    assert lock(Matched(1, 0, 2, 10, 15, speed=True))[0][3] == 15 and lock(Matched(1, 0, 2, 10, 15))[0][3] == 12
    assert lock(Matched(1, 0, 4, 10, 14), end=12.0) == [(0, 4, 8, 12, False, 0.9)]


Anchor = namedtuple("Anchor", "id t0 t1 m0 anchor cut next_m0 next_t0", defaults=(None, None))


def test_continuous_ranges():
    rows = [Anchor(1, 0, 2, None, False, False, 20.0, 4.0), Anchor(2, 2, 4, 99.0, False, False, 20.0, 4.0), Anchor(3, 4, 5, 20.0, True, False), Anchor(4, 5, 6, 80.0, True, False), Anchor(5, 6, 7, 80.0, True, True)]
    assert list(R._continue(rows, 0.0)) == [(1, 16, 18, True), (2, 18, 20, True), (3, 20, 21, False), (4, 21, 22, True), (5, 80, 81, False)]
    assert list(R._continue(rows[2:3], 20.5)) == [(3, 19.5, 20.5, False)]


def test_scans_stream_in_order(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", "b", None) for i in range(9_000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    total = ordered_scan(df, ["k"], ["i"], lambda it: ((sum(r.v for r in it), 1),), "total bigint, one int").collect()
    assert sorted((r["k"] or "", r["total"]) for r in total) == [("", 18_000), ("a", 18_000), ("b", 18_000)]
    first = ordered_scan(df, ["k"], ["i"], lambda it: [(next(it).i,)], "i int")  # a scan that stops early
    assert sorted((r["k"] or "", r["i"]) for r in first.collect()) == [("", 0), ("a", 0), ("b", 0)]
    assert ordered_scan(df.limit(0), ["k"], ["i"], lambda it: ((1,) for _ in it), "i int").count() == 0


@pytest.mark.parametrize("n", range(5))
def test_scan_helpers(n):
    assert list(joined(range(n), lambda a, b: False, None)) == list(range(n))
    assert list(joined([1] * n, lambda a, b: True, lambda a, b: a + b)) == [n][: n > 0]
    # each row is mended by the mended one before it
    assert list(with_neighbours(range(n), lambda a, r, b: a + r + b)) == [[], [0], [0, 1], [0, 3, 2], [0, 3, 8, 3]][n]


def test_marks_near_a_place(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("b", 3, 1.0), ("a", 4, None)], "k string, id int, at double")
    marks = spark.createDataFrame([("a", 1.08), ("a", 1.08), ("a", 0.93), ("a", 5.2), ("c", 1.0)], "k string, m double")
    got = near_any(df, ["k"], ["id"], "at", marks, "m", 0.08, "near")
    assert sorted((r["id"], r["near"]) for r in got.collect()) == [(1, True), (2, False), (3, False), (4, False)]


Doubtful = namedtuple("Doubtful", "id t0 t1 s0 s1 inferred score cut_in seeds places", defaults=(False, 0.5, False, (), ()))


def recheck(rows, end=0.0, checks=72):
    return [(r[0], round(r[3], 3), r[7]) for r in R._recheck(rows, end, checks)]


def at(*places):
    return [{"place": p, "score": s} for p, s in sorted(places)]


def test_checks_run_out():
    rows = [Doubtful(i, i * 2.0, i * 2.0 + 2, 500.0, 502.0, seeds=[{"start": 100.0 + i, "score": 0.9}], places=at((100.0 + i, 0.9), (500.0, 0.5)), cut_in=True) for i in range(4)]
    assert recheck(rows, checks=2) == [(0, 100, "moved"), (1, 101, "moved"), (2, 500, "kept"), (3, 500, "kept")]
    assert [r[2] for r in recheck(rows)] == ["moved"] * 4


def test_a_range_is_held_against_going_on_from_the_one_before():
    rows = [Doubtful(0, 1.0, 3.0, 100.0, 102.0, places=at((100.0, 0.9)), score=0.9), Doubtful(1, 3.0, 5.0, 300.0, 302.0, places=at((102.0, 0.73), (300.0, 0.71)), score=0.9)]
    assert recheck(rows) == [(0, 100, "kept"), (1, 102, "moved")]  # it jumps, so a gain of 0.018 will do
    assert recheck([rows[0], rows[1]._replace(cut_in=True)]) == [(0, 100, "kept"), (1, 300, "kept")]
    assert recheck([rows[0], rows[1]._replace(places=at((102.0, 0.72), (300.0, 0.71)))])[1] == (1, 300, "checked")
    # what was moved carries on: the third is expected behind the second's new place
    third = Doubtful(2, 5.0, 7.0, 900.0, 902.0, places=at((104.0, 0.9)), score=0.9)
    assert recheck([*rows, third])[2] == (2, 104, "moved")


def test_seeds(spark):
    ranges = spark.createDataFrame([("p", 1, 10.0, 12.0), ("p", 2, 90.0, 91.0), ("q", 3, 0.0, 1.0)], "project string, id int, t0 double, t1 double")
    rows = [("p", 1, 10.0, 12.0, 100.0, 0.8), ("p", 2, 8.0, 10.1, 98.01, 0.9), ("p", 3, 12.4, 14.0, None, 0.9), ("p", 4, 13.9, 14.1, 300.0, 0.5), ("p", 5, 60.0, 60.5, 1.0, 1.0), ("p", 6, 0.0, 200.0, 700.0, 0.1)]
    got = R.restore_seeds(ranges, spark.createDataFrame(rows, "project string, row int, r0 double, r1 double, m0 double, base double"), ["project"], 800.0)
    found = {r["id"]: [(round(s["start"], 2), round(s["score"], 4)) for s in r["seeds"]] for r in got.collect()}
    # rows 1 and 2 propose the same tenth of a second: once, with the better score; row 5 is far, row 3 unmatched
    assert found == {1: [(100.0, 0.876), (710.0, 0.442)], 2: [(790.0, 0.442)]}


def mended(rule, rows, end=0.0):
    return [(round(r.t0, 3), round(r.t1, 3), round(r.s0, 3), round(r.s1, 3)) for r in rule(rows, end)]


Placed = namedtuple("Placed", "t0 t1 s0 s1 inferred score cut_in cut_out places", defaults=(False, 0.8, False, False, ()))


def test_excursions_come_back():
    rows = [Placed(0, 2, 10, 12), Placed(2, 3, 90, 91, places=at((12.0, 0.4), (14.0, 0.6))), Placed(3, 5, 15, 17)]
    assert mended(R._without_excursions, rows)[1] == (2, 3, 14, 15)  # before the second scores better than behind the first
    assert mended(R._without_excursions, [rows[0], rows[1]._replace(places=()), rows[2]])[1] == (2, 3, 12, 13)
    for stays in ({"s0": 25.0, "s1": 26.0}, {"t1": 4.9}):
        changed = [rows[0], rows[1]._replace(**stays), rows[2]]
        assert mended(R._without_excursions, changed)[1][2:] == (changed[1].s0, changed[1].s1)
    assert mended(R._without_excursions, [rows[0], rows[1], rows[2]._replace(s0=95.0, s1=97.0)])[1] == (2, 3, 90, 91)  # it doesn't come back


def test_jumps_without_a_cut_go_on_and_join():
    rows = [Placed(0, 2, 10, 12), Placed(2, 4, 15, 17, places=at((12.0, 0.6), (15.0, 0.75)))]
    assert mended(R._without_jumps, rows) == [(0, 4, 10, 14)]
    assert mended(R._without_jumps, [rows[0], rows[1]._replace(cut_in=True)]) == [(0, 2, 10, 12), (2, 4, 15, 17)]
    assert len(mended(R._without_jumps, [rows[0], rows[1]._replace(places=at((12.0, 0.5), (15.0, 0.75)))])) == 2  # clearly worse
    assert len(mended(R._without_jumps, [rows[0], rows[1]._replace(s0=31.0, s1=33.0)])) == 2  # too far to be judged
    assert len(mended(R._without_jumps, rows, end=13.0)) == 2


def test_steps_back_go_on():
    rows = [Placed(0, 2, 50, 52), Placed(2, 4, 20, 22, places=at((52.0, 0.65), (20.0, 0.75)))]
    assert mended(R._without_steps_back, rows) == [(0, 4, 50, 54)]
    assert len(mended(R._without_steps_back, [rows[0], rows[1]._replace(s0=60.0, s1=62.0)])) == 2  # forward
    short = rows[1]._replace(t1=2.5, s1=20.5, places=at((52.0, 0.58), (20.0, 0.75)))
    assert len(mended(R._without_steps_back, [rows[0], short])) == 1 and len(mended(R._without_steps_back, [rows[0], rows[1]._replace(places=short.places)])) == 2
