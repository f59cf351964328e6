"""Ranges of a source along a target's timeline: made of matched rows, filled, smoothed and checked again.

A range is (t0, t1) on the target and (s0, s1) on the source, whether it was inferred, and a score. Each rule is a scan
over a key's ranges in order; scans read from one another, so that a rule sees what the one before it left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.continuity import _look
from chronoweave.operators.scans import joined, near_any, ordered_scan, with_neighbours

#: Seconds up to which ranges touch on the target, and within which a cut protects a border: fixed values.
TOUCH, CUT_REACH = 0.05, 0.08
#: Smoothing: fixed values. Source jumps that go on, durations and jumps of short and of tiny ranges.
GOES_ON, SHORT, SHORT_JUMP, TINY, TINY_JUMP = 0.80, 0.55, 4.0, 0.35, 6.0
#: Flicker: longest duration, source gap around it, least jump. Repeats: step back, seconds and share shown again.
FLICKER, FLICKER_AROUND, FLICKER_JUMP = 0.90, 1.25, 1.50
STEP_BACK, AGAIN_SECONDS, AGAIN_SHARE = 0.35, 1.00, 0.45
#: Bridged gaps between matched rows, source gap of rows that lock together, least scores of those: fixed values.
BRIDGE, LOCK_GAP, LOCK_SCORE = (0.05, 0.18), 0.18, 0.82
#: Jumps from the cursor that an anchor may make without a cut: seconds and multiples of its duration.
ANCHOR_JUMP = (4.0, 2.0)

#: Checks again: how many a key's ranges get, scores below which one is due, (seconds, multiples) of a jump that counts, and of a look-up's reach.
CHECKS, LOW, LOW_SHOWN, SHORT_ONE, JUMPS, LOOK = 72, 0.70, 0.78, (1.25, 0.82, 0.86), (1.20, 1.35, 0.88), 0.30
#: Gain and least score that a replacement needs: of a poor range, of one that jumps less then, of others.
POOR, GAINS, LEAST = 0.62, (0.010, 0.018, 0.035), (0.66, 0.72)
#: Excursions: longest, least jump there and back, how near it comes back. Jumps at no cut: least length, jumps that are judged, margin.
AWAY, AWAY_JUMP, AWAY_BACK, JUDGED_LENGTH, NO_CUT_JUMPS, NO_CUT_MARGIN = 2.25, 20.0, 8.0, 0.18, (0.35, 18.0), 0.18
#: Steps back that are judged, their margin, and what short ranges get besides.
STEPS_BACK, BACK_MARGIN, SHORT_MARGIN = (0.35, 120.0), 0.13, 0.05
#: Seeds: reach of overlap, of distance (seconds, multiples), shares of base score and overlap, how many rows and seeds.
OVERLAP_REACH, NEAR, SEED_SHARES, RELATED, SEEDS, LAST_SEED = 0.45, (1.6, 1.2), (0.62, 0.38), 4, 4, 0.45

RANGE = "t0 double, t1 double, s0 double, s1 double, inferred boolean, score double"


def _merge(end: float, a, b):
    """One range for two: the source runs on from the first, moved back where it would pass the source's end."""
    length = max(0.0, b.t1 - a.t0)
    s1 = a.s0 + length
    s0, s1 = (max(0.0, end - length), end) if 0 < end < s1 else (a.s0, s1)
    return a._replace(t1=b.t1, s0=s0, s1=s1, inferred=a.inferred or b.inferred, score=min(a.score, b.score), cut_out=b.cut_out)


def _meet(a, b) -> bool:
    return abs(b.t0 - a.t1) <= TOUCH and not b.cut_in


def _length(r) -> float:
    return max(0.0, r.t1 - r.t0)


def _goes_on(a, b) -> bool:
    return _meet(a, b) and abs(b.s0 - a.s1) <= GOES_ON


def _without_flicker(rows: Iterable, end: float) -> Iterator:
    """A short range whose neighbours follow each other in the source becomes part of the one before."""
    kept, row = None, None

    def is_flicker(after) -> bool:
        alone = _length(row) <= FLICKER and _meet(kept, row) and abs(after.t0 - row.t1) <= TOUCH and not row.cut_out
        return alone and abs(after.s0 - kept.s1) <= FLICKER_AROUND and max(abs(row.s0 - kept.s1), abs(after.s0 - row.s1)) >= FLICKER_JUMP

    for after in rows:
        if row is not None and kept is not None and is_flicker(after):
            kept = _merge(end, kept, row)._replace(inferred=True)
        elif row is not None:
            if kept is not None:
                yield kept
            kept = row
        row = after
    yield from (r for r in (kept, row) if r is not None)


def _without_repeats(rows: Iterable) -> Iterator:
    """A range that shows again much of what the one before showed goes on from there instead; not behind a cut."""
    before = None
    for row in rows:
        if before is not None and _meet(before, row):
            again = before.s1 - row.s0
            if again > STEP_BACK and again >= AGAIN_SECONDS and again / max(_length(row), 0.1) >= AGAIN_SHARE:
                row = row._replace(s0=before.s1, s1=before.s1 + _length(row), inferred=True, score=min(before.score, row.score))
        yield row
        before = row


def _smooth(rows: Iterable, end: float) -> Iterator[tuple]:
    merge = partial(_merge, end)
    rows = joined(rows, lambda a, b: _goes_on(a, b) or (_meet(a, b) and _length(b) < SHORT and abs(b.s0 - a.s1) <= SHORT_JUMP), merge)
    rows = joined(rows, lambda a, b: _meet(a, b) and _length(b) < TINY and abs(b.s0 - a.s1) <= TINY_JUMP, merge)
    rows = joined(_without_flicker(rows, end), _goes_on, merge)
    for place, r in enumerate(_without_repeats(rows)):
        yield place, r.t0, r.t1, r.s0, r.s1, r.inferred, r.score


def smoothed_ranges(ranges: DataFrame, cuts: DataFrame, keys: list[str], source_end: float = 0.0, row_id: str = "id") -> DataFrame:
    """(keys, place, range) after five rules, each over what the one before left:

    ranges that go on in the source join, short ones after a small jump too; tiny ones join after a larger jump; a
    flicker between two ranges that follow each other is taken over by the first; what goes on now joins; a range that
    repeats what was just shown goes on instead. Nothing joins over a gap or a cut (``cuts``: keys, at). Where the
    source's end is known (above 0), no joined range passes it. No ranges, no rows; a key without cuts has none.
    """
    marked = near_any(ranges, keys, [row_id], "t0", cuts, "at", CUT_REACH, "cut_in")
    marked = near_any(marked, keys, [row_id], "t1", cuts, "at", CUT_REACH, "cut_out")
    return ordered_scan(marked.select(*keys, row_id, "t0", "t1", "s0", "s1", "inferred", "score", "cut_in", "cut_out"), keys, ["t0", row_id], lambda rows: _smooth(rows, source_end), f"place bigint, {RANGE}")


def _lock(rows: Iterable, end: float) -> Iterator[tuple]:
    held = None  # the last range, and whether what it ends in is safe and may change speed
    t_last = s_last = safe_last = speed_last = None
    place = 0
    for r in rows:
        length = r.t1 - r.t0
        matched = r.m0 is not None and r.m1 is not None
        if not matched and s_last is None:
            continue
        s0, s1, inferred, score = (r.m0, r.m1, r.inferred, r.score) if matched else (s_last, s_last + length, True, 0.0)
        if not r.speed or s1 <= s0:
            s1 = s0 + length
        if 0 < end < s1:
            s0, s1 = max(0.0, s0 - (s1 - end)), end
        if held and BRIDGE[0] < r.t0 - t_last <= BRIDGE[1] and s_last + (r.t0 - t_last) <= end:
            yield place, *held
            place, held = place + 1, (t_last, r.t0, s_last, s_last + (r.t0 - t_last), True, 0.0)
        safe = matched and r.safe
        if held and abs(r.t0 - held[1]) <= TOUCH and abs(s0 - held[3]) <= LOCK_GAP and r.speed == speed_last and safe_last and safe:
            held = (held[0], r.t1, held[2], s1, held[4] or inferred, min(held[5], score))
        else:
            if held:
                yield place, *held
                place += 1
            held = (r.t0, r.t1, s0, s1, inferred, score)
        t_last, s_last, safe_last, speed_last = r.t1, s1, safe, r.speed
    if held:
        yield place, *held


def locked_ranges(rows: DataFrame, keys: list[str], target_end: float = 0.0, source_end: float = 0.0, row_id: str = "id") -> DataFrame:
    """(keys, place, range) of matched rows (t0, t1, m0, m1, review, exact, inferred_match, visual, confidence, speed), in the target's order.

    A row without a match goes on in the source from the row before; one before any match is left out. Rows that may not
    change speed take as much source as target. Gaps of ``BRIDGE`` seconds are bridged where the source's end is known
    and not passed. Rows whose matches are exact, unreviewed and of high scores lock together where they touch. Rows
    that begin behind ``target_end`` (0: unknown), or that are empty, are left out.
    """
    start, end = F.greatest(F.lit(0.0), "t0"), F.greatest(F.lit(0.0), "t0", "t1")
    used = rows.where(F.col("t0") < target_end) if target_end > 0 else rows
    end = F.least(end, F.lit(target_end)) if target_end > 0 else end
    score = F.coalesce(F.when(F.col("visual") != 0, F.col("visual")), F.col("confidence"), F.lit(0.0))
    inferred = F.col("review") | F.col("inferred_match")
    safe = ~F.col("review") & ~inferred & F.col("exact") & (score >= LOCK_SCORE) & (F.coalesce("confidence", F.lit(0.0)) >= LOCK_SCORE)
    read = used.select(*keys, row_id, start.alias("t0"), end.alias("t1"), "m0", "m1", inferred.alias("inferred"), score.alias("score"), safe.alias("safe"), "speed").where("t1 > t0")
    return ordered_scan(read, keys, ["t0", "t1", row_id], lambda it: _lock(it, source_end), f"place bigint, {RANGE}")


def _continue(rows: Iterable, end: float) -> Iterator[tuple]:
    cursor = None
    for r in rows:
        length = r.t1 - r.t0
        jumps = r.anchor and cursor is not None and abs(r.m0 - cursor) > max(ANCHOR_JUMP[0], ANCHOR_JUMP[1] * length) and not r.cut
        if r.anchor and not jumps:
            s0, inferred = r.m0, False
        elif cursor is not None:
            s0, inferred = cursor, True
        elif r.next_m0 is not None:
            s0, inferred = max(0.0, r.next_m0 - max(0.0, r.next_t0 - r.t0)), True
        else:
            s0, inferred = r.m0 or 0.0, True
        s0, s1 = (max(0.0, end - length), end) if 0 < end < s0 + length else (s0, s0 + length)
        yield getattr(r, "id"), s0, s1, inferred  # noqa: B009
        cursor = s1


def continuous_ranges(rows: DataFrame, keys: list[str], source_end: float = 0.0) -> DataFrame:
    """(keys, id, s0, s1, inferred): anchors (rows: id, t0, t1, m0, anchor, cut) keep their place, the others go on from the row before.

    An anchor far from where the source stands goes on too, unless its border is a cut. Rows before the first anchor are
    led back from it by their distance on the target. Empty rows are left out.
    """
    ahead = Window.partitionBy(*keys).orderBy("t0", "id").rowsBetween(0, Window.unboundedFollowing)
    upcoming = F.first(F.when(F.col("anchor"), F.struct("m0", "t0")), True).over(ahead)
    read = rows.withColumn("__next", upcoming).where("t1 > t0").select(*keys, "id", "t0", "t1", "m0", "anchor", "cut", F.col("__next.m0").alias("next_m0"), F.col("__next.t0").alias("next_t0"))
    return ordered_scan(read, keys, ["t0", "id"], lambda it: _continue(it, source_end), f"id {rows.schema['id'].dataType.simpleString()}, s0 double, s1 double, inferred boolean")


def restore_seeds(ranges: DataFrame, rows: DataFrame, keys: list[str], source_end: float = 0.0, row_id: str = "id", bucket: float = 8.0) -> DataFrame:
    """(keys, id, seeds): up to four source starts (start, score) for each range (t0, t1) from the rows (row, r0, r1, m0, base) that overlap it or are near.

    Both meet in buckets of time, a pair in the first one that it shares. The four rows of most overlap, then of least
    distance, count; starts that are equal to a tenth of a second count once, with the better score.
    """
    length = F.col("t1") - F.col("t0")
    middle, reach = (F.col("t0") + F.col("t1")) * 0.5, F.greatest(F.lit(NEAR[0]), length * NEAR[1])
    span = lambda lo, hi: F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))
    a = ranges.select(*keys, row_id, "t0", "t1", middle.alias("middle"), reach.alias("reach"))
    a = a.withColumn("a_first", F.floor(F.least(F.col("t0"), F.col("middle") - F.col("reach")) / bucket))
    a = a.withColumn("bucket", F.explode(span(F.least(F.col("t0"), F.col("middle") - F.col("reach")), F.greatest(F.col("t1"), F.col("middle") + F.col("reach")))))
    b = rows.where("m0 is not null").select(*keys, "row", "r0", "r1", "m0", "base", F.floor((F.col("r0") - OVERLAP_REACH) / bucket).alias("b_first"))
    b = b.withColumn("bucket", F.explode(span(F.col("r0") - OVERLAP_REACH, F.col("r1") + OVERLAP_REACH)))
    j = a.join(b, [*keys, "bucket"]).where(F.col("bucket") == F.greatest("a_first", "b_first"))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("t1"), F.col("r1") + OVERLAP_REACH) - F.greatest(F.col("t0"), F.col("r0") - OVERLAP_REACH))
    j = j.withColumn("overlap", overlap).withColumn("distance", F.abs(F.col("middle") - (F.col("r0") + F.col("r1")) * 0.5)).where("overlap > 0 or distance <= reach")
    of_range = Window.partitionBy(*keys, row_id)
    j = j.withColumn("k", F.row_number().over(of_range.orderBy(F.desc("overlap"), "distance", "row"))).where(F.col("k") <= RELATED)
    start = F.col("m0") + (F.col("t0") - F.col("r0"))
    start = F.least(F.greatest(F.lit(0.0), start), F.greatest(F.lit(0.0), source_end - (F.col("t1") - F.col("t0")))) if source_end > 0 else F.greatest(F.lit(0.0), start)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = unit(F.col("base") * SEED_SHARES[0] + unit(F.col("overlap") / F.greatest(F.lit(0.2), F.col("t1") - F.col("t0"))) * SEED_SHARES[1])
    seeds = j.select(*keys, row_id, "k", start.alias("start"), score.alias("score")).withColumn("tenth", F.floor(F.col("start") * 10 + 0.5))
    once = seeds.groupBy(*keys, row_id, "tenth").agg(F.max_by(F.struct("start", "score"), F.struct("score", -F.col("k"))).alias("s"))
    listed = once.groupBy(*keys, row_id).agg(F.sort_array(F.collect_list(F.struct((-F.col("s.score")).alias("o"), F.col("s.start").alias("start")))).alias("l"))
    return listed.select(*keys, row_id, F.transform(F.slice("l", 1, SEEDS), lambda x: F.struct(x["start"].alias("start"), (-x["o"]).alias("score"))).alias("seeds"))


def _recheck(rows: Iterable, end: float, checks: int) -> Iterator[tuple]:
    before = None  # target and source end of the range before
    for r in rows:
        length = max(0.05, r.t1 - r.t0)
        now = _look(r.places, r.s0, LOOK)
        expected = before[1] + max(0.0, r.t0 - before[0]) if before else None
        jump = r.s0 - expected if before else 0.0
        cut = r.t0 <= CUT_REACH or r.cut_in
        jumps = before is not None and not cut and abs(jump) > max(JUMPS[0], length * JUMPS[1]) and now < JUMPS[2]
        short = length <= SHORT_ONE[0] and (now < SHORT_ONE[1] or r.score < SHORT_ONE[2])
        s0, s1, inferred, score, state = r.s0, r.s1, r.inferred, r.score, "kept"
        if (now < LOW or r.score < LOW_SHOWN or short or jumps or r.inferred) and checks > 0:
            checks, state = checks - 1, "checked"
            tried = [(x["start"], x["score"]) for x in r.seeds or []] + ([(before[1], LAST_SEED)] if before and not cut else [])
            found = max(((_look(r.places, at, LOOK), seed, -at) for at, seed in tried), default=None)
            if found:
                new, at = found[0], -found[2]
                until = at + length
                at, until = (max(0.0, end - length), end) if 0 < end < until else (at, until)
                nearer = before is not None and abs(at - expected) + 0.40 < abs(jump)
                gain = GAINS[0] if now < POOR else GAINS[1] if jumps or nearer else GAINS[2]
                if new >= (LEAST[0] if now < POOR else LEAST[1]) and new >= now + gain:
                    s0, s1, score, state = at, until, max(score, new), "moved"
        yield getattr(r, "id"), r.t0, r.t1, s0, s1, inferred, score, state  # noqa: B009
        before = (r.t1, s1)


def rechecked_ranges(ranges: DataFrame, seeds: DataFrame, scores: DataFrame, cuts: DataFrame, keys: list[str], source_end: float = 0.0, checks: int = CHECKS) -> DataFrame:
    """(keys, id, range, state): doubtful ranges held against their seeds and against going on from the range before, as that was left.

    A range is doubtful if it scores low, is short and not sure, jumps without a cut, or was inferred; each key's first
    ``checks`` of them are looked at. The best of the seeds by ``scores`` (id, place, score) replaces the range if it is
    good enough and better; a poor range, or one that then jumps less, asks for less. state: kept, checked or moved.
    """
    places = scores.where("place is not null and score is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("places"))
    marked = near_any(ranges, keys, ["id"], "t0", cuts, "at", CUT_REACH, "cut_in")
    read = marked.join(seeds, [*keys, "id"], "left").join(places, "id", "left").select(*keys, "id", "t0", "t1", "s0", "s1", "inferred", "score", "cut_in", "seeds", "places")
    return ordered_scan(read, keys, ["t0", "id"], lambda rows: _recheck(rows, source_end, checks), f"id {ranges.schema['id'].dataType.simpleString()}, {RANGE}, state string")


def _without_excursions(rows: Iterable, end: float) -> Iterator:
    """A short range far away from two that follow each other is put behind the first or before the second, where it scores better."""

    def mend(before, r, after):
        there, back = r.s0 - before.s1, after.s0 - r.s1
        alone = _length(r) <= AWAY and abs(r.t0 - before.t1) <= TOUCH and abs(after.t0 - r.t1) <= TOUCH
        if not alone or min(abs(there), abs(back)) < AWAY_JUMP or there * back >= 0 or abs(after.s0 - before.s1) > AWAY_BACK:
            return r
        places = [p for p in (before.s1, max(0.0, after.s0 - _length(r))) if end <= 0 or p + _length(r) <= end]
        place, score = max(((p, _look(r.places, p, LOOK)) for p in places), key=lambda t: t[1], default=(before.s1, 0.0))
        return r._replace(s0=place, s1=place + _length(r), inferred=True, score=score)

    return with_neighbours(rows, mend)


def _carried_over(rows: Iterable, end: float, judged, margin) -> Iterator:
    """Ranges that jump where the target doesn't cut go on from the one before if they score nearly as well there; what goes on joins."""
    before = None
    for r in rows:
        if before is not None:
            on, length = before.s1, _length(r)
            if length >= JUDGED_LENGTH and _meet(before, r) and judged(r.s0 - on) and (end <= 0 or on + length <= end):
                now, then = _look(r.places, r.s0, LOOK), _look(r.places, on, LOOK)
                if then >= now - margin(length):
                    r = r._replace(s0=on, s1=on + length, inferred=True, score=max(then, min(r.score, now)))
            if _goes_on(before, r):
                before = _merge(end, before, r)
                continue
            yield before
        before = r
    if before is not None:
        yield before


def _without_jumps(rows: Iterable, end: float) -> Iterator:
    return _carried_over(rows, end, lambda jump: NO_CUT_JUMPS[0] < abs(jump) <= NO_CUT_JUMPS[1], lambda length: NO_CUT_MARGIN)


def _without_steps_back(rows: Iterable, end: float) -> Iterator:
    return _carried_over(rows, end, lambda jump: STEPS_BACK[0] < -jump <= STEPS_BACK[1], lambda length: BACK_MARGIN + SHORT_MARGIN * (length <= FLICKER))


def repaired_ranges(ranges: DataFrame, scores: DataFrame, cuts: DataFrame, keys: list[str], source_end: float = 0.0) -> DataFrame:
    """(keys, place, range) after three repairs, each over what the one before left: excursions that come straight back, jumps where nothing cuts, local steps back.

    ``scores``: id, place, score; what a range scores at another place decides whether it moves there.
    """
    places = scores.where("place is not null and score is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("places"))
    marked = near_any(ranges, keys, ["id"], "t0", cuts, "at", CUT_REACH, "cut_in").join(places, "id", "left")

    def scan(rows: Iterable) -> Iterator[tuple]:
        rows = _without_steps_back(_without_jumps(_without_excursions(rows, source_end), source_end), source_end)
        return ((place, r.t0, r.t1, r.s0, r.s1, r.inferred, r.score) for place, r in enumerate(rows))

    read = marked.withColumn("cut_out", F.lit(False)).select(*keys, "id", "t0", "t1", "s0", "s1", "inferred", "score", "cut_in", "cut_out", "places")
    return ordered_scan(read, keys, ["t0", "id"], scan, f"place bigint, {RANGE}")
