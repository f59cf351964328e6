"""Repairs of matched chunks by their neighbours: what is expected from the row before, held against a table of scores.

A chunk has (t0, t1) on the target, its match (s0, s1, confidence; null for none), and the scores of places in the
source that it was compared with. A repaired row is what the next one is judged by.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.scans import ordered_scan, with_neighbours

#: Fixed values from here on. Target gaps over which source is expected to go on.
CARRY_GAP, ISLAND_GAP, BRIDGE_GAP = (-0.05, 0.35), (-0.05, 0.45), (-0.08, 0.55)
#: Steps from the expected place in the order in which they are tried, and the reach of a look-up there and at the place itself.
CARRY_STEPS, CARRY_REACH = (-6.0, -4.0, -2.0, -1.0, 1.0, 2.0, 4.0, 6.0), (0.95, 0.55)
ISLAND_STEPS, ISLAND_REACH = (-0.75, -0.50, -0.25, 0.25, 0.50, 0.75), (0.58, 0.50)
BRIDGE_STEPS, BRIDGE_REACH = (-1.0, -0.5, 0.5, 1.0, 2.0, 3.5), 0.70
REFINE_STEPS, REFINE_REACH = (-1.25, -1.0, -0.75, -0.50, -0.25, 0.25, 0.50, 0.75, 1.0, 1.25), 0.45
#: What a second off the expected place costs, and at most.
STEP_COST = (0.006, 0.05)
#: (margin, least score) of a replacement: neighbours that look apart, alike, and alike with the source going back.
APART, ALIKE, ALIKE_BACK = (0.08, 0.76), (0.16, 0.70), (0.22, 0.68)
LOOKS_ALIKE, GOES_BACK, FILL = 0.58, -0.12, 0.70
LEAST_LENGTH, LEAST_SHOWN = 0.2, 0.05

CHUNK = ("id", "idx", "t0", "t1", "s0", "s1", "confidence", "breaks")
MENDED = "idx bigint, id {kind}, s0 double, s1 double, confidence double, state string"


class Scored:
    """A chunk's places in order and their scores."""

    __slots__ = ("at", "score")

    def __init__(self, at: list[float], score: list[float]):
        self.at, self.score = at, score

    def __len__(self) -> int:
        return len(self.at)


def _scored(column: pa.Array) -> list[Scored]:
    """Arrays of (place, score) read as numbers, without an object for each place."""
    flat = column.flatten()
    at, score = (flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("place", "score"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [Scored(at[i:j], score[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _look(places: Scored | list[dict] | None, at: float, reach: float) -> float:
    """The best score within ``reach`` of a place; 0 without any."""
    if not isinstance(places, Scored):
        places = Scored([p["place"] for p in places or []], [p["score"] for p in places or []])
    best, every, until = 0.0, places.at, at + reach + 1e-6
    for i in range(bisect_left(every, at - reach - 1e-6), len(every)):
        if every[i] > until:
            break
        if abs(every[i] - at) <= reach and places.score[i] > best:
            best = places.score[i]
    return best


def _length(r) -> float:
    return max(LEAST_LENGTH, r.t1 - r.t0)


def _shown_until(r, length: float) -> float:
    return max(r.s0 + LEAST_SHOWN, r.s1 if r.s1 is not None else r.s0 + length)


def _fits(at: float, length: float, end: float) -> bool:
    return end <= 0 or at + length <= end


def carried_on(rows: Iterable, end: float) -> Iterator:
    """Rows that jump away, or have no match, moved to where the source is expected to go on, if that scores well enough."""
    before = None  # target end, source end, length and confidence of the row before, if its match lies within the source
    for r in rows:
        length = _length(r)
        gap = r.t0 - before[0] if before else None
        if before and not r.breaks and CARRY_GAP[0] <= gap <= CARRY_GAP[1] and end > 0 and max(0.0, before[1] + max(0.0, gap)) + length <= end:
            r = _carried(r, before, max(0.0, gap), length, end)
        before = None
        if r.s0 is not None:
            until = max(max(0.0, r.s0) + LEAST_SHOWN, r.s1)
            if end <= 0 or until <= end:
                before = (r.t1, until, length, r.confidence)
        yield r


def _carried(r, before: tuple, gap: float, length: float, end: float):
    off = abs(r.s0 - before[1] - gap) if r.s0 is not None else None
    if (before[2] < 0.85 and before[3] < 0.78) or (off is not None and off <= max(0.38, length * 0.48)):  # nothing to go by, or no jump
        return r
    at = max(0.0, before[1] + gap)
    best = score = _look(r.places, at, CARRY_REACH[0])
    place = at
    for step in CARRY_STEPS:
        tried = max(0.0, at + step)
        if _fits(tried, length, end):
            here = _look(r.places, tried, CARRY_REACH[1])
            if here - min(STEP_COST[1], abs(step) * STEP_COST[0]) > best:
                best, score, place = here - min(STEP_COST[1], abs(step) * STEP_COST[0]), here, tried
    moved = r._replace(s0=place, s1=place + length, confidence=score)
    if r.s0 is None:
        return moved._replace(state="filled") if score >= FILL else r
    step = r.s0 - before[1]
    back, alike = step < GOES_BACK, r.follows >= LOOKS_ALIKE
    margin, least = (ALIKE_BACK if back else ALIKE) if alike else APART
    firm = r.confidence >= 0.86 and r.stability >= 0.48 and r.low_info <= 0.48 and score < r.confidence + 0.035
    proven = r.corrected and r.identity >= 0.90 and r.confidence >= 0.94 and not back and off <= max(2.0, length * 2.5)
    return moved._replace(state="carried") if not firm and not proven and score >= least and score + margin >= r.confidence else r


def _between(before, r, after, gaps: tuple[float, float]) -> tuple[float, float] | None:
    """Target gaps on both sides, if all three rows are matched and both gaps are small."""
    if before.s0 is None or r.s0 is None or after.s0 is None:
        return None
    sides = r.t0 - before.t1, after.t0 - r.t1
    return sides if all(gaps[0] <= g <= gaps[1] for g in sides) else None


def off_islands(rows: Iterable, end: float) -> Iterator:
    """A row far from where the source stands, between two that agree with each other, moved in between them."""

    def mend(before, r, after):
        sides = _between(before, r, after, ISLAND_GAP)
        if sides is None or r.breaks or after.breaks or not r.places:
            return r
        length, shown = _length(r), max(LEAST_SHOWN, r.s1 - r.s0)
        at = max(0.0, _shown_until(before, length) + max(0.0, sides[0]))
        agrees = abs(after.s0 - (at + shown + max(0.0, sides[1]))) <= max(1.20, length * 0.85)
        if not _fits(at, shown, end) or not agrees or abs(r.s0 - at) <= max(1.10, length * 0.80):
            return r
        tried = [(at, _look(r.places, at, ISLAND_REACH[0]))]
        tried += [(p, _look(r.places, p, ISLAND_REACH[1])) for p in (max(0.0, at + s) for s in ISLAND_STEPS) if _fits(p, shown, end)]
        place, score = max(tried, key=lambda t: t[1])
        if (r.confidence >= 0.86 and score < r.confidence + 0.035) or score < 0.66 or score + 0.13 < r.confidence:
            return r
        return r._replace(s0=place, s1=place + shown, confidence=min(r.confidence, max(0.70, score)), state="island")

    return with_neighbours(rows, mend)


def bridged(rows: Iterable, end: float) -> Iterator:
    """A weak row far from both its neighbours' places, which are near each other, moved to the best place between them."""

    def mend(before, r, after):
        sides = _between(before, r, after, BRIDGE_GAP)
        if sides is None or r.confidence >= 0.72 or not r.places:
            return r
        length = _length(r)
        until = _shown_until(before, length)
        at, latest = max(0.0, until + max(0.0, sides[0])), max(0.0, after.s0 - length - max(0.0, sides[1]))
        jump = min(abs(r.s0 - at), abs(r.s0 - latest))
        if not -0.30 <= after.s0 - until <= max(14.0, length * 9.0) or jump < max(8.0, length * 5.0):
            return r
        bases = (at, latest, max(0.0, (at + max(at, latest)) * 0.5))
        places = sorted({round(max(0.0, b + s), 3) for b in bases for s in (0.0, *BRIDGE_STEPS)})
        tried = [(p, s) for p in places if _fits(p, length, end) and (s := _look(r.places, p, BRIDGE_REACH)) > 0]
        place, score = max(tried, key=lambda t: t[1], default=(0.0, 0.0))
        if score < 0.56 or (score + 0.08 < r.confidence and jump < 60.0):
            return r
        return r._replace(s0=place, s1=place + length, confidence=max(r.confidence, min(0.74, score)), state="bridge")

    return with_neighbours(rows, mend)


def refined(rows: Iterable, end: float) -> Iterator:
    """Each matched row moved within ``REFINE_STEPS`` of its place to where it scores best, if that is worth it."""
    for r in rows:
        if r.s0 is not None and r.places:
            length, at = _length(r), max(0.0, r.s0)
            now = _look(r.places, at, REFINE_REACH)
            tried = [(at, now)] + [(p, _look(r.places, p, REFINE_REACH)) for p in (max(0.0, at + s) for s in REFINE_STEPS) if _fits(p, length, end)]
            place, score = max(tried, key=lambda t: t[1])
            if abs(place - at) >= 0.08 and score >= 0.58 and (score >= now + 0.035 or (now < 0.68 and score >= now + 0.020)):
                r = r._replace(s0=place, s1=place + length, confidence=max(r.confidence, score), state="refined")
        yield r


REPAIRS = {"refine": refined, "carry": carried_on, "islands": off_islands, "bridges": bridged}


def mended_chunks(chunks: DataFrame, scores: DataFrame, keys: list[str], source_end: float = 0.0, repairs: tuple[str, ...] = ("carry", "islands", "bridges")) -> DataFrame:
    """(keys, idx, id, s0, s1, confidence, state) of each chunk after ``repairs``, each over what the one before left.

    ``chunks``: keys, id, idx (order), t0, t1, s0, s1, confidence, breaks (a cut at its start), stability, low_info,
    identity, corrected, follows (how alike it looks to the chunk before). ``scores``: id, place, score, or id and an
    array ``places`` of (place, score); a chunk's places travel with it. state: kept, none (no match), carried, filled, island, bridge or refined.
    """
    unknown = set(repairs) - REPAIRS.keys()
    if unknown:
        raise ValueError(f"no such repair: {sorted(unknown)}")
    if "places" in scores.columns:
        found = F.flatten(F.collect_list(F.filter("places", lambda p: p["place"].isNotNull() & p["score"].isNotNull())))
    else:
        scores, found = scores.where("place is not null and score is not null"), F.collect_list(F.struct("place", "score"))
    places = scores.groupBy("id").agg(F.sort_array(found).alias("places"))
    read = chunks.join(places, "id", "left").withColumn("state", F.when(F.col("s0").isNull(), "none").otherwise("kept"))
    read = read.withColumn("s1", F.coalesce("s1", F.col("s0") + F.greatest(F.lit(LEAST_LENGTH), F.col("t1") - F.col("t0"))))
    for name, default in (("confidence", 0.0), ("stability", 0.0), ("low_info", 1.0), ("identity", 0.0), ("follows", 0.0)):
        read = read.withColumn(name, F.coalesce(name, F.lit(default)))

    def scan(rows: Iterator) -> Iterator[tuple]:
        for name in repairs:
            rows = REPAIRS[name](rows, source_end)
        return ((r.idx, r.id, r.s0, r.s1, r.confidence, r.state) for r in rows)

    return ordered_scan(read, keys, ["idx", "id"], scan, MENDED.format(kind=chunks.schema["id"].dataType.simpleString()), {"places": _scored})
