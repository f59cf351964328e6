"""Places at which a row is searched again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds within which places are one, seeds that are spread, steps of the spread besides the row's own duration, and hints in all: fixed values.
SAME, SPREAD_SEEDS, HINTS, CANDIDATES = 3.0, 6, 12, 4
STEPS = (-45.0, -15.0, -1.0, 1.0, 15.0, 45.0)
#: Of ``STEPS``, those that are multiples of the duration, which counts as a second at least.
OWN = (-1.0, 1.0)


def _kept(values: Column, start: Column) -> Column:
    """``start`` and each further value that is more than ``SAME`` from all that are kept, in order; nulls are passed over."""
    return F.aggregate(values, start, lambda kept, v: F.when(v.isNull() | F.exists(kept, lambda k: F.abs(k - v) <= SAME), kept).otherwise(F.concat(kept, F.array(v))))


def recheck_hints(neighbour: Column, start: Column, end: Column, candidates: Column, duration: Column) -> Column:
    """Up to twelve places, the likeliest first: the neighbour's, the row's own start and middle, its best candidates', then around the first six.

    ``candidates``: an array of structs (score, start, end), of which the best four count; null counts as none. No two
    places are within three seconds.
    """
    none = F.array().cast("array<double>")
    zero = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))
    ordered = F.slice(F.array_sort(F.coalesce(candidates, F.array().cast("array<struct<score:double,start:double,end:double>>")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1, CANDIDATES)
    theirs = F.flatten(F.transform(ordered, lambda x: F.array(zero(x["start"]), zero((x["start"] + x["end"]) / 2))))
    seeds = _kept(F.concat(F.array(zero(neighbour), zero(start), zero((start + end) / 2)), theirs), none)
    length = F.greatest(F.lit(1.0), duration)
    spread = F.flatten(F.transform(F.slice(seeds, 1, SPREAD_SEEDS), lambda s: F.array(*[F.greatest(F.lit(0.0), s + (length * k if k in OWN else F.lit(k))) for k in STEPS])))
    return F.slice(_kept(spread, seeds), 1, HINTS)
