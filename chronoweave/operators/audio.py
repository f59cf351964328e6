"""Search of sound by windows of its features, and consistency of motion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.coarse import coarse_hits, cosine_scores

#: Least length of a motion that has a ratio; what stands for no motion; shares of lengths and turns. Fixed values.
MOVES, UNKNOWN, SHARES = 0.1, 0.5, (0.6, 0.4)


def windowed_features(frames: DataFrame, keys: list[str], time: str, coefficients: list[str], window: str = "2 seconds", step: str = "500 milliseconds") -> DataFrame:
    """(keys, at, feature): mean and deviation of each coefficient over sliding windows, together of length one; at is a window's start.

    The same for a table and for a stream; a stream needs a watermark on ``time`` to give windows up. Windows without
    any spread and mean have no direction: their feature is zeros.
    """
    of = frames.groupBy(*keys, F.window(time, window, step).alias("w")).agg(*[F.avg(x).alias(f"m_{x}") for x in coefficients], *[F.stddev_pop(x).alias(f"s_{x}") for x in coefficients])
    raw = F.array(*[F.coalesce(F.col(f"{p}_{x}"), F.lit(0.0)) for p in ("m", "s") for x in coefficients])
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return of.select(*keys, F.col("w.start").alias("at"), F.transform(raw, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0))).alias("feature"))


def window_hits(queries: DataFrame, index: DataFrame, source: str, threshold: float = 0.6, block: float = 86400.0) -> DataFrame:
    """(source, query, time, confidence): the most similar window of each query's source, if half of one more than the cosine reaches ``threshold``.

    ``queries``: source, query, q_time (seconds), feature; ``index``: source, time (seconds), feature. Ties go to the earlier window.
    """
    hash_ = F.lit(0).cast("long").alias("hash")  # not looked at
    q = queries.select(source, "query", "q_time", hash_, F.col("feature").alias("vector"))
    hits = coarse_hits(q, index.select(source, "time", hash_, F.col("feature").alias("vector")), source, 1, cosine_scores, block=block)
    return hits.select(source, "query", "time", ((F.col("coarse") + 1) / 2).alias("confidence")).where(F.col("confidence") >= threshold)


def flow_consistency(a: Column, b: Column) -> Column:
    """How alike two courses of motion are, from arrays of structs (length, direction in radians): 0 where either is empty.

    Lengths by the mean ratio of those that move on both sides, turns by how little they differ from step to step; what
    can't be told counts one half.
    """
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))
    moving = F.filter(pairs, lambda p: (p["a"]["length"] > MOVES) & (p["b"]["length"] > MOVES))
    ratio = F.transform(moving, lambda p: F.least(p["a"]["length"], p["b"]["length"]) / F.greatest(p["a"]["length"], p["b"]["length"]))
    turn = lambda side: F.zip_with(F.slice(side, F.lit(2), n - 1), F.slice(side, F.lit(1), n - 1), lambda y, x: y["direction"] - x["direction"])
    alike = F.zip_with(turn(a), turn(b), lambda x, y: 1 - F.least(F.abs(x - y) / math.pi, F.lit(1.0)))
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).otherwise(F.lit(UNKNOWN))
    return F.when(n > 0, mean(ratio) * SHARES[0] + F.when(n > 1, mean(alike)).otherwise(F.lit(UNKNOWN)) * SHARES[1]).otherwise(F.lit(0.0))
