"""Ranges held against a source's frames: their score at a start, the best place near a hint, and how much source fits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a range is sampled, by its duration; how far a frame may be from a sample; shares of the frame and the pair score, least pair score, what less costs.
SAMPLES, REACH, SHARES, LEAST_PAIR, DAMPED = ((1.2, (0.50,)), (2.5, (0.33, 0.67)), (None, (0.22, 0.50, 0.78))), 1.35, (0.35, 0.65), 0.45, 0.72
#: Retiming: least duration, offset of both edges (share, least, most), least score there, speeds, how much worse the fitted start may score. Fixed values.
LEAST_DURATION, EDGE, LEAST_SCORE, SPEEDS, WORSE = 1.40, (0.16, 0.18, 0.45), 0.64, (0.55, 1.85), 0.075
#: Shares of frame and pair score in a local search.
LOCAL_SHARES = (0.25, 0.75)


def _looked_at(df: DataFrame, looks: DataFrame, key: str, time: Column, step: float) -> DataFrame:
    """Rows with the target's frame (looks: key, frame, one each ``step`` seconds) that stands at ``time``; others go."""
    return df.withColumn("look", F.floor(time / step + 0.5).cast("long")).join(looks.select(key, F.col("frame").alias("look"), F.col("vector").alias("asked")), [key, "look"])


def _near(df: DataFrame, frames: DataFrame, key: str, place: str, radius: float) -> DataFrame:
    """Pairs of rows and source frames (time, shown) at most ``radius`` apart; both meet in buckets of twice that."""
    width = 2 * radius
    first = F.floor((F.col(place) - radius) / width)
    asked = df.withColumn("bucket", F.explode(F.array(first, first + 1)))
    shown = frames.select(key, F.col("time"), F.col("vector").alias("shown"), F.floor(F.col("time") / width).alias("bucket"))
    return asked.join(shown, [key, "bucket"]).where(F.abs(F.col("time") - F.col(place)) <= radius).drop("bucket")


def range_scores(starts: DataFrame, looks: DataFrame, frames: DataFrame, key: str, frame: Column, pair: Column, step: float) -> DataFrame:
    """(key, id, start, score) of each range (key, id, t0, duration, start): the mean over its samples of how alike the target's frame and the best of the nearest source frames are.

    A sample looks at the last source frame before its place and the two from there on, within ``REACH`` seconds; one
    that finds none counts 0. ``frame`` and ``pair``: similarities of asked and shown.
    """
    at = F.lit(None).cast("array<double>")
    for most, places in reversed(SAMPLES):
        here = F.array(*map(F.lit, places))
        at = here if most is None else F.when(F.col("duration") < most, here).otherwise(at)
    s = starts.withColumn("at", F.explode(at)).withColumn("place", F.col("start") + F.col("duration") * F.col("at"))
    s = _looked_at(s, looks, key, F.col("t0") + F.col("duration") * F.col("at"), step)
    row = [key, "id", "start", "at"]
    n = _near(s, frames, key, "place", REACH).withColumn("behind", F.col("time") < F.col("place"))
    order = Window.partitionBy(*row, "behind").orderBy(F.when(F.col("behind"), -F.col("time")).otherwise(F.col("time")))
    n = n.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= F.when(F.col("behind"), 1).otherwise(2)).withColumn("f", frame)
    best = n.where("f > 0").groupBy(*row).agg(F.max_by(F.struct("f", "asked", "shown"), F.struct("f", -F.col("time"))).alias("b")).select(*row, F.col("b.f").alias("f"), F.col("b.asked").alias("asked"), F.col("b.shown").alias("shown"))
    best = best.withColumn("p", pair).select(*row, ((F.col("f") * SHARES[0] + F.col("p") * SHARES[1]) * F.when(F.col("p") < LEAST_PAIR, DAMPED).otherwise(1.0)).alias("s"))
    scored = s.select(*row).join(best, row, "left").groupBy(key, "id", "start").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("score"))
    return scored.select(key, "id", "start", F.round("score", 9).alias("score"))


def local_best(asked: DataFrame, frames: DataFrame, key: str, radius: float, frame: Column, pair: Column) -> DataFrame:
    """(key, id, edge, time, score): the most similar source frame within ``radius`` of each row's hint (key, id, edge, hint, asked); none that scores 0, the earliest of equals."""
    n = _near(asked, frames, key, "hint", radius).withColumn("f", frame).withColumn("p", pair)
    n = n.withColumn("s", F.round(F.when(F.col("p") > 0, F.col("f") * LOCAL_SHARES[0] + F.col("p") * LOCAL_SHARES[1]).otherwise(F.col("f")), 9)).where("s > 0")
    best = n.groupBy(key, "id", "edge").agg(F.max_by(F.struct("time", "s"), F.struct("s", -F.col("time"))).alias("b"))
    return best.select(key, "id", "edge", F.col("b.time").alias("time"), F.col("b.s").alias("score"))


def retimed_ranges(ranges: DataFrame, looks: DataFrame, frames: DataFrame, key: str, frame: Column, pair: Column, source_end: float = 0.0, step: float = 0.25) -> DataFrame:
    """(key, id, s0, s1, score, fitted): ranges (key, id, t0, t1, s0, s1, score) whose source starts and ends where their edges look best.

    Both edges, a little inside, are looked for near their places; where both are found well, and the speed that follows
    is possible, the range takes that source unless its start scores clearly worse than the old one.
    """
    length = F.col("t1") - F.col("t0")
    r = ranges.withColumn("duration", F.greatest(F.lit(0.0), length)).withColumn("edge_at", F.least(F.lit(EDGE[2]), F.greatest(F.lit(EDGE[1]), F.col("duration") * EDGE[0])))
    due = r.where((F.col("duration") >= LEAST_DURATION) & (F.col("s1") > F.col("s0")))
    both = due.select(key, "id", F.explode(F.array(F.struct(F.lit("in").alias("edge"), (F.col("t0") + F.col("edge_at")).alias("at"), (F.col("s0") + F.col("edge_at")).alias("hint")), F.struct(F.lit("out").alias("edge"), (F.col("t1") - F.col("edge_at")).alias("at"), (F.col("s1") - F.col("edge_at")).alias("hint")))).alias("e")).select(key, "id", "e.*")
    found = local_best(_looked_at(both, looks, key, F.col("at"), step), frames, key, REACH, frame, pair)
    of = lambda edge, x: F.max(F.when(F.col("edge") == edge, F.col(x)))
    edges = found.groupBy(key, "id").agg(of("in", "time").alias("in_time"), of("in", "score").alias("in_score"), of("out", "time").alias("out_time"), of("out", "score").alias("out_score"))
    fit = due.join(edges, [key, "id"]).where((F.col("in_score") >= LEAST_SCORE) & (F.col("out_score") >= LEAST_SCORE))
    fit = fit.withColumn("f0", F.greatest(F.lit(0.0), F.col("in_time") - F.col("edge_at"))).withColumn("f1", F.greatest(F.col("f0") + 0.05, F.col("out_time") + F.col("edge_at")))
    if source_end > 0:
        over = F.greatest(F.lit(0.0), F.col("f1") - source_end)
        fit = fit.withColumn("f0", F.when(over > 0, F.greatest(F.lit(0.0), F.col("f0") - over)).otherwise(F.col("f0"))).withColumn("f1", F.least("f1", F.lit(source_end)))
    fit = fit.where(((F.col("f1") - F.col("f0")) / F.greatest(F.col("duration"), F.lit(0.05))).between(*SPEEDS))
    starts = fit.select(key, "id", "t0", "duration", F.explode(F.array_distinct(F.array("s0", "f0"))).alias("start"))
    scores = range_scores(starts, looks, frames, key, frame, pair, step)
    at = lambda place, name: scores.select(key, "id", F.col("start").alias(place), F.col("score").alias(name))
    fit = fit.join(at("s0", "old"), [key, "id", "s0"]).join(at("f0", "new"), [key, "id", "f0"]).where(F.col("new") >= F.col("old") - WORSE)
    fit = fit.select(key, "id", "f0", "f1", F.least("in_score", "out_score", "new").alias("f_score"))
    j, done = ranges.join(fit, [key, "id"], "left"), F.col("f0").isNotNull()
    return j.select(key, "id", F.coalesce("f0", "s0").alias("s0"), F.coalesce("f1", "s1").alias("s1"), F.when(done, F.greatest("score", "f_score")).otherwise(F.col("score")).alias("score"), done.alias("fitted"))
