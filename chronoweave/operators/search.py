"""Scoring of a query sequence at given starts of a source: time-bucketed range joins, best row for each sample, then one score for each start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(samples: DataFrame, starts: DataFrame, frames: DataFrame, group: str, radius: float, scales: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Rows (group, start, scale, sample columns, frame columns): frames within ``radius`` of where a sample falls if its group starts there.

    ``samples``: group, sample, offset and more; ``starts``: group, start; ``frames``: time and more. Frames and samples
    meet in buckets of time twice the radius wide, so a sample is held against a few frames only.
    """
    width = 2 * radius
    at = samples.join(starts, group).withColumn("scale", F.explode(F.array(*[F.lit(x) for x in scales])))
    at = at.withColumn("target", F.col("start") + F.col("offset") * F.col("scale"))
    first = F.floor((F.col("target") - radius) / width)
    at = at.withColumn("bucket", F.explode(F.array(first, first + 1)))
    near = at.join(frames.withColumn("bucket", F.floor(F.col("time") / width)), "bucket").where(F.abs(F.col("time") - F.col("target")) <= radius)
    return near.drop("bucket", "target")


def sequence_scores(near: DataFrame, samples: DataFrame, group: str, similarity: Column) -> DataFrame:
    """(group, start, scale, score, matched, stability, low_ratio) of the best scale of each start.

    Each sample takes its best frame by ``similarity``, damped by the lower quality of the two; the best three quarters
    of the samples are averaged. Coverage, stability and even scores count for a start, frames of little content
    against it. Sample columns: sample, q_quality, q_low; frame columns: time, f_quality, f_low. Starts without any
    frame in reach are left out.
    """
    # Weights, shares and penalties are fixed values.
    scored = near.withColumn("s", similarity * (0.82 + 0.18 * F.least("q_quality", "f_quality")))
    best = scored.groupBy(group, "start", "scale", "sample").agg(F.max(F.struct("s", (-F.col("time")).alias("t"), "f_quality", "f_low", "q_quality", "q_low")).alias("b")).where("b.s > 0")
    of = F.sort_array(F.collect_list("b.s"), False)
    one = best.groupBy(group, "start", "scale").agg(of.alias("scores"), F.count("*").alias("matched"), F.avg("b.q_quality").alias("q"), F.avg("b.f_quality").alias("f"), F.avg((F.col("b.f_low") | F.col("b.q_low")).cast("double")).alias("low_ratio"))
    total = samples.groupBy(group).agg(F.count("*").alias("total"))
    one = one.join(total, group).withColumn("coverage", F.col("matched") / F.col("total"))
    one = one.withColumn("stability", F.least(F.lit(1.0), F.col("coverage") * 0.5 + F.col("q") * 0.25 + F.col("f") * 0.25))
    keep = F.when(F.col("matched") <= 3, F.col("matched")).otherwise(F.greatest(F.lit(2), F.floor(F.col("matched") * 0.75))).cast("int")
    one = one.withColumn("top", F.slice("scores", F.lit(1), keep)).withColumn("k", F.size("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.col("k")
    one = one.withColumn("mean", mean)
    spread = F.sqrt(F.aggregate(F.transform("top", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / F.col("k")) / (F.col("mean") + 1e-6)
    even = F.when(F.col("k") >= 2, 0.06 * (1 - F.least(F.lit(1.0), spread * 2))).otherwise(F.lit(0.0))
    score = F.col("mean") * 0.74 + F.element_at("top", -1) * 0.13 + F.col("coverage") * 0.09 + F.col("stability") * 0.02 + even - F.greatest(F.lit(0.0), F.col("low_ratio") - 0.25) * 0.25
    one = one.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))
    top = one.groupBy(group, "start").agg(F.max(F.struct("score", (-F.col("scale")).alias("s"), "matched", "stability", "low_ratio")).alias("b"))
    return top.select(group, "start", (-F.col("b.s")).alias("scale"), "b.score", "b.matched", "b.stability", "b.low_ratio")


def identity_scores(near: DataFrame, samples: DataFrame, group: str, similarity: Column) -> DataFrame:
    """(group, start, score, mean, least, matched): how alike samples and the frames right at their places are, with the fixed scale and penalties of the survey's J05."""
    # Scale, shares and penalties are fixed values.
    best = near.groupBy(group, "start", "sample").agg(F.max(similarity).alias("s"))
    total = samples.groupBy(group).agg(F.count("*").alias("total"))
    one = best.groupBy(group, "start").agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.count("*").alias("matched")).join(total, group)
    coverage, unit = F.col("matched") / F.col("total"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = unit(unit((F.col("mean") - 0.18) / 0.62) * 0.9 + coverage * 0.1)
    score = score * F.when(coverage < 0.75, F.greatest(F.lit(0.55), coverage)).otherwise(F.lit(1.0))
    score = score * F.when((F.col("matched") >= 2) & (F.col("least") < F.col("mean") - 0.18), F.lit(0.92)).otherwise(F.lit(1.0))
    return one.select(group, "start", unit(score).alias("score"), "mean", "least", "matched")
