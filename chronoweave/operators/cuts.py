"""Cuts between successive frames, and rows split at them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.scans import ordered_scan

#: Least difference of histograms and least length of a scene: fixed values.
SCENE_DIFFERENCE, SCENE_LENGTH = 30.0, 1.0
#: Seconds between samples of a row, least length of a part, rows that are kept whole (in parts), least length for moderate cuts.
STEP, PART, WHOLE, LONG = 0.25, 0.55, 1.35, 2.4


def chi_square(a: Column, b: Column) -> Column:
    """Sum of squared differences over the first histogram, both of length one; empty bins of the first count nothing."""
    size = lambda h: F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda h: F.transform(h, lambda x: F.coalesce(F.try_divide(x.cast("double"), size(h)), F.lit(0.0)))
    return F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: F.when(x > 0, (x - y) * (x - y) / x).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def mean_difference(a: Column, b: Column, top: float = 255.0) -> Column:
    """Mean absolute difference of two images of equal size, as a share of ``top``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a) / top


def _scenes(rows: Iterable, least: float) -> Iterator[tuple[float, float]]:
    start, end = 0.0, None
    for r in rows:
        end = r.duration
        if r.cut and r.time - start >= least:
            yield start, r.time
            start = r.time
    if end is not None and end > 0 and start < end:
        yield start, end


def scenes(frames: DataFrame, key: str, threshold: float = SCENE_DIFFERENCE, least: float = SCENE_LENGTH) -> DataFrame:
    """(key, start, end): scenes of each key's frames (time, hist, duration), from 0 to its duration.

    A scene ends where the histogram differs by more than ``threshold`` from the frame before, if it then is ``least``
    long; so a cut that is passed over moves no later one. Only cuts, and each key's last frame, go on to the scan.
    """
    w = Window.partitionBy(key).orderBy("time")
    before = F.lag("hist").over(w)
    cut = F.coalesce(chi_square(before, F.col("hist")) > threshold, F.lit(False))
    marked = frames.select(key, "time", "duration", cut.alias("cut"), F.lead("time").over(w).isNull().alias("last")).where("cut or last")
    return ordered_scan(marked, [key], ["time"], lambda rows: _scenes(rows, least), "start double, end double")


def strong_cut(hist: Column, mean: Column, edge: Column, duration: Column) -> Column:
    """Whether a difference of histogram, brightness and edges is a cut; in long rows moderate ones count too."""
    base = (hist >= 80.0) | ((hist >= 24.0) & (mean >= 0.12)) | (mean >= 0.55) | ((edge >= 0.30) & (mean >= 0.08)) | ((mean >= 0.46) & (edge >= 0.22))
    return base | ((duration >= LONG) & ((mean >= 0.22) | ((mean >= 0.18) & (edge >= 0.20))))


def split_on_cuts(rows: DataFrame, frames: DataFrame, key: str, row_id: str = "id", part: float = PART, step: float = STEP) -> DataFrame:
    """(key, id, part, start, stop, parts) of ``rows`` (key, id, start, stop, keep), split where their frames cut.

    ``frames``: key, frame (number, one each ``step`` seconds), hist, pixels, edges. Samples go from a row's start to its
    stop; neighbours that both have a frame are compared. A cut is taken if both the part before it, since the last one
    that was taken, and the rest are ``part`` seconds long; one too near the end moves back a sample. Short rows and
    those to ``keep`` stay whole; part counts from 1, and from 0 where nothing was split.
    """
    d = F.col("stop") - F.col("start")
    asked = rows.where(~F.col("keep") & (d > part * WHOLE))
    # The samples: each step before the stop less a twentieth of a second, and the stop.
    n = F.greatest(F.ceil((d - 0.05) / step), F.lit(0)).cast("int")
    times = F.concat(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.col("start") + i * step).otherwise(F.col("stop"))))
    samples = asked.select(key, row_id, "start", "stop", F.posexplode(times).alias("place", "time"))
    samples = samples.withColumn("frame", F.round(F.greatest(F.lit(0.0), F.col("time")) / step).cast("long"))
    seen = samples.join(frames.select(key, "frame", "hist", "pixels", "edges"), [key, "frame"], "left")
    w = Window.partitionBy(key, row_id).orderBy("place")
    for name in ("hist", "pixels", "edges"):
        seen = seen.withColumn(f"{name}_before", F.lag(name).over(w))
    seen = seen.withColumn("time_before", F.lag("time").over(w))
    hist, mean, edge = (f(F.col(f"{x}_before"), F.col(x)) for f, x in ((chi_square, "hist"), (mean_difference, "pixels"), (mean_difference, "edges")))
    place = F.when(F.col("stop") - F.col("time") < part, F.col("time_before")).otherwise(F.col("time"))
    cuts = seen.where(F.coalesce(strong_cut(hist, mean, edge, F.col("stop") - F.col("start")), F.lit(False))).select(key, row_id, "start", "stop", "place", place.alias("at"))
    listed = cuts.groupBy(key, row_id, "start", "stop").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "at"))), lambda x: x["at"]).alias("cuts"))
    taken = F.aggregate(
        "cuts", F.array("start"), lambda kept, at: F.when((at - F.element_at(kept, -1) >= part) & (F.col("stop") - at >= part), F.concat(kept, F.array(at))).otherwise(kept)
    )
    edges_of = listed.select(key, row_id, F.concat(taken, F.array("stop")).alias("edges"))
    j = rows.join(edges_of, [key, row_id], "left").withColumn("edges", F.coalesce("edges", F.array("start", "stop")))
    pairs = F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("start"), F.slice("edges", F.lit(2), F.size("edges") - 1).alias("stop"))
    split = F.size("edges") > 2
    out = j.select(key, row_id, (F.size("edges") - 1).alias("parts"), split.alias("split"), F.posexplode(pairs).alias("place", "p"))
    return out.where(~F.col("split") | (F.col("p.stop") - F.col("p.start") > 0.05)).select(key, row_id, F.when(F.col("split"), F.col("place") + 1).otherwise(F.lit(0)).alias("part"), "p.start", "p.stop", "parts")
