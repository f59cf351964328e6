"""Interval and ordered-scan operators: windows, islands, gaps, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of both; 0 where the hull is empty."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """(keys, start, end, n): overlapping or touching intervals of a key made one. A new island begins past the running end.

    Nulls come last, as in SQL: without a start, an interval belongs to a key's last island.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(*BEFORE))
    flagged = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0))
    island = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def inject_gaps(df: DataFrame, keys: list[str], start: str, end: str, total: Column, min_gap: float) -> DataFrame:
    """(keys, start, end) of the gaps of at least ``min_gap`` before, between and after a key's intervals, within ``total``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.coalesce(F.max(end).over(order.rowsBetween(*BEFORE)), F.lit(0.0))
    inner = df.select(*keys, reach.alias("a"), F.least(F.col(start), total).alias("b"))
    tail = df.groupBy(*keys).agg(F.max(end).alias("a"), F.max(total).alias("b"))
    return inner.unionByName(tail).where(F.col("b") - F.col("a") >= min_gap).select(*keys, F.col("a").alias(start), F.col("b").alias(end))


def split_long(df: DataFrame, start: str, end: str, longest: float) -> DataFrame:
    """Rows longer than ``longest`` in equal parts, with part and parts."""
    span = F.col(end) - F.col(start)
    parts = F.greatest(F.lit(1), F.ceil(span / longest).cast("int"))
    out = df.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("__a", F.col(start) + span * F.col("part") / F.col("parts")).withColumn(end, F.col(start) + span * (F.col("part") + 1) / F.col("parts")).withColumn(start, F.col("__a")).drop("__a")


def neighbour_hint(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """prev_, next_ and their places: the nearest rows on either side with ``value``; hint: the value interpolated between them, or the one there is."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(*BEFORE))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = df.withColumn("__p", prev).withColumn("__n", nxt)
    between = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * F.coalesce(F.try_divide(F.col(order) - F.col("__p.o"), F.col("__n.o") - F.col("__p.o")), F.lit(0.0))
    return out.withColumn("prev_value", F.col("__p.v")).withColumn("next_value", F.col("__n.v")).withColumn("hint", F.coalesce(between, F.col("__p.v"), F.col("__n.v"))).drop("__p", "__n")


def temporal_outliers(df: DataFrame, keys: list[str], order: str, value: str, deviation: float) -> DataFrame:
    """Rows with ``value`` that lie further than ``deviation`` from the line through the means of two rows on either side.

    Only rows with two eligible neighbours on each side are judged, in keys of seven eligible rows or more.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ok = df.where(F.col(value).isNotNull())
    at = {k: (F.lag if k < 0 else F.lead)(F.struct(F.col(order).alias("o"), F.col(value).alias("v")), abs(k)).over(w) for k in (-2, -1, 1, 2)}
    out = ok.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    for k, c in at.items():
        out = out.withColumn(f"__{k + 2}", c)
    mean = lambda a, b, f: (F.col(f"__{a}.{f}") + F.col(f"__{b}.{f}")) / 2
    left_o, left_v, right_o, right_v = mean(0, 1, "o"), mean(0, 1, "v"), mean(3, 4, "o"), mean(3, 4, "v")
    expected = left_v + (right_v - left_v) * F.coalesce(F.try_divide(F.col(order) - left_o, right_o - left_o), F.lit(0.0))
    out = out.withColumn("expected", expected)
    return out.where((F.col("__n") >= 7) & F.col("expected").isNotNull() & (F.abs(F.col(value) - F.col("expected")) > deviation)).drop("__n", "__0", "__1", "__3", "__4")


def source_jumps(df: DataFrame, keys: list[str], order: str, target_start: str, target_end: str, source_start: str, source_end: str) -> DataFrame:
    """Each row with its target gap and source jump against the row before, and whether that breaks continuity."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("target_gap", F.col(target_start) - F.lag(target_end).over(w)).withColumn("jump", F.col(source_start) - F.lag(source_end).over(w))
    flag = (F.abs("target_gap") > 0.08) | (F.col("jump") < -0.25) | (F.abs("jump") > 8) | (F.col(target_end) - F.col(target_start) < 0.5)
    return out.withColumn("flagged", F.coalesce(flag, F.lit(False)))


def low_groups(df: DataFrame, keys: list[str], time: str, score: str, threshold: float, step: float) -> DataFrame:
    """Runs of samples below ``threshold`` whose distance is at most 1.6 steps: extent, count, mean, least and where it is."""
    w = Window.partitionBy(*keys).orderBy(time)
    low = df.where(F.col(score) < threshold)
    new = F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > 1.6 * step), 1).otherwise(0)
    island = low.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.min_by(time, F.struct(score, time)).alias("worst_at")).drop("__island")


def locate_asof(probes: DataFrame, rows: DataFrame, keys: list[str], time: str, start: str, payload: list[str]) -> DataFrame:
    """For each probe, ``payload`` of the last row of its key that starts at or before its time.

    Both sides are joined in one sorted pass: a union by time and a running last value, with no range join.
    """
    left = probes.withColumn("__t", F.col(time)).withColumn("__side", F.lit(1)).withColumn("__row", F.lit(None).cast(T_of(rows, payload)))
    right = rows.select(*keys, F.col(start).alias("__t"), F.lit(0).alias("__side"), F.struct(*payload).alias("__row"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__at", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*probes.columns, *[F.col(f"__at.{c}").alias(c) for c in payload])


def T_of(rows: DataFrame, payload: list[str]):
    """The struct type of the payload columns."""
    return rows.select(F.struct(*payload).alias("s")).schema["s"].dataType


def range_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, start: str, end: str, bucket: float) -> DataFrame:
    """Pairs with left.time in [right.start, right.end], by an equality join on time buckets; long intervals take several buckets."""
    a = left.withColumn("__b", F.floor(F.col(time) / bucket))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return a.join(b, [*keys, "__b"]).where(F.col(time).between(F.col(start), F.col(end))).drop("__b")


def interpolate_anchors(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """estimate and confidence at rows without ``value``: linear between the anchors around, the only anchor's value at the ends."""
    out = neighbour_hint(df, keys, order, value)
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    near = F.least(F.col(order) - F.last(at, ignorenulls=True).over(w.rowsBetween(*BEFORE)), F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) - F.col(order))
    conf = F.greatest(F.lit(0.2), F.least(F.lit(0.7), 0.7 * F.exp(-near / 60) + 0.2))
    return out.withColumn("distance", near).withColumn("confidence", conf).where(F.col(value).isNull())


def similar_runs(df: DataFrame, key: str, row_id: str, hash_col: str, bits: int, block: int = 65_536) -> DataFrame:
    """(key, first_id, last_id, n): runs of a key's rows, by a whole-number id, each at most ``bits`` bits from the row before.

    Windows span a block of ids of one key. What a block must know of those before it, the last hash and where the last
    run began, is one row for each block, so a key with most of the rows is many tasks.
    """
    rows = df.select(key, F.col(row_id).alias("__id"), F.col(hash_col).alias("__h"), F.floor(F.col(row_id) / block).alias("__block"))
    own, blocks = Window.partitionBy(key, "__block").orderBy("__id"), Window.partitionBy(key).orderBy("__block")
    last = rows.groupBy(key, "__block").agg(F.max_by("__h", "__id").alias("__last"))
    before = last.select(key, "__block", F.lag("__last").over(blocks).alias("__before"))
    near = F.bit_count(F.col("__h").bitwiseXOR(F.coalesce(F.lag("__h").over(own), F.when(F.row_number().over(own) == 1, F.col("__before"))))) <= bits
    starts = rows.join(before, [key, "__block"]).withColumn("__start", F.when(~F.coalesce(near, F.lit(False)), F.col("__id")))
    begun = starts.groupBy(key, "__block").agg(F.max("__start").alias("__begun")).select(key, "__block", F.last("__begun", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    run = F.coalesce(F.last("__start", True).over(own), F.col("__open"))
    runs = starts.join(begun, [key, "__block"]).withColumn("first_id", run)
    return runs.groupBy(key, "first_id").agg(F.max("__id").alias("last_id"), F.count("*").alias("n")).select(key, "first_id", "last_id", "n")
