"""Ordered scans whose state depends on what they decided before, as folds over a group's sorted array.

A group is one project's or one segment's rows; the array is aggregated inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gathered(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row for each key with its rows as a sorted array of structs; the order columns come first."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *columns))).alias("rows"))


def nms(df: DataFrame, keys: list[str], score: str, time: str, row_id: str, tolerance: float) -> DataFrame:
    """Greedy suppression: by falling score, a row stays if no kept one of its key lies within ``tolerance``; rank counts from 1.

    Kept rows are at most one for each tolerance on the axis, so the list that a row is held against stays short.
    """
    rows = gathered(df, keys, [-F.col(score), F.col(row_id)], [time, row_id, score])
    empty = F.filter(F.transform("rows", lambda x: F.struct(x[time].alias(time), x[row_id].alias(row_id), x[score].alias(score))), lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        item = F.struct(x[time].alias(time), x[row_id].alias(row_id), x[score].alias(score))
        return F.when(F.exists(kept, lambda y: F.abs(y[time] - x[time]) < tolerance), kept).otherwise(F.concat(kept, F.array(item)))

    folded = rows.select(*keys, F.posexplode(F.aggregate("rows", empty, step)).alias("p", "k"))
    return folded.select(*keys, (F.col("p") + 1).alias("rank"), f"k.{time}", f"k.{row_id}", f"k.{score}")


def monotonic_guard(df: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Each row's start pushed past the end of all rows before it, ends pushed so that none is before its start.

    As the pushed end is the running maximum of ends and starts, the state is a window maximum and needs no fold.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.greatest(start, end)).over(w)
    return df.withColumn("guarded_start", F.greatest(F.col(start), F.coalesce(reach, F.col(start)))).withColumn("guarded_end", F.greatest(F.col(end), F.col("guarded_start")))


def chunk_pack(df: DataFrame, keys: list[str], order: str, start: str, end: str, max_gap: float = 0.35, longest: float = 3.2, most: int = 8, long_enough: float = 2.2) -> DataFrame:
    """Each row with the number of its chunk: a new chunk begins at a gap, when the chunk would grow too long, or when it has rows and length enough."""
    rows = gathered(df, keys, [F.col(order)], [start, end])
    state = F.struct(F.lit(-1).alias("chunk"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        grown = F.greatest(s["last"], x[end]) - s["first"]
        new = (s["n"] == 0) | (x[start] - s["last"] > max_gap) | ((s["n"] >= most) & (s["last"] - s["first"] >= long_enough)) | (grown > longest)
        chunk = s["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(
            chunk.alias("chunk"),
            F.when(new, x[start]).otherwise(s["first"]).alias("first"),
            F.when(new, x[end]).otherwise(F.greatest(s["last"], x[end])).alias("last"),
            F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.concat(s["out"], F.array(chunk)).alias("out"),
        )

    folded = rows.select(*keys, "rows", F.aggregate("rows", state, step)["out"].alias("chunks"))
    pairs = folded.select(*keys, F.explode(F.arrays_zip("rows", "chunks")).alias("z"))
    return pairs.select(*keys, F.col("z.rows.o0").alias(order), F.col(f"z.rows.{start}").alias(start), F.col(f"z.rows.{end}").alias(end), F.col("z.chunks").alias("chunk"))


def merge_short(df: DataFrame, keys: list[str], order: str, start: str, end: str, kind: str, max_gap: float = 0.35, longest: float = 8.0, short: float = 1.2) -> DataFrame:
    """Adjacent rows of one kind merged when either is short, the gap small and the whole not too long."""
    rows = gathered(df, keys, [F.col(order)], [start, end, kind])
    item = lambda a, b, k, n: F.struct(a.alias("a"), b.alias("b"), k.alias("k"), n.alias("n"))
    empty = F.filter(F.transform("rows", lambda x: item(x[start], x[end], x[kind], F.lit(1))), lambda x: F.lit(False))

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (last["k"] == x[kind]) & (x[start] - last["b"] <= max_gap) & (F.greatest(last["b"], x[end]) - last["a"] <= longest) & ((last["b"] - last["a"] < short) | (x[end] - x[start] < short))
        merged = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(item(last["a"], F.greatest(last["b"], x[end]), x[kind], last["n"] + 1)))
        return F.when(F.size(out) == 0, F.array(item(x[start], x[end], x[kind], F.lit(1)))).when(joins, merged).otherwise(F.concat(out, F.array(item(x[start], x[end], x[kind], F.lit(1)))))

    folded = rows.select(*keys, F.posexplode(F.aggregate("rows", empty, step)).alias("place", "z"))
    return folded.select(*keys, "place", F.col("z.a").alias(start), F.col("z.b").alias(end), F.col("z.k").alias(kind), F.col("z.n").alias("n"))
