"""Refinement of segments: snapping to boundaries, context windows, runs of parts, splits by words and by proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.vectors import bound


def snapped(rows: DataFrame, boundaries: DataFrame, key: str, row_id: str, start: str, end: str, at: str, tolerance: float = 0.4) -> DataFrame:
    """``rows`` with both ends moved to the nearest boundary of their key that is at most ``tolerance`` away; of two as near, the lower.

    Ends and boundaries are merged in one sorted pass for each key: the last boundary before and the first one behind
    an end are running values, so nothing is paired. An end never comes before its start.
    """
    ends = rows.select(key, row_id, F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col(start).alias("v")), F.struct(F.lit("end").alias("side"), F.col(end).alias("v")))).alias("e")).select(key, row_id, "e.side", "e.v")
    marks = boundaries.select(key, F.col(at).alias("v"), F.col(at).alias("mark"))
    merged = ends.withColumn("mark", F.lit(None).cast("double")).unionByName(marks.withColumn("side", F.lit(None).cast("string")).withColumn(row_id, F.lit(None).cast(dict(rows.dtypes)[row_id])))
    back = Window.partitionBy(key).orderBy("v")
    before = F.last("mark", True).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.first("mark", True).over(back.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = merged.withColumn("lo", before).withColumn("hi", behind).where("side is not null")
    near = near.withColumn("best", F.when(F.col("hi").isNull() | (F.col("v") - F.col("lo") <= F.col("hi") - F.col("v")), F.col("lo")).otherwise(F.col("hi")))
    moved = near.withColumn("moved", F.when(F.abs(F.col("best") - F.col("v")) <= tolerance, F.col("best")).otherwise(F.col("v")))
    wide = moved.groupBy(key, row_id).agg(F.max(F.when(F.col("side") == "start", F.col("moved"))).alias("s"), F.max(F.when(F.col("side") == "end", F.col("moved"))).alias("e"), F.max(F.when(F.col("side") == "end", F.col("v"))).alias("raw"))
    return wide.select(key, row_id, F.col("s").alias(start), F.when(F.col("e") != F.col("raw"), F.greatest("s", "e")).otherwise(F.col("e")).alias(end))


def context_window(rows: DataFrame, key: str, order: str, start: str, end: str, eligible: str, least: float = 5.5, side: int = 2, gain: float = 0.8) -> DataFrame:
    """``rows`` with context_start and context_end: a row's span widened by neighbours, one left and one right in turn, until it lasts ``least``.

    Only ``eligible`` neighbours widen; a turn that widens on neither side is the last, and so is the one that uses up
    twice ``side`` neighbours. Null where the context is no more than ``gain`` longer than the row.
    """
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumns({"_s": F.col(start), "_e": F.col(end), "_n": F.lit(0), "_go": F.lit(True)})
    for turn in range(1, 2 * side + 1):
        for shift, edge, state in ((-turn, start, "_s"), (turn, end, "_e")):
            out = out.withColumn(f"_v{shift}", F.lag(F.when(F.col(eligible), F.col(edge)), -shift).over(w))
    for turn in range(1, 2 * side + 1):
        out = out.withColumn("_was", F.col("_n"))
        for shift, state in ((-turn, "_s"), (turn, "_e")):
            use = F.col("_go") & (F.col("_e") - F.col("_s") < least) & (F.col("_n") < 2 * side) & F.col(f"_v{shift}").isNotNull()
            out = out.withColumns({state: F.when(use, F.col(f"_v{shift}")).otherwise(F.col(state)), "_n": F.col("_n") + use.cast("int")})
        out = out.withColumn("_go", F.col("_go") & (F.col("_n") > F.col("_was")))
    enough = F.col("_e") - F.col("_s") > F.greatest(F.col(end) - F.col(start), F.lit(0.0)) + gain
    return out.select(*rows.columns, F.when(enough, F.col("_s")).alias("context_start"), F.when(enough, F.col("_e")).alias("context_end"))


def coalesced_parts(rows: DataFrame, key: str, order: str, row_id: str, start: str, end: str, manual: str, pattern: str, max_gap: float = 0.2) -> DataFrame:
    """Rows that are parts of one parent (``pattern``, its group 1 the parent's id) merged where they follow each other closely.

    A run of parts goes as far as the parent is the same and gaps are at most ``max_gap``. Parts up to the last manual
    one of a run stay as they are; two or more behind it become one row with the parent's id. ``parts`` counts them.
    """
    base = F.regexp_extract(F.col(row_id), pattern, 1)
    w = Window.partitionBy(key).orderBy(order)
    parts = rows.withColumn("_base", F.when(base != "", base))
    goes_on = F.col("_base").eqNullSafe(F.lag("_base").over(w)) & F.col("_base").isNotNull() & (F.col(start) - F.lag(end).over(w) <= max_gap)
    runs = parts.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    last_manual = F.max(F.when(F.col(manual), F.col(order))).over(Window.partitionBy(key, "_run"))
    alone = F.col("_base").isNull() | F.coalesce(F.col(order) <= last_manual, F.lit(False))
    runs = runs.withColumn("_group", F.when(alone, F.col(order)).otherwise(F.lit(-1)))
    first = F.min_by(F.col(row_id), F.col(order))
    merged = runs.groupBy(key, "_run", "_group").agg(F.min(order).alias(order), F.when(F.count("*") > 1, F.first("_base")).otherwise(first).alias(row_id), F.min_by(start, order).alias(start), F.max_by(end, order).alias(end), F.count("*").alias("parts"))
    return merged.drop("_run", "_group")


def split_words(rows: DataFrame, keys: list[str], words: str, least: float = 1.2, most: float = 8.0, pause: float = 0.55, endings: str = "。！？!?；;…") -> DataFrame:
    """Pieces of each row's ``words`` (array of structs word, start, end): a fold that closes a piece behind a word.

    It closes at a sentence's end or before a pause if it lasts ``least``, and anyway once it lasts ``most``; words
    without times are left out. One row of words is one array, never those of a whole table.
    """
    timed = F.filter(words, lambda x: x["start"].isNotNull() & x["end"].isNotNull())
    # Each word with the next one's start, so that no step of the fold looks at the array again.
    paired = bound(timed, lambda all_: F.transform(all_, lambda x, i: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), F.try_element_at(all_, i + 2)["start"].alias("then"))))
    piece = "array<struct<start:double,end:double,text:string,n:int>>"
    state = F.struct(F.array().cast(piece).alias("out"), F.lit(None).cast("double").alias("start"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        start = F.coalesce(s["start"], x["start"])
        long = x["end"] - start
        bare = F.trim(x["word"])
        ends = (bare != "") & F.lit(endings).contains(F.substring(bare, -1, 1)) & (long >= least)
        closes = x["then"].isNull() | (long >= most) | ends | ((F.greatest(x["then"] - x["end"], F.lit(0.0)) >= pause) & (long >= least))

        def after(now: Column) -> Column:
            made = F.array(F.struct(now["start"].alias("start"), x["end"].alias("end"), F.trim(now["text"]).alias("text"), now["n"].alias("n")))
            return F.when(now["closes"], F.struct(F.concat(s["out"], made).alias("out"), F.lit(None).cast("double").alias("start"), F.lit("").alias("text"), F.lit(0).alias("n"))).otherwise(
                F.struct(s["out"].alias("out"), now["start"].alias("start"), now["text"].alias("text"), now["n"].alias("n"))
            )

        return bound(F.struct(start.alias("start"), F.concat(s["text"], x["word"]).alias("text"), (s["n"] + 1).alias("n"), F.coalesce(closes, F.lit(False)).alias("closes")), after)

    folded = rows.select(*keys, F.posexplode(F.aggregate(paired, state, step)["out"]).alias("piece", "p"))
    return folded.select(*keys, "piece", "p.start", "p.end", "p.text", "p.n")


def split_at_samples(rows: DataFrame, proposals: DataFrame, key: str, start: str, end: str, source_start: str, source_end: str, shortest: float = 0.05) -> DataFrame:
    """Rows after their proposals (key, sample, source): one moves the row's source, several split it halfway between their samples.

    The source of one proposal is where the row starts; that of several is where the sample lies. Pieces no longer than
    ``shortest`` are dropped; ``piece`` counts a row's proposals from 1 and is 0 for rows as they were.
    """
    w = Window.partitionBy(key).orderBy("sample")
    p = proposals.withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("piece", F.row_number().over(w))
    p = p.withColumn("left", (F.col("sample") + F.lag("sample").over(w)) / 2).withColumn("right", (F.col("sample") + F.lead("sample").over(w)) / 2)
    out = rows.join(p, key, "left")
    lo, hi = F.coalesce("left", start), F.coalesce("right", end)
    one, many, length = F.col("n") == 1, F.col("n") > 1, F.col(source_end) - F.col(source_start)
    at = F.when(many, F.greatest(F.lit(0.0), F.col("source") - (F.col("sample") - lo))).when(one & (length > 0), F.col("source")).otherwise(F.col(source_start))
    out = out.where(F.coalesce(~many | (hi - lo > shortest), F.lit(True)))
    until = F.when(many, at + (hi - lo)).when(one & (length > 0), at + length).otherwise(F.col(source_end))
    return out.select(key, F.coalesce("piece", F.lit(0)).alias("piece"), F.when(many, lo).otherwise(F.col(start)).alias(start), F.when(many, hi).otherwise(F.col(end)).alias(end), at.alias(source_start), until.alias(source_end))
