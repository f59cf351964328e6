"""From raw speech rows to rows fit for editing: split, merged, snapped to scenes, capped, cleaned."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import refine as R
from chronoweave.operators.scans import joined, ordered_scan

#: Least and greatest seconds of a row, gap over which short ones merge, reach of a scene's border, marks that end a sentence: fixed values.
SHORT, LONG, MERGE_GAP, SNAP, ENDINGS = 1.2, 8.0, 0.35, 0.4, "。！？!?；;…"
#: Kinds of rows that may have no text.
SILENT = ("non_movie", "no_narration")
BLANK = " \t\n\r"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def sentences(text: Column) -> Column:
    """The text cut behind each ending mark; one empty piece for no text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"[^{ENDINGS}]*[{ENDINGS}]|[^{ENDINGS}]+"), 0))


def evenly(text: Column, parts: Column) -> Column:
    """The text in runs of equal length, as many as ``parts`` or fewer; as many empty ones for no text."""
    step = F.greatest(F.lit(1), F.ceil(F.length(text) / parts)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int")), lambda i: F.substring(text, i * step + 1, step))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(""), parts)).otherwise(runs)


def _timed(rows: DataFrame, pieces: Column, row: list[str], place: str, start: str, end: str, text: str) -> DataFrame:
    """Rows cut into ``pieces``, counted by ``place``, which share the time by their lengths; a blank piece counts as one character."""
    others = [c for c in rows.columns if c not in (start, end, text)]
    each = rows.withColumn("__pieces", pieces).select(*others, F.col(start).alias("__s"), F.col(end).alias("__e"), F.posexplode("__pieces").alias(place, "__p")).withColumn("__p", _bare(F.col("__p")))
    each = each.withColumn("__weight", F.greatest(F.lit(1), F.length("__p")))
    whole = Window.partitionBy(*row)
    each = each.withColumn("__total", F.sum("__weight").over(whole)).withColumn("__last", F.max(place).over(whole)).withColumn("__until", F.sum("__weight").over(whole.orderBy(place)))
    at = lambda upto: F.col("__s") + (F.col("__e") - F.col("__s")) * (upto / F.col("__total"))
    return each.select(*others, place, at(F.col("__until") - F.col("__weight")).alias(start), F.when(F.col(place) == F.col("__last"), F.col("__e")).otherwise(at(F.col("__until"))).alias(end), F.col("__p").alias(text))


def split_by_text(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Rows without word times (told apart by ``keys``) cut into sentences; rows without length go, one sentence within ``LONG`` stays."""
    bare = rows.where(F.col(end) > F.col(start)).withColumn(text, _bare(F.coalesce(F.col(text), F.lit(""))))
    return _timed(bare, sentences(F.col(text)), keys, "piece", start, end, text)


def _merge(a, b):
    return a._replace(end=b.end, text=(a.text + b.text).strip(BLANK))


def _merges(a, b) -> bool:
    short = a.end - a.start < SHORT or b.end - b.start < SHORT
    return a.kind == b.kind and max(0.0, b.start - a.end) <= MERGE_GAP and short and b.end - a.start <= LONG


def merged_short(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, place, start, end, kind, text): short neighbours of one kind merged over small gaps, within ``LONG`` seconds; what was merged is judged anew."""

    def scan(it: Iterable) -> Iterator[tuple]:
        return ((place, r.start, r.end, r.kind, r.text) for place, r in enumerate(joined(it, _merges, _merge)))

    return ordered_scan(rows.select(key, *order, "start", "end", "kind", F.coalesce("text", F.lit("")).alias("text")), [key], order, scan, "place bigint, start double, end double, kind string, text string")


def capped(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Rows (told apart by ``keys``) longer than ``LONG`` cut into sentences, or evenly where there are too few, counted by ``part``; others are part 0."""
    length = F.col(end) - F.col(start)
    n = F.greatest(F.lit(2), F.ceil(length / LONG)).cast("int")
    cut = rows.withColumn("__n", n).withColumn("__by_text", sentences(F.col(text)))
    pieces = F.when(length <= LONG, F.array(text)).when(F.size("__by_text") < F.col("__n"), evenly(F.col(text), F.col("__n"))).otherwise(F.col("__by_text"))
    return _timed(cut, pieces, keys, "part", start, end, text).drop("__n", "__by_text")


def refined(rows: DataFrame, borders: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, id, start, end, kind, text) of raw rows (key, order, start, end, kind, text): split by text, merged, snapped to scene ``borders`` (key, at), capped and cleaned; ids count from seg_0000.

    Rows with word times go through ``refine.split_words`` first. Rows without text go unless their kind has none, and
    so do rows without length.
    """
    split = split_by_text(rows, [key, *order])
    whole = merged_short(split, key, [*order, "piece"])
    edges = R.snapped(whole, borders, key, "place", "start", "end", "at", SNAP)
    snapped = edges.join(whole.select(key, "place", "kind", "text"), [key, "place"])
    clean = capped(snapped, [key, "place"]).where(((F.col("text") != "") | F.col("kind").isin(*SILENT)) & (F.col("end") > F.col("start")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("place", "part")) - 1
    return clean.select(key, F.format_string("seg_%04d", number).alias("id"), "start", "end", "kind", "text")
