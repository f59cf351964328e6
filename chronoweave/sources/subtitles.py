"""SRT and ASS files as rows (path, index, start, end, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import clean_ass, clean_srt
from chronoweave.functions.timecode import parse_clock, srt

#: Encodings tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "big5", "latin-1")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files; bytes that aren't UTF-8 fall back to the other encodings, one Arrow batch at a time."""
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for name in ENCODINGS:
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue
            return ""

        return raw.map(one)

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("content"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Blocks with a time line, with or without a number before it; blocks without text or of no length are left out; sorted places count from 1."""
    unix = F.regexp_replace("content", "\r\n?", "\n")
    block = files.select("path", F.posexplode(F.split(unix, r"\n\s*\n")).alias("at", "block"))
    arrow = r"(?m)^\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+)"
    text = F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1)
    rows = block.where(F.col("block").rlike(arrow)).select("path", "at", parse_clock(F.regexp_extract("block", arrow, 1)).alias("start"), parse_clock(F.regexp_extract("block", arrow, 2)).alias("end"), clean_srt(F.regexp_replace(text, "\n", " ")).alias("text"))
    return _numbered(rows.where("end > start and text <> ''"))


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines, ten fields each, of which the last is text."""
    line = files.select("path", F.posexplode(F.split("content", "\r\n?|\n")).alias("at", "line")).where(F.col("line").startswith("Dialogue:"))
    part = F.split(F.regexp_replace("line", "^Dialogue:\\s*", ""), ",", 10)
    rows = line.where(F.size(part) == 10).select("path", "at", parse_clock(part[1]).alias("start"), parse_clock(part[2]).alias("end"), clean_ass(part[9]).alias("text"))
    return _numbered(rows.where("end > start and length(text) >= 2"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("path").orderBy("start", "at"))).select("path", "index", "start", "end", "text")


def write_srt(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, content): rows (key, order, start, end, text) of a key as one SRT text."""
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "start", "end", "text"))).alias("r"))
    block = F.transform("r", lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(srt(x["start"]), F.lit(" --> "), srt(x["end"])), x["text"], F.lit("")))
    return rows.select(key, F.array_join(block, "\n").alias("content"))
