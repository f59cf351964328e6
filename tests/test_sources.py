"""Files written and read back, and the streaming twins against their batch forms."""

import json

from pyspark.sql import functions as F

from chronoweave.functions.timecode import parse_clock, srt
from chronoweave.operators.intervals import merge_ranges
from chronoweave.sources import documents as D
from chronoweave.sources import subtitles as S
from chronoweave.streaming import windows as W

SF = "/root/testdata/sf0.001"


def test_srt_blocks(spark, tmp_path):
    text = "1\r\n00:00:01,500 --> 00:00:02.250\r\n<i>Hello</i>\r\nthere\r\n\r\n00:00:00,5 --> 00:00:01,0\nNo number\n\n3\n00:00:05,000 --> 00:00:05,000\nNo length\n\n4\nbad\n\n"
    (tmp_path / "a.srt").write_text(text)
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好\n".encode("gbk"))
    rows = [(r["path"][-5:], r["index"], r["start"], r["end"], r["text"]) for r in S.parse_srt(S.read_texts(spark, f"{tmp_path}/*.srt")).orderBy("path", "index").collect()]
    assert rows == [("a.srt", 1, 0.5, 1.0, "No number"), ("a.srt", 2, 1.5, 2.25, "Hello there"), ("b.srt", 1, 1.0, 2.0, "你好")]


def test_ass_lines(spark, tmp_path):
    (tmp_path / "a.ass").write_text("[Script Info]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\i1}Two, parts\\Nhere\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,x\nDialogue: bad\n")
    rows = [tuple(r)[1:] for r in S.parse_ass(S.read_texts(spark, f"{tmp_path}/*.ass")).collect()]
    assert rows == [(1, 1.5, 2.0, "Two, parts here")]


def test_srt_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, i * 1.5, i * 1.5 + 1, f"line {i}") for i in range(5)], "p bigint, n bigint, start double, end double, text string")
    out = S.write_srt(rows, "p", "n")
    back = S.parse_srt(out.select(F.lit("x").alias("path"), "content")).orderBy("index").collect()
    assert [(r["start"], r["end"], r["text"]) for r in back] == [(i * 1.5, i * 1.5 + 1, f"line {i}") for i in range(5)]


def test_time_codes(spark):
    r = spark.range(1).select(srt(F.lit(3661.0005)).alias("a"), parse_clock(F.lit("1:02:03,5")).alias("b"), parse_clock(F.lit("12:30")).alias("c"), parse_clock(F.lit("x")).alias("d")).first()
    assert tuple(r) == ("01:01:01,000", 3723.5, 750.0, None)


def test_manifest_and_draft(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "m", "project_id": "p", "defaults": {"iou_threshold": 0.7}, "segments": [{"segment_id": "a", "scenario": "s", "label": "movie", "movie_start": 1.0, "movie_end": 2.0}, {"segment_id": "b", "iou_threshold": 0.9}]}))
    rows = D.read_manifest(spark, f"{tmp_path}/m.json").orderBy("segment_id").collect()
    assert [(r["segment_id"], r["iou_threshold"], r["boundary_tolerance"]) for r in rows] == [("a", 0.7, 1.5), ("b", 0.9, 1.5)]
    ranges = spark.createDataFrame([(1, 0.0, 1.5, 10.0, 13.0), (1, 1.5, 2.0, 20.0, 20.5)], "p bigint, target_start double, target_end double, source_start double, source_end double")
    (tmp_path / "d.json").write_text(D.draft_json(ranges, "p").first()["content"])
    assert [tuple(r) for r in D.read_draft(spark, f"{tmp_path}/d.json").collect()] == [tuple(r)[1:] for r in ranges.collect()]


def test_upsert_keeps_what_the_patch_leaves_out(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id bigint, name string, v double")
    patch = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "id bigint, name string, v double")
    assert sorted(tuple(r) for r in D.upsert(old, patch, "id").collect()) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]


def test_touching_ranges_merge(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 4.0)], "g bigint, a double, b double")
    assert sorted((r["a"], r["b"]) for r in merge_ranges(rows, ["g"], "a", "b").collect()) == [(0.0, 2.0), (3.0, 4.0)]


def streamed(spark, tmp_path, fn, name, mode="append"):
    """All rows that ``fn`` gives over the events as a stream of four files."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    last = events.agg(F.max("ts")).first()[0]
    spark.createDataFrame([(10**9, last.replace(year=last.year + 1), -1, "end", 0.0, "{}")], events.schema).write.parquet(f"{tmp_path}/end")
    spark.read.parquet(f"{tmp_path}/end").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = fn(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return events, spark.table(name)


def test_session_windows_stream_as_in_batch(spark, tmp_path):
    events, got = streamed(spark, tmp_path, W.task_sessions, "sessions_out")
    want = W.task_sessions(events)
    key = lambda df: sorted((r["user_id"], r["start"], r["n"], round(r["total"], 6)) for r in df.collect() if r["user_id"] >= 0)
    assert key(got) == key(want)


def test_changes_are_kept_by_state(spark, tmp_path):
    events, got = streamed(spark, tmp_path, W.consecutive_changes, "changes_out")
    rows = sorted((r["user_id"], r["ts"], r["event_type"]) for r in events.collect())
    want, last = 0, {}
    for user, _, kind in rows:
        want += last.get(user) != kind
        last[user] = kind
    assert got.where("user_id >= 0").count() == want
