import math
import os

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.sources import documents as D
from chronoweave.streaming import windows as W


def test_files_by_extension_newest_first(spark, tmp_path):
    for i, name in enumerate(("a.MP4", "b.srt", "c.mp4", "d.mkv", "noext")):
        (tmp_path / name).write_bytes(b"x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    got = D.list_files(spark, str(tmp_path), ("mp4", ".mkv"))
    assert [(r["name"], r["size"]) for r in got.collect()] == [("d.mkv", 4), ("c.mp4", 3), ("a.MP4", 1)]
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert D.list_files(spark, str(tmp_path)).count() == 5 and D.list_files(spark, str(tmp_path), ("avi",)).count() == 0


def test_projects_are_listed_newest_first(spark, tmp_path):
    for name, at, n in (("p1", "2024-01-02", 2), ("p2", "2024-03-01", 0), ("p3", "2024-01-02", 1)):
        segments = ", ".join('{"id": "s"}' for _ in range(n))
        (tmp_path / f"{name}.json").write_text(f'{{\n "id": "{name}",\n "name": "N",\n "updated_at": "{at}",\n "segments": [{segments}]\n}}')
    schema = "id string, name string, updated_at string, segments array<struct<id:string>>"
    got = D.list_projects(D.read_projects(spark, str(tmp_path), schema)).collect()
    assert [(r["id"], r["segment_count"]) for r in got] == [("p2", 0), ("p1", 2), ("p3", 1)]


def test_repeats_within_the_watermark_go(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:0{i}:00") for i in range(9)]
    df = spark.createDataFrame(rows, "k int, at string").select("k", F.to_timestamp("at").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = W.without_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"])
    run = stream.writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["k"] for r in spark.table("repeats").collect()) == [0, 1, 2]


@pytest.mark.parametrize(("values", "want"), [([1.0, 3.0], [-1 / math.sqrt(2), 1 / math.sqrt(2)]), ([2.0, 2.0, 2.0], [0, 0, 0]), ([0.0, 0.0, 3.0], [-1 / math.sqrt(6), -1 / math.sqrt(6), 2 / math.sqrt(6)])])
def test_z_normalized(spark, values, want):
    got = spark.createDataFrame([(values,)], "v array<double>").select(V.z_normalized(F.col("v"))).first()[0]
    assert got == pytest.approx(want)
