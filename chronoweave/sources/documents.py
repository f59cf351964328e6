"""Project, manifest and draft JSON as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name STRING, project_id STRING, defaults STRUCT<iou_threshold: DOUBLE, boundary_tolerance: DOUBLE>, segments ARRAY<STRUCT<segment_id: STRING, index: INT, scenario: STRING, label: STRING, movie_start: DOUBLE, movie_end: DOUBLE, iou_threshold: DOUBLE, boundary_tolerance: DOUBLE, notes: STRING>>"
DRAFT = "tracks ARRAY<STRUCT<type: STRING, segments: ARRAY<STRUCT<target_timerange: STRUCT<start: BIGINT, duration: BIGINT>, source_timerange: STRUCT<start: BIGINT, duration: BIGINT>, speed: DOUBLE>>>>"


def list_files(spark: SparkSession, directory: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(name, path, size, modified) of a directory's own files, newest first; with ``extensions``, those that end in one of them in whatever case. Contents are not read."""
    files = spark.read.format("binaryFile").load(directory).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    kept = files.where(F.concat(F.lit("."), F.lower(F.element_at(F.split("name", r"\."), -1))).isin(wanted)) if wanted else files
    return kept.orderBy(F.desc("modified"), "name")


def read_projects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole project files, a row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def list_projects(projects: DataFrame) -> DataFrame:
    """Listing, newest first."""
    return projects.select("id", "name", "updated_at", F.size("segments").alias("segment_count")).orderBy(F.desc("updated_at"), "id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows with the manifest's defaults filled in."""
    m = spark.read.option("multiLine", True).schema(MANIFEST).json(path).select("name", "project_id", "defaults", F.explode("segments").alias("s"))
    fill = lambda k, last: F.coalesce(F.col(f"s.{k}"), F.col(f"defaults.{k}"), F.lit(last)).alias(k)
    return m.select("name", "project_id", "s.segment_id", "s.index", "s.scenario", "s.label", "s.movie_start", "s.movie_end", fill("iou_threshold", 0.8), fill("boundary_tolerance", 1.5))


def read_draft(spark: SparkSession, path: str) -> DataFrame:
    """Video segments of a draft in seconds, by target start; source length defaults to target length times speed; empty ones are left out."""
    d = spark.read.option("multiLine", True).schema(DRAFT).json(path).select(F.explode("tracks").alias("t")).where("t.type = 'video'").select(F.explode("t.segments").alias("s"))
    us = 1_000_000.0
    length = F.coalesce(F.col("s.source_timerange.duration").cast("double"), F.col("s.target_timerange.duration") * F.coalesce("s.speed", F.lit(1.0)))
    start, source = F.col("s.target_timerange.start") / us, F.coalesce(F.col("s.source_timerange.start"), F.lit(0)) / us
    out = d.select(start.alias("target_start"), (start + F.col("s.target_timerange.duration") / us).alias("target_end"), source.alias("source_start"), (source + length / us).alias("source_end"))
    return out.where("target_end > target_start and source_end > source_start").orderBy("target_start")


def draft_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): rows (target_start, target_end, source_start, source_end) of a key as a draft with one video track, in whole microseconds."""
    us = lambda c: (F.col(c) * 1_000_000).cast("long")
    span = lambda a, b: F.struct(us(a).alias("start"), (us(b) - us(a)).alias("duration"))
    seg = rows.select(key, F.struct(span("target_start", "target_end").alias("target_timerange"), span("source_start", "source_end").alias("source_timerange")).alias("s"))
    return seg.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("segments")).select(key, F.to_json(F.struct(F.array(F.struct(F.lit("video").alias("type"), F.col("segments"))).alias("tracks"))).alias("content"))


def upsert(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``patch`` rows of the same key; keys only in ``patch`` are added."""
    both = old.alias("o").join(patch.alias("p"), F.col(f"o.{key}") == F.col(f"p.{key}"), "full")
    pick = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")) if c in patch.columns else F.col(f"o.{c}")
    return both.select(*[pick(c).alias(c) for c in old.columns])
