"""Recurrences over a project's ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scoring as S
from chronoweave.functions import vectors as V
from chronoweave.operators import sequence as Q
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col


def _anchors(spark, sf_dir) -> DataFrame:
    """All anchors of a project."""
    s = segments(spark, sf_dir).where("movie_start is not null")
    return s.select("project", "id", "start", F.round("movie_start", 3).alias("movie"), "visual")


def lis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.increasing_subset(_anchors(spark, sf_dir), "project", "start", "movie", "visual", "id").groupBy("project").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def anchor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.anchor_chain(_anchors(spark, sf_dir), "project", "start", "movie", "visual", "id").groupBy("project").agg(F.max("score").alias("score"))


def _place() -> Column:
    """Where a segment's candidate starts in the source."""
    return c("start") * 3 + F.element_at(F.array(F.lit(0.0), c("gap") * 8 - 20, c("temporal") * 60 - 30), F.coalesce("cand", F.lit(0)).cast("int") + 1)


def _choices(s: DataFrame, *keys: str) -> DataFrame:
    """Three candidates of each segment and the choice of none."""
    cand = s.withColumn("cand", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(None).cast("int"))))
    start = _place()
    node = F.when(c("cand").isNull(), S.skip_score(c("visual"), c("kind") == "non_movie")).otherwise(F.round(c("visual") - 0.1 * c("cand") + c("stability") / 10, 6))
    rows = cand.select(*keys, c("idx").cast("long").alias("segment"), c("cand").cast("long").alias("cand"), c("start").alias("n_start"), (c("start") + c("dur")).alias("n_end"), start.alias("s_start"), (start + c("dur")).alias("s_end"), node.alias("node"))
    return rows.withColumn("s_start", F.when(c("cand").isNotNull(), c("s_start"))).withColumn("s_end", F.when(c("cand").isNotNull(), c("s_end")))


def viterbi_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of a project, with three candidates each and the choice of none."""
    return Q.viterbi(_choices(segments(spark, sf_dir), "project"), "project", "segment")


def rematched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weak segment chosen again within the two before and the two behind it, and whether the choice moves its source by more than 0.2."""
    s = segments(spark, sf_dir)
    weak = s.where("visual < 0.1").select("project", "id", c("idx").alias("at"))
    near = weak.withColumn("idx", F.explode(F.sequence(c("at") - 2, c("at") + 2)))
    window = near.join(s.drop("id"), ["project", "idx"])
    picked = Q.viterbi(_choices(window, "id"), "id", "segment").join(weak, "id").where("segment = at")
    moved = picked.select("id", "cand").join(s.select("id", "movie_start", "start", "gap", "temporal"), "id").withColumn("s_start", _place())
    gone = c("cand").isNull()
    return moved.select("id", "cand", F.when(gone, c("movie_start").isNotNull()).otherwise(c("movie_start").isNull() | (F.abs(c("s_start") - c("movie_start")) > 0.2)).alias("moved"))


def smith_waterman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shot of 40 rows against its re-edit: its halves in turn, with up to three bits of each hash changed."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.floor(c("vec_id") / 40).alias("shot"), "vec_id", V.sign_bits(c("embedding")).alias("h"))
    flip = lambda k: F.expr(f"shiftleft(1L, cast(vec_id * {k} % 60 as int))")
    edit = e.select("shot", (c("shot") * 40 + (c("vec_id") + 20) % 40).alias("vec_id"), c("h").bitwiseXOR(flip(1)).bitwiseXOR(flip(7)).bitwiseXOR(flip(11)).alias("h"))
    return Q.local_alignment(e, edit, "shot", "vec_id", "h")


def dtw_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("movie_start is not null").select("project", "start", (c("movie_start") / 3).alias("movie"))
    return Q.warp_speed(s, "project", "start", "movie")


QUERIES = {f.__name__: f for f in (lis_filter, anchor_chain, viterbi_align, rematched_rows, smith_waterman, dtw_speed)}

_ROWS = f"{SEGMENT_SQL}, a AS (SELECT project, id, start, round(movie_start, 3) AS movie, visual FROM seg WHERE movie_start IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start, id) AS rn FROM a)"


def _chain_sql(first: str, gain: str, follows: str, out: str, least: int) -> str:
    """Row by row: the best sum that ends in each row so far, its value, and its length."""
    reach = f"list_transform(range(1, len(f.best) + 1), lambda i: CASE WHEN {follows} THEN f.best[i] + {gain} ELSE -1e9 END)"
    return f"""WITH RECURSIVE {_ROWS},
f AS (SELECT project, 1::BIGINT AS rn, [({first})::DOUBLE] AS best, [movie] AS vals, [1::BIGINT] AS lens FROM o WHERE rn = 1
 UNION ALL SELECT f.project, o.rn, list_append(f.best, greatest(({first})::DOUBLE, y.reach)), list_append(f.vals, o.movie), list_append(f.lens, CASE WHEN y.reach > {first} THEN f.lens[y.at] + 1 ELSE 1 END)
 FROM f JOIN o ON o.project = f.project AND o.rn = f.rn + 1, LATERAL (SELECT {reach} AS r) AS x, LATERAL (SELECT list_max(x.r) AS reach, list_position(x.r, list_max(x.r)) AS at) AS y),
l AS (SELECT project, arg_max(best, rn) AS best, arg_max(lens, rn) AS lens FROM f GROUP BY project)
SELECT project, {out} FROM l WHERE lens[list_position(best, list_max(best))] >= {least}"""


ORACLES = {
    "lis_filter": _chain_sql("1", "(1 + 0.1e0 * o.visual)", "f.vals[i] < o.movie", "lens[list_position(best, list_max(best))] AS n, round(list_max(best), 6) AS score", 1),
    "anchor_chain": _chain_sql("visual", "o.visual", "f.vals[i] - 5 <= o.movie", "round(list_max(best), 6) AS score", 3),
}
