"""Candidate scores, statuses and predicates over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import scoring as S
from chronoweave.plans.bindings import SEGMENT_SQL, segments

c = F.col
R6 = lambda x: F.round(x, 6)


def _audio_weight() -> object:
    return S.audio_weight(c("kind"), F.when(c("audio") < 0.2, "silent").when(c("audio") < 0.4, "weak").otherwise("active"), c("temporal"))


def candidate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("id", R6(S.candidate_confidence(c("visual"), c("temporal"), c("dur"), c("gap"), c("rank_gap"), c("audio"), c("stability"), _audio_weight())).alias("confidence"))


_AUDIO_SQL = """CASE WHEN kind = 'no_narration' THEN 0.32e0 WHEN audio < 0.2 THEN 0.18e0 WHEN audio < 0.4 THEN 0.24e0
  WHEN temporal >= 0.72 THEN 0.08e0 WHEN temporal >= 0.42 THEN 0.12e0 ELSE 0.18e0 END"""
_CONF_SQL = f"""
w AS (SELECT *, {_AUDIO_SQL} AS aw, 0.84 * visual + 0.04 * greatest(0e0, 1 - gap / greatest(dur, 1e0)) + 0.08 * stability + 0.04 * temporal AS s0 FROM seg),
w1 AS (SELECT *, s0 + CASE WHEN temporal < 0.35 AND visual < 0.9 THEN -least(0.10e0, (0.35 - temporal) * 0.18) WHEN temporal > 0.82 THEN least(0.04e0, (temporal - 0.82) * 0.2) ELSE 0 END
  + CASE WHEN rank_gap < 0.015 AND visual < 0.92 THEN -least(0.10e0, (0.015 - rank_gap) * 4) WHEN rank_gap > 0.08 THEN least(0.04e0, (rank_gap - 0.08) * 0.5) ELSE 0 END AS s1 FROM w),
w2 AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN audio > 0.15 THEN s1 * (1 - aw / 2) + audio * aw / 2 ELSE s1 END)) AS s2 FROM w1),
conf AS (SELECT *, CASE WHEN s2 >= 0.85 THEN 1 - power(1 - s2, 1.5e0) ELSE s2 END AS confidence FROM w2)"""


def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    out = S.calibrated_confidence(c("visual"), c("id") % 5 == 0, c("id") % 2 == 1, F.least(c("visual") + 0.6, F.lit(1.0)), F.lit(0.8) + c("temporal") / 5, F.lit(0.85) + c("stability") / 8, c("gap"), c("dur"))
    return s.select("id", R6(out).alias("shown"))


def temporal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("movie_start is not null")
    return s.select("id", R6(S.temporal_confidence(c("movie_start") + c("dur") / 2, c("start") * 3, c("dur"))).alias("temporal_confidence"))


def weak_segments_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    weak = s.where(S.rerank_priority_weak(c("movie_start").isNull(), c("id") % 11 == 0, F.lit("matched"), F.lit("exact"), c("visual"), c("stability")))
    return weak.select("id", R6(1 - c("visual") + 0.2 * (1 - c("stability"))).alias("priority")).orderBy(F.desc("priority"), "id").limit(100)


def speed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("ratio", F.round((0.5 + c("value") % 20 / 10) / c("dur"), 9))
    evidence = F.greatest(c("verify"), F.least(c("visual"), c("stability") + 0.10))
    changed = S.speed_changed(c("ratio"), evidence, c("verify"), c("stability"), c("idx"))
    return s.select("id", changed.alias("changed"), S.match_type(c("id") % 9 == 0, c("visual"), changed).alias("match_type"), R6(c("gap") / 2).alias("boundary_error"))


def alignment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    status = S.alignment_status(c("id") % 13 == 0, c("kind") == "non_movie", c("movie_start"), c("id") % 17 == 0, c("visual"), c("verify"))
    return s.select("id", status.alias("status"), R6(F.greatest(c("gap") / 2 + F.greatest(F.lit(0.0), 1 - c("stability")), F.lit(0.0))).alias("boundary_error"))


def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are a project's segments in groups of four; the first of a group is the one of highest score."""
    s = segments(spark, sf_dir).withColumn("grp", F.floor(c("idx") / 4))
    w = Window.partitionBy("project", "grp")
    first = w.orderBy(F.desc("visual"), "id")
    top = lambda x: F.first(x).over(first)
    s = s.select("id", "visual", "verify", "temporal", "rank_gap", "stability", "audio", F.max("visual").over(w).alias("best"), F.max("temporal").over(w).alias("best_t"), top("visual").alias("ts"), top("temporal").alias("tt"), top("verify").alias("tv"), (F.row_number().over(first) == 1).alias("is_top"))
    score = S.node_score(c("visual"), c("verify"), c("temporal"), c("rank_gap"), c("stability"), c("audio"), c("best"), c("best_t"), c("ts"), c("tt"), c("tv"), c("is_top"))
    return s.select("id", F.round(score + 1e-9, 6).alias("node"), R6(S.skip_score(c("best"), c("id") % 6 == 0)).alias("skip"))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    score, valid = S.validation_score(c("visual"), c("stability"), c("temporal"), c("gap"), c("gap") + c("audio") / 10)
    return s.select("id", R6(score).alias("score"), valid.alias("valid"))


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame and audio results of one segment: near ones are averaged, otherwise frames go first."""
    s = segments(spark, sf_dir)
    frame = s.where("id % 3 <> 0").select("id", c("start").alias("f_start"), c("visual").alias("f_conf"))
    audio = s.where("id % 4 <> 0").select("id", (c("start") + c("gap") * 2 - 4).alias("a_start"), c("audio").alias("a_conf"))
    both = frame.join(audio, "id", "full")
    near = F.abs(c("f_start") - c("a_start")) < 5
    wf = F.when((c("a_conf") < 0.3) & (c("f_conf") > 0.6), F.lit(0.9)).otherwise(F.lit(0.6))
    start = F.when(near, wf * c("f_start") + (1 - wf) * c("a_start")).otherwise(F.coalesce("f_start", "a_start"))
    conf = F.when(near, wf * c("f_conf") + (1 - wf) * c("a_conf")).otherwise(F.coalesce("f_conf", "a_conf"))
    return both.select("id", R6(start).alias("start"), R6(conf).alias("confidence"), F.when(near, "both").when(c("f_start").isNotNull(), "frame").otherwise("audio").alias("source"))


def narrator_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    db, active = c("audio") * 60 - 60, c("stability") / 2
    label = S.activity_label(db, active)
    kind = F.when(label == "silent", "no_narration").when((c("visual") >= 0.5) | (c("temporal") >= 0.72), "has_narration").when(label == "weak", "no_narration").otherwise("original_audio")
    return s.select("id", label.alias("activity"), R6(S.speech_likelihood(db, active)).alias("speech"), kind.alias("narrator"))


def audit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("id", R6(S.audit_calibration(c("visual"), c("audio") / 2)).alias("score"))


def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("id", R6(S.search_radius(c("dur"), 1.0)).alias("radius"), R6(S.search_radius(c("dur"), 1.0, True)).alias("radius_relaxed"), R6(S.hint_window(c("dur"), True, False)).alias("strict"), R6(S.hint_window(c("dur"), False, False)).alias("wide"))


def signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals for one entry fused: time weighted by weight and confidence, the strongest names the source."""
    s = segments(spark, sf_dir).where("movie_start is not null")
    weight = F.element_at(F.create_map(*[x for k, v in (("view", 0.4), ("click", 0.3), ("purchase", 0.2)) for x in (F.lit(k), F.lit(v))]), c("event_type"))
    s = s.withColumn("w", F.coalesce(weight, F.lit(0.1))).withColumn("grp", F.floor(c("idx") / 4)).withColumn("wc", c("w") * (c("visual") + 0.01))
    return s.groupBy("project", "grp").agg(F.round(F.sum(c("movie_start") * c("wc")) / F.sum("wc") + 1e-9, 6).alias("time"), F.round(F.sum("wc") / F.sum("w") + 1e-9, 6).alias("confidence"), F.max_by("event_type", F.struct(F.round("wc", 9), -c("idx"))).alias("source"))


QUERIES = {f.__name__: f for f in (candidate_confidence, calibrated_confidence, temporal_confidence, weak_segments_topn, speed_evidence, alignment_status, node_scores, validation, hybrid_fusion, narrator_type, audit_calibration, search_windows, signal_fusion)}

ORACLES = {
    "candidate_confidence": f"WITH {SEGMENT_SQL}, {_CONF_SQL} SELECT id, round(confidence, 6) AS confidence FROM conf",
    "calibrated_confidence": f"""WITH {SEGMENT_SQL},
x AS (SELECT id, visual AS raw, id % 5 = 0 AS review, id % 2 = 1 AS chunk, least(visual + 0.6, 1e0) AS v, 0.8 + temporal / 5 AS t, 0.85 + stability / 8 AS st, greatest(0e0, 1 - gap / greatest(dur, 0.5e0)) AS dc FROM seg),
y AS (SELECT *, 0.35 * v + 0.45 * st + 0.15 * t + 0.05 * dc AS s FROM x)
SELECT id, round(CASE WHEN NOT review AND chunk AND st >= 0.88 AND t >= 0.8 AND v >= 0.7
  THEN greatest(raw, least(0.995e0, CASE WHEN s >= 0.8 THEN 1 - power(greatest(0e0, 1 - s), 1.8e0) ELSE s END)) ELSE raw END, 6) AS shown FROM y""",
    "temporal_confidence": f"""WITH {SEGMENT_SQL} SELECT id, round(greatest(0e0, least(1e0, 1 - abs(movie_start + dur / 2 - start * 3) / greatest(120e0, 15 * dur, 1e0))), 6) AS temporal_confidence
FROM seg WHERE movie_start IS NOT NULL""",
    "weak_segments_topn": f"""WITH {SEGMENT_SQL} SELECT id, round(1 - visual + 0.2 * (1 - stability), 6) AS priority FROM seg
WHERE movie_start IS NULL OR id % 11 = 0 OR visual < 0.78 OR (stability > 0 AND stability < 0.7) ORDER BY priority DESC, id LIMIT 100""",
    "speed_evidence": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, round((0.5 + value % 20 / 10) / dur, 9) AS ratio, greatest(verify, least(visual, stability + 0.10)) AS ev FROM seg),
y AS (SELECT *, ratio BETWEEN 0.5 AND 2.0 AND abs(ratio - 1) >= 0.08 AND ev >= 0.7 AND (verify >= 0.68 OR (stability >= 0.68 AND idx >= 3)) AS changed FROM x)
SELECT id, changed, CASE WHEN id % 9 = 0 OR visual < 0.78 THEN 'inferred' WHEN changed THEN 'speed_changed' ELSE 'exact' END AS match_type, round(gap / 2, 6) AS boundary_error FROM y""",
    "alignment_status": f"""WITH {SEGMENT_SQL} SELECT id, CASE WHEN id % 13 = 0 THEN 'skipped' WHEN kind = 'non_movie' THEN 'non_movie' WHEN movie_start IS NULL THEN 'unmatched'
  WHEN id % 17 = 0 THEN 'manual' WHEN visual >= 0.82 AND verify >= 0.85 THEN 'auto_accepted' ELSE 'needs_review' END AS status,
  round(greatest(gap / 2 + greatest(0e0, 1 - stability), 0e0), 6) AS boundary_error FROM seg""",
    "node_scores": f"""WITH {SEGMENT_SQL}, g AS (SELECT *, idx // 4 AS grp FROM seg),
x AS (SELECT *, max(visual) OVER p AS best, max(temporal) OVER p AS bt, first(visual) OVER o AS ts, first(temporal) OVER o AS tt, first(verify) OVER o AS tv, row_number() OVER o AS rn FROM g
  WINDOW p AS (PARTITION BY project, grp), o AS (PARTITION BY project, grp ORDER BY visual DESC, id)),
y AS (SELECT *, best - visual AS g FROM x)
SELECT id, round(visual + CASE WHEN visual >= 0.92 THEN 0.06 * least(1e0, (visual - 0.92) / 0.08) WHEN visual >= 0.85 THEN 0.03 * (visual - 0.85) / 0.07 ELSE 0 END
 + least(0.10e0, 0.12 * verify) + least(0.12e0, 0.16 * temporal) + least(0.05e0, 2.5 * rank_gap) + least(0.08e0, 0.1 * stability)
 + CASE WHEN temporal >= 0.65 THEN 0.04 WHEN temporal >= 0.35 THEN 0.02 ELSE 0 END + CASE WHEN verify >= 0.55 THEN 0.03 ELSE 0 END
 - CASE WHEN temporal < 0.08 AND verify < 0.42 THEN 0.18 WHEN temporal < 0.16 AND rank_gap < 0.01 AND verify < 0.40 THEN 0.08 ELSE 0 END
 - CASE WHEN g > 0.08 THEN least(0.32e0, 2.8 * g) WHEN g > 0.03 THEN least(0.16e0, 1.9 * g) ELSE 0 END
 - CASE WHEN bt >= 0.35 AND temporal + 0.20 < bt THEN 0.06 ELSE 0 END
 - CASE WHEN rn = 1 THEN 0 ELSE CASE WHEN g > 0.08 AND tt + 0.05 >= temporal THEN 0.12 ELSE 0 END + CASE WHEN tt >= temporal + 0.20 THEN 0.10 ELSE 0 END + CASE WHEN tv >= verify + 0.08 AND g > 0.04 THEN 0.06 ELSE 0 END END
 - CASE WHEN verify < 0.38 THEN least(0.10e0, 0.2 * (0.38 - verify)) ELSE 0 END - CASE WHEN rank_gap < 0.0025 THEN least(0.06e0, 12 * (0.0025 - rank_gap)) ELSE 0 END - least(0.10e0, 0.12 * audio) + 1e-9, 6) AS node,
 round(CASE WHEN id % 6 = 0 THEN 0.05 ELSE -2 - least(0.4e0, 0.35 * best) END, 6) AS skip FROM y""",
    "validation": f"""WITH {SEGMENT_SQL}, x AS (SELECT id, visual AS f, stability AS b, greatest(0e0, 1 - temporal / (1 + 1e-6)) AS tc,
 greatest(0e0, 1 - abs(gap - (gap + audio / 10)) / (greatest(gap, gap + audio / 10, 1e-6) * 0.15)) AS dc FROM seg)
SELECT id, round(0.25 * (f + b + tc + dc), 6) AS score, 0.25 * (f + b + tc + dc) >= 0.5 AND tc >= 0.5 AND dc >= 0.5 AS valid FROM x""",
    "hybrid_fusion": f"""WITH {SEGMENT_SQL}, f AS (SELECT id, start AS fs, visual AS fc FROM seg WHERE id % 3 <> 0), a AS (SELECT id, start + gap * 2 - 4 AS s2, audio AS ac FROM seg WHERE id % 4 <> 0),
b AS (SELECT id, fs, fc, s2, ac, coalesce(abs(fs - s2) < 5, false) AS near, CASE WHEN ac < 0.3 AND fc > 0.6 THEN 0.9e0 ELSE 0.6e0 END AS wf FROM f FULL JOIN a USING (id))
SELECT id, round(CASE WHEN near THEN wf * fs + (1 - wf) * s2 ELSE coalesce(fs, s2) END, 6) AS start, round(CASE WHEN near THEN wf * fc + (1 - wf) * ac ELSE coalesce(fc, ac) END, 6) AS confidence,
 CASE WHEN near THEN 'both' WHEN fs IS NOT NULL THEN 'frame' ELSE 'audio' END AS source FROM b""",
    "narrator_type": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, audio * 60 - 60 AS db, stability / 2 AS act FROM seg),
y AS (SELECT *, CASE WHEN db < -48 OR act < 0.04 THEN 'silent' WHEN db < -36 OR act < 0.12 THEN 'weak' ELSE 'active' END AS label FROM x)
SELECT id, label AS activity, round(0.4 * greatest(0e0, least(1e0, (db + 48) / 24)) + 0.6 * least(1e0, act / 0.35), 6) AS speech,
 CASE WHEN label = 'silent' THEN 'no_narration' WHEN visual >= 0.5 OR temporal >= 0.72 THEN 'has_narration' WHEN label = 'weak' THEN 'no_narration' ELSE 'original_audio' END AS narrator FROM y""",
    "audit_calibration": f"""WITH {SEGMENT_SQL} SELECT id, round(greatest(greatest(0e0, least(1e0, (visual - 0.46) / 0.28)), CASE WHEN visual >= 0.72 THEN 0.985e0 WHEN visual >= 0.66 THEN 0.955e0 WHEN visual >= 0.6 THEN 0.9e0 ELSE 0e0 END, audio / 2), 6) AS score FROM seg""",
    "search_windows": f"""WITH {SEGMENT_SQL} SELECT id, round(CASE WHEN dur <= 1.15 THEN 0.7e0 WHEN dur <= 2.2 THEN 0.95e0 ELSE 2e0 END, 6) AS radius, 3e0 AS radius_relaxed,
 round(greatest(3 * dur, CASE WHEN dur <= 3.5 THEN 45e0 ELSE 60e0 END), 6) AS strict, round(greatest(8 * dur, 180e0), 6) AS wide FROM seg""",
    "signal_fusion": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 0.4e0 WHEN 'click' THEN 0.3e0 WHEN 'purchase' THEN 0.2e0 ELSE 0.1e0 END AS w, idx // 4 AS grp FROM seg WHERE movie_start IS NOT NULL),
y AS (SELECT *, w * (visual + 0.01) AS wc FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY project, grp ORDER BY round(wc, 9) DESC, idx) AS rn FROM y)
SELECT project, grp, round(sum(movie_start * wc) / sum(wc) + 1e-9, 6) AS time, round(sum(wc) / sum(w) + 1e-9, 6) AS confidence, max(event_type) FILTER (rn = 1) AS source FROM z GROUP BY project, grp""",
}
