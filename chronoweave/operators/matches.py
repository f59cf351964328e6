"""What becomes of a row's match: cleared, shared out over the members of a chunk, put before its candidates; and how alike two frames are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.vectors import dot, z_normalized

#: Columns of a match: what they are without one. Fixed values.
NOTHING = {"movie_start": None, "movie_end": None, "match_confidence": 0.0, "visual_confidence": 0.0, "audio_confidence": 0.0, "temporal_confidence": 0.0, "stability_score": 0.0, "duration_gap": 0.0, "selected_candidate_id": None, "estimated_boundary_error": None, "speed_changed": False, "source_speed_ratio": 1.0, "speed_change_confidence": 0.0}
#: Confidence from which a shared-out match needs no review, temporal confidences of found and inferred ones, least source of a member.
ACCEPTED, TEMPORAL, LEAST_SHARE = 0.74, (0.92, 0.72), 0.05
#: Candidates that a row keeps behind a new one; shares of the two hashes (of 256 and 64 bits) and the histogram in a frame's score.
KEPT, FRAME_SHARES = 7, (0.35, 0.45, 0.20)


def _set(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns set where ``where`` holds; those that it doesn't have are left out."""
    return df.select(*[F.when(where, values[x].cast(df.schema[x].dataType)).otherwise(F.col(x)).alias(x) if x in values else F.col(x) for x in df.columns])


def cleared(df: DataFrame, where: Column, status: str, reason: str) -> DataFrame:
    """Rows that lose their match and get a status and a reason; unmatched ones and those to review are marked for it."""
    where = F.coalesce(where, F.lit(False))
    values = {k: F.lit(v) for k, v in NOTHING.items()}
    values |= {"match_reason": F.lit(reason), "evidence_summary": F.lit(reason), "alignment_status": F.lit(status), "review_required": F.lit(status in ("needs_review", "unmatched")), "match_type": F.lit("fallback" if status in ("unmatched", "skipped") else "inferred")}
    return _set(df, where, values)


def skipped(df: DataFrame, where: Column, reason: str = "Skipped from matching by user") -> DataFrame:
    """Rows that are no longer matched: cleared, without candidates, no manual match."""
    out = cleared(df.withColumn("__skips", F.coalesce(where, F.lit(False))), F.coalesce(where, F.lit(False)), "skipped", reason)
    return _set(out, F.col("__skips"), {"match_candidates": F.lit(None), "skip_matching": F.lit(True), "is_manual_match": F.lit(False)}).drop("__skips")


def reset(df: DataFrame, where: Column) -> DataFrame:
    """Rows as they were before any matching."""
    values = {k: F.lit(v) for k, v in NOTHING.items()}
    values |= {"match_reason": F.lit(""), "evidence_summary": F.lit(""), "match_type": F.lit("exact"), "alignment_status": F.lit("pending"), "review_required": F.lit(False), "is_manual_match": F.lit(False), "match_candidates": F.lit(None)}
    return _set(df, F.coalesce(where, F.lit(False)), values)


def shared_out(members: DataFrame, chunks: DataFrame, key: str, source_end: float = 0.0) -> DataFrame:
    """(key, id, s0, s1, duration_gap, temporal, status, review, match_type) for each member (key, id, t0, t1) of a matched chunk.

    ``chunks``: key, c0, c1 (its target), start, length (its source; null: as long as the target), confidence, inferred,
    speed_changed. A member takes the chunk's source from where it stands in the target, in its share of the length.
    Members without length and chunks without a start give nothing.
    """
    j = members.where("t1 > t0").join(chunks.where("start is not null"), key)
    target = F.greatest(F.lit(0.05), F.col("c1") - F.col("c0"))
    whole = F.when(F.col("length") > 0, F.greatest(F.lit(0.05), F.col("length"))).otherwise(target)
    duration = F.col("t1") - F.col("t0")
    j = j.withColumn("take", F.greatest(F.lit(LEAST_SHARE), whole * (duration / target))).withColumn("s0", F.greatest(F.lit(0.0), F.col("start") + whole * (F.greatest(F.lit(0.0), F.col("t0") - F.col("c0")) / target)))
    if source_end > 0:
        past = F.col("s0") + F.col("take") > source_end
        j = j.withColumn("s1", F.when(past, F.lit(source_end)).otherwise(F.col("s0") + F.col("take"))).withColumn("s0", F.when(past, F.greatest(F.lit(0.0), source_end - F.col("take"))).otherwise(F.col("s0")))
    else:
        j = j.withColumn("s1", F.col("s0") + F.col("take"))
    review = ~F.col("inferred") & (F.col("confidence") < ACCEPTED)
    kind = F.when(F.col("inferred") | review, "inferred").when(F.col("speed_changed"), "speed_changed").otherwise("exact")
    return j.where("s1 > s0").select(
        key, "id", "s0", "s1", F.abs(F.col("s1") - F.col("s0") - duration).alias("duration_gap"), F.when(F.col("inferred"), TEMPORAL[1]).otherwise(TEMPORAL[0]).alias("temporal"),
        F.when(review, "needs_review").otherwise("auto_accepted").alias("status"), review.alias("review"), kind.alias("match_type"),
    )


def put_first(candidate: Column, existing: Column) -> Column:
    """A candidate, then the first ``KEPT`` others, without any of the candidate's id; no candidates count as none."""
    others = F.filter(existing, lambda x: ~x["id"].eqNullSafe(candidate["id"]))
    return F.when(existing.isNull(), F.array(candidate)).otherwise(F.concat(F.array(candidate), F.slice(others, 1, KEPT)))


def frame_score(a_hash: Column, a_phash: Column, a_hist: Column, b_hash: Column, b_phash: Column, b_hist: Column) -> Column:
    """How alike two frames are: 256-bit hashes as arrays of four, 64-bit hashes, and the correlation of histograms; even histograms correlate fully."""
    off = F.aggregate(F.zip_with(a_hash, b_hash, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    even = lambda h: F.array_max(h) == F.array_min(h)
    hist = F.when(even(a_hist) | even(b_hist), F.lit(1.0)).otherwise(dot(z_normalized(a_hist), z_normalized(b_hist)))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return unit((1 - off / 256.0) * FRAME_SHARES[0] + (1 - F.bit_count(a_phash.bitwiseXOR(b_phash)) / 64.0) * FRAME_SHARES[1] + unit((hist + 1) / 2) * FRAME_SHARES[2])
