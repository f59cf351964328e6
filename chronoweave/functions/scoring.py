"""Match scores as column expressions. Weights and thresholds are fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(num(low), F.least(num(high), x))


def duration_confidence(gap: Column, duration: Column, floor: float = 1.0) -> Column:
    """1 at no gap, falling to 0 when the gap reaches the row's duration."""
    return F.greatest(num(0), 1 - gap / F.greatest(duration, num(floor)))


def audio_weight(segment_type: Column, label: Column, speech: Column) -> Column:
    """How much the audio score counts, by what is heard."""
    return (
        F.when(segment_type == "no_narration", num(0.32))
        .when(label == "silent", num(0.18))
        .when(label == "weak", num(0.24))
        .when(speech >= 0.72, num(0.08))
        .when(speech >= 0.42, num(0.12))
        .otherwise(num(0.18))
    )


def candidate_confidence(visual: Column, temporal: Column, duration: Column, gap: Column, rank_gap: Column, audio: Column, stability: Column, weight: Column) -> Column:
    """One confidence for a candidate: weighted evidence, moved by timing and by its lead, blended with audio, calibrated at the top."""
    s = 0.84 * visual + 0.04 * duration_confidence(gap, duration) + 0.08 * stability + 0.04 * temporal
    s = s + (
        F.when((temporal < 0.35) & (visual < 0.90), -F.least(num(0.10), (0.35 - temporal) * 0.18))
        .when(temporal > 0.82, F.least(num(0.04), (temporal - 0.82) * 0.20))
        .otherwise(num(0))
    )
    s = s + (
        F.when((rank_gap < 0.015) & (visual < 0.92), -F.least(num(0.10), (0.015 - rank_gap) * 4))
        .when(rank_gap > 0.08, F.least(num(0.04), (rank_gap - 0.08) * 0.5))
        .otherwise(num(0))
    )
    s = clip(F.when(audio > 0.15, s * (1 - weight / 2) + audio * weight / 2).otherwise(s))
    return F.when(s >= 0.85, 1 - F.pow(1 - s, num(1.5))).otherwise(s)


def calibrated_confidence(raw: Column, review: Column, from_chunk: Column, visual: Column, temporal: Column, stability: Column, gap: Column, duration: Column) -> Column:
    """The confidence to show: stable chunk matches are lifted, others keep their own."""
    s = 0.35 * visual + 0.45 * stability + 0.15 * temporal + 0.05 * duration_confidence(gap, duration, 0.5)
    s = F.when(s >= 0.80, 1 - F.pow(F.greatest(num(0), 1 - s), num(1.8))).otherwise(s)
    stable = ~review & from_chunk & (stability >= 0.88) & (temporal >= 0.80) & (visual >= 0.70)
    return F.when(stable, F.greatest(raw, F.least(num(0.995), s))).otherwise(raw)


def temporal_confidence(center: Column, expected: Column, duration: Column) -> Column:
    """1 at the expected time; the tolerance is 15 durations and two minutes at least."""
    return clip(1 - F.abs(center - expected) / F.greatest(num(120), 15 * duration, num(1)))


def speed_changed(ratio: Column, evidence: Column, verification: Column, stability: Column, n: Column) -> Column:
    return ratio.between(0.50, 2.00) & (F.abs(ratio - 1) >= 0.08) & (evidence >= 0.70) & ((verification >= 0.68) | ((stability >= 0.68) & (n >= 3)))


def match_type(review: Column, confidence: Column, changed: Column) -> Column:
    return F.when(review | (confidence < 0.78), "inferred").when(changed, "speed_changed").otherwise("exact")


def node_score(score: Column, verification: Column, temporal: Column, rank_gap: Column, stability: Column, low_info: Column, best: Column, best_temporal: Column, top_score: Column, top_temporal: Column, top_verification: Column, is_top: Column) -> Column:
    """What a candidate is worth to the alignment by itself; best_*: maxima in its segment, top_*: of its first candidate."""
    s = score + F.when(score >= 0.92, 0.06 * F.least(num(1), (score - 0.92) / 0.08)).when(score >= 0.85, 0.03 * (score - 0.85) / 0.07).otherwise(num(0))
    s = s + F.least(num(0.10), 0.12 * verification) + F.least(num(0.12), 0.16 * temporal) + F.least(num(0.05), 2.5 * rank_gap) + F.least(num(0.08), 0.10 * stability)
    s = s + F.when(temporal >= 0.65, num(0.04)).when(temporal >= 0.35, num(0.02)).otherwise(num(0)) + F.when(verification >= 0.55, num(0.03)).otherwise(num(0))
    s = s - F.when((temporal < 0.08) & (verification < 0.42), num(0.18)).when((temporal < 0.16) & (rank_gap < 0.01) & (verification < 0.40), num(0.08)).otherwise(num(0))
    g = best - score
    s = s - F.when(g > 0.08, F.least(num(0.32), 2.8 * g)).when(g > 0.03, F.least(num(0.16), 1.9 * g)).otherwise(num(0))
    s = s - F.when((best_temporal >= 0.35) & (temporal + 0.20 < best_temporal), num(0.06)).otherwise(num(0))
    later = (
        F.when((g > 0.08) & (top_temporal + 0.05 >= temporal), num(0.12)).otherwise(num(0))
        + F.when(top_temporal >= temporal + 0.20, num(0.10)).otherwise(num(0))
        + F.when((top_verification >= verification + 0.08) & (g > 0.04), num(0.06)).otherwise(num(0))
    )
    s = s - F.when(is_top, num(0)).otherwise(later)
    s = s - F.when(verification < 0.38, F.least(num(0.10), 0.20 * (0.38 - verification))).otherwise(num(0))
    s = s - F.when(rank_gap < 0.0025, F.least(num(0.06), 12 * (0.0025 - rank_gap))).otherwise(num(0))
    return s - F.least(num(0.10), 0.12 * low_info)


def skip_score(best: Column, non_movie: Column) -> Column:
    return F.when(non_movie, num(0.05)).otherwise(-2 - F.least(num(0.4), 0.35 * best))


def alignment_status(skipped: Column, non_movie: Column, start: Column, manual: Column, confidence: Column, verification: Column, auto: float = 0.82) -> Column:
    return (
        F.when(skipped, "skipped")
        .when(non_movie, "non_movie")
        .when(start.isNull(), "unmatched")
        .when(manual, "manual")
        .when((confidence >= auto) & (verification >= 0.85), "auto_accepted")
        .otherwise("needs_review")
    )


def validation_score(forward: Column, backward: Column, time_error: Column, forward_distance: Column, backward_distance: Column) -> tuple[Column, Column]:
    """(score, valid) of a round trip: four equal parts, valid if it and both consistencies reach one half."""
    time_part = F.greatest(num(0), 1 - time_error / (1 + 1e-6))
    scale = F.greatest(forward_distance, backward_distance, num(1e-6)) * 0.15
    distance_part = F.greatest(num(0), 1 - F.abs(forward_distance - backward_distance) / scale)
    score = 0.25 * (forward + backward + time_part + distance_part)
    return score, (score >= 0.5) & (time_part >= 0.5) & (distance_part >= 0.5)


def rerank_priority_weak(unmatched: Column, review: Column, status: Column, kind: Column, confidence: Column, visual: Column) -> Column:
    """Whether a match is weak: unmatched, under review, inferred, or of low confidence or low visual score."""
    return unmatched | review | status.isin("needs_review", "unmatched") | kind.isin("inferred", "fallback") | (confidence < 0.78) | ((visual > 0) & (visual < 0.70))


def audit_calibration(similarity: Column, pixel: Column) -> Column:
    """Audit score from an embedding similarity, never below the pixel score."""
    base = clip((similarity - 0.46) / 0.28)
    floor = F.when(similarity >= 0.72, num(0.985)).when(similarity >= 0.66, num(0.955)).when(similarity >= 0.60, num(0.900)).otherwise(num(0))
    return F.greatest(base, floor, pixel)


def fuzzy_confidence(ratio: Column) -> Column:
    """Text similarity to confidence; null below 0.4."""
    return F.when(ratio >= 0.8, 0.9 + 0.5 * (ratio - 0.8)).when(ratio >= 0.6, 0.6 + 1.5 * (ratio - 0.6)).when(ratio >= 0.4, 0.3 + 1.5 * (ratio - 0.4))


def activity_label(rms_db: Column, active: Column) -> Column:
    return F.when((rms_db < -48) | (active < 0.04), "silent").when((rms_db < -36) | (active < 0.12), "weak").otherwise("active")


def speech_likelihood(rms_db: Column, active: Column) -> Column:
    return 0.4 * clip((rms_db + 48) / 24) + 0.6 * F.least(num(1), active / 0.35)


def hash_consistency(monotonic: Column, step_variance: Column, distance_variance: Column) -> Column:
    return 0.4 * monotonic + 0.3 / (1 + step_variance / 10) + 0.3 / (1 + distance_variance / 25)


def search_radius(duration: Column, step: float, relaxed: bool = False) -> Column:
    wide = F.lit(max(1.5, step * (3 if relaxed else 2)))
    if relaxed:
        return wide
    return F.when(duration <= 1.15, num(min(0.85, max(0.55, 0.70 * step)))).when(duration <= 2.2, num(min(1.20, max(0.80, 0.95 * step)))).otherwise(wide)


def hint_window(duration: Column, strict: bool, relaxed: bool) -> Column:
    """Half width of the search window around a time hint."""
    if strict:
        return F.greatest(3 * duration, F.when(duration <= 3.5, num(45)).otherwise(num(60))) * (1.35 if relaxed else 1.0)
    return F.greatest(6 * duration, num(90)) if relaxed else F.greatest(8 * duration, num(180))


def colour_similarity(parts: list[Column], shift: Column) -> Column:
    """Five component similarities (hue, saturation, value, lightness, layout) weighted by how far the colours have shifted."""
    bands = ((0.2, (0.30, 0.20, 0.20, 0.15, 0.15)), (0.5, (0.20, 0.15, 0.20, 0.20, 0.25)), (None, (0.10, 0.10, 0.20, 0.25, 0.35)))
    by_band = [sum((w * p for w, p in zip(weights, parts, strict=True)), num(0)) for _, weights in bands]
    return F.when(shift < bands[0][0], by_band[0]).when(shift < bands[1][0], by_band[1]).otherwise(by_band[2])


def prefilter(colour_distance: Column, edge_similarity: Column, most: float = 0.35, least: float = 0.55) -> Column:
    """The stage that a pair fails at, or pass: colours first, edges after."""
    return F.when(colour_distance > most, "colour").when(edge_similarity < least, "edge").otherwise("pass")
