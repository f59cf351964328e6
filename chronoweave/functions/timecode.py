"""Seconds to and from time codes and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seconds: Column, per_second: int) -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and truncated parts of a second, as integers; negative counts as zero."""
    at = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(at)
    return F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole.cast("long") % 60, F.floor((at - whole) * per_second).cast("long")


def srt(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(seconds, 1000))


def ass(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", *_parts(seconds, 100))


def clock(seconds: Column, millis: bool = False) -> Column:
    h, m, s, ms = _parts(seconds, 1000)
    return F.format_string("%02d:%02d:%02d.%03d", h, m, s, ms) if millis else F.format_string("%02d:%02d:%02d", h, m, s)


def parse_clock(text: Column) -> Column:
    """Seconds of H:M:S, M:S or S, with up to three decimals after a point or comma; null where it is none of these."""
    t = F.trim(text)
    pattern = r"^(?:(?:(\d+):)?(\d{1,2}):)?(\d{1,2}|\d+)(?:[.,](\d{1,3}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, pattern, i).try_cast("double"), F.lit(0.0))
    millis = F.rpad(F.regexp_extract(t, pattern, 4), 3, "0").try_cast("double")
    return F.when(t.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3) + F.coalesce(millis, F.lit(0.0)) / 1000)


def frames(seconds: Column, fps: float) -> Column:
    """Truncated frame number."""
    return (seconds * float(fps)).cast("long")


def frames_rounded(seconds: Column, fps: float) -> Column:
    """Frames of an edit list: rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.greatest(seconds, F.lit(0.0)) * float(fps), 0).cast("long"))
