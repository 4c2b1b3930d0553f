"""Scalar column functions: clamps, coercions, conversions, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; null is not finite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0, default: float = 0.0) -> Column:
    """x bounded to [lo, hi]; text that is no number, NaN, infinity and null count as the default, bounded too."""
    number = x.try_cast("double")
    return F.least(F.greatest(F.when(finite(number), number).otherwise(F.lit(default)), F.lit(lo)), F.lit(hi))


def first_number(values: Column, default: float = 0.0) -> Column:
    """The first element of an array as a number, else the default."""
    return F.coalesce(F.get(values, F.lit(0)).try_cast("double"), F.lit(default))


def frames_to_seconds(frame: Column, hop: int = 512, rate: int = 22050) -> Column:
    return frame * F.lit(hop) / F.lit(float(rate))


def seconds_to_frames(t: Column, fps: Column) -> Column:
    """Half to even, as frame counts are rounded."""
    return F.rint(t * fps).cast("long")


def middle_frame(start: Column, end: Column, fps: Column) -> Column:
    return F.greatest(F.rint((start + F.greatest(F.lit(0.01), end - start) / 2) * fps).cast("long"), F.lit(0).cast("long"))


def duration_text(ms: Column) -> Column:
    """Whole milliseconds as text: under a second as they are, else seconds to one place, half to even; negatives are 0."""
    n = F.greatest(ms, F.lit(0)).cast("long")
    part = F.pmod(n, F.lit(100))
    tenths = (F.floor(n / 100) + F.when((part > 50) | ((part == 50) & (F.pmod(F.floor(n / 100), F.lit(2)) == 1)), 1).otherwise(0)).cast("long")
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("s"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit("ms"))).otherwise(seconds)


def plain_text(x: Column) -> Column:
    """ASCII characters only, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\x00-\x7F]", ""), r"\s+", " "))


def safe_token(x: Column) -> Column:
    cut = F.substring(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_"), 1, 80)
    return F.coalesce(F.when(cut != "", cut), F.lit("item"))


def jitter(*parts: Column) -> Column:
    """A number in [0, 1) that only the parts decide."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def moment_id(path: Column, index: Column, start: Column) -> Column:
    return F.concat_ws("_", F.substring(F.sha1(path), 1, 10), F.lpad(index.cast("string"), 5, "0"), F.lpad((start * 1000).cast("int").cast("string"), 8, "0"))


def near(c: Column, x: float) -> Column:
    """c for a comparison with x as of c rounded to nine places: rounded only if it is near x, since that is dear and else changes nothing."""
    return F.when(F.abs(c - x) > 1e-6, c).otherwise(F.round(c, 9))
