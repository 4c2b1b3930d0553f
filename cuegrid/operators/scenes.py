"""Scenes of videos: frame changes, boundaries, candidate windows, sample plans and window metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from . import curves as C

# Seconds of a window at most and at least.
LONGEST, SHORTEST = 5.2, 0.55


def frame_motion(frames: DataFrame, vec: str = "vec") -> DataFrame:
    """frames (video_id, frame_idx, vec) with motion: the mean absolute change from the frame before; 0 for the first."""
    o = Window.partitionBy("video_id").orderBy("frame_idx")
    df = frames.withColumn("__p", F.lag(vec).over(o))
    total = F.aggregate(F.zip_with(vec, "__p", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("motion", F.coalesce(total / F.size(vec), F.lit(0.0))).drop("__p")


def scene_changes(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """(video_id, t): times of frames above the threshold, to the millisecond, at least 0.08 s apart."""
    return C.thin(scored.where(F.col(score) > threshold).select("video_id", F.round("t", 3).alias("t")), "video_id", "t", 0.08)


def scene_windows(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """(video_id, window_idx, scene_index, start, end, kind) from changes (video_id, t) and sources (video_id,
    duration). Scenes under 0.55 s give none; longer than 5.2 s give overlapping windows of 5.2 s from evenly
    spaced starts. A change nearer than 0.35 s to the last one kept is none. A source without a change is one scene."""
    there = sources.where("duration > 0").select("video_id", "duration", F.round("duration", 3).alias("last"))
    inner = there.join(changes.select("video_id", F.round("t", 3).alias("t")), "video_id").where((F.col("t") > 0) & (F.col("t") < F.col("duration")) & (F.col("t") != F.col("last")))
    kept = C.thin(inner.select("video_id", "t").unionByName(there.select("video_id", F.lit(0.0).alias("t"))).distinct(), "video_id", "t", 0.35)
    b = kept.unionByName(there.select("video_id", F.col("last").alias("t")))
    in_order = Window.partitionBy("video_id").orderBy("t")
    scene = b.select("video_id", (F.row_number().over(in_order) - 1).alias("scene_index"), F.col("t").alias("from"), F.lead("t").over(in_order).alias("to")).where("to IS NOT NULL")
    length = F.col("to") - F.col("from")
    scene = scene.where(length >= SHORTEST).withColumn("n", F.greatest(F.lit(1), F.ceil(length / LONGEST).cast("int")))
    cut = scene.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    start = F.col("from") + F.col("c") * (length / F.col("n"))
    cut = cut.select("video_id", "scene_index", start.alias("start"), F.least(F.col("to"), start + LONGEST).alias("end"), F.when(F.col("n") == 1, "scene").otherwise("scene_chunk").alias("kind"))
    o = Window.partitionBy("video_id").orderBy("start")
    return cut.where(F.col("end") - F.col("start") >= SHORTEST).withColumn("window_idx", F.row_number().over(o) - 1)


def sample_plan(windows: DataFrame, fps: float) -> DataFrame:
    """windows with a row for each sample (sample_idx, sample_t, frame_idx): 3 to 8 times, evenly from 12 % in
    to 12 % before the end. Windows of 0.05 s or less have none."""
    d = F.col("end") - F.col("start")
    n = F.least(F.greatest(F.ceil(d * 1.4), F.lit(3)), F.lit(8)).cast("int")
    rows = windows.where(d > 0.05).select("*", n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("sample_idx"))
    t = F.col("start") + d * 0.12 + F.col("sample_idx") * (d * 0.76) / (F.col("__n") - 1)
    return rows.withColumn("sample_t", t).withColumn("frame_idx", F.greatest(F.rint(t * fps).cast("long"), F.lit(0).cast("long"))).drop("__n")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _variance(a: Column) -> Column:
    return _let(_mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def laplacian(gray: Column, width: int, height: int) -> Column:
    """The sum of a pixel's four neighbours less four times itself; at a border the inner neighbour stands in for the one outside."""

    def at(i: Column) -> Column:
        x, y = F.pmod(i, F.lit(width)), F.floor(i / width).cast("int")
        left, right = F.when(x > 0, i - 1).otherwise(i + 1), F.when(x < width - 1, i + 1).otherwise(i - 1)
        up, down = F.when(y > 0, i - width).otherwise(i + width), F.when(y < height - 1, i + width).otherwise(i - width)
        return F.get(gray, left) + F.get(gray, right) + F.get(gray, up) + F.get(gray, down)

    return F.transform(gray, lambda v, i: at(i) - 4 * v)


def frame_statistics(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (b, g, r: arrays of pixels, 0 to 255) with gray, brightness, contrast, saturation, sharpness and colorfulness.

    All in the row: arrays are folded where they are, nothing is exploded or shuffled. Deviations are of the whole population."""
    channels = F.arrays_zip("b", "g", "r")
    gray = F.transform(channels, lambda p: 0.114 * p["b"] + 0.587 * p["g"] + 0.299 * p["r"])
    top = lambda p: F.greatest(p["b"], p["g"], p["r"])
    full = lambda p: F.when(top(p) > 0, (top(p) - F.least(p["b"], p["g"], p["r"])) / top(p)).otherwise(0.0)
    rg, yb = F.transform(channels, lambda p: F.abs(p["r"] - p["g"])), F.transform(channels, lambda p: F.abs(0.5 * (p["r"] + p["g"]) - p["b"]))
    df = frames.withColumns({"gray": gray, "saturation": _mean(F.transform(channels, full)), "colorfulness": (F.sqrt(_variance(rg)) + F.sqrt(_variance(yb))) / 95})
    df = df.withColumns({"brightness": _mean(F.col("gray")) / 255, "contrast": F.sqrt(_variance(F.col("gray"))) / 80, "sharpness": _let(laplacian(F.col("gray"), width, height), _variance) / 520})
    return df.drop("b", "g", "r")


def window_metrics(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a window: means over its sampled frames, motion between one and the next of them, where it moves most, and quality.

    samples: sample_plan()'s rows; stats: frame_statistics()'s. A window none of whose frames are there is left out; with one frame it has no motion and its
    peak is in its middle. Of equal motions the first is the peak."""
    key = ["video_id", "window_idx"]
    both = samples.join(stats, ["video_id", "frame_idx"])
    before = F.lag("gray").over(Window.partitionBy(*key).orderBy("sample_idx"))
    both = both.withColumn("step", _mean(F.zip_with("gray", before, lambda a, b: F.abs(a - b))) / 42)
    d = F.greatest(F.lit(0.01), F.col("end") - F.col("start"))
    mean = lambda c: clamp(F.avg(c)).alias(c)
    peak = F.max_by("sample_t", F.when(F.col("step").isNotNull(), F.struct(F.round("step", 9).alias("s"), (-F.col("sample_idx")).alias("k"))))
    got = both.groupBy(*key, "start", "end", d.alias("duration")).agg(
        F.count("*").alias("n"), *[mean(c) for c in ("brightness", "contrast", "saturation", "sharpness", "colorfulness")], clamp(F.avg("step")).alias("motion"), peak.alias("peak")
    )
    c, one = F.col, F.lit(1.0)
    dark, blown = clamp((0.25 - c("brightness")) / 0.25), clamp((c("brightness") - 0.86) / 0.14)
    quality = clamp(0.36 * c("sharpness") + 0.22 * c("contrast") + 0.18 * c("saturation") + 0.14 * (one - dark) + 0.10 * (one - blown))
    offset = F.least(F.greatest(F.coalesce(c("peak") - c("start"), c("duration") * 0.5), F.lit(0.0)), c("duration"))
    return got.withColumns({"quality": quality, "peak_offset": offset}).drop("peak")
