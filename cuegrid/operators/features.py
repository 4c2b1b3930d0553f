"""Features of beats, sections of tracks and the columns that decide where cuts may fall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import curves as C

# Minimum gap and longest hold in seconds, from calm to peak energy; anchor bonuses.
MIN_GAP = {"low": 0.90, "medium": 0.58, "high": 0.38, "peak": 0.30}
MAX_HOLD = {"low": 3.80, "medium": 2.80, "high": 1.85, "peak": 1.25}
BAR_BONUS, PHRASE_BONUS = 0.32, 0.48
CALM, STRONG = ("intro", "outro", "breakdown"), ("drop", "finale")
# The walk's bonuses and loss by place, the score of a weak beat, and how far over its hold a gap may go.
NEAR_PHRASE, NEAR_BAR, AWAY, WEAK, OVER = 0.22, 0.12, 0.06, 0.42, 1.15


def first_of(*rules: tuple[Column, object], default) -> Column:
    """The value of the first rule that holds."""
    out = F.when(*rules[0])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def _blend(**weights: float) -> Column:
    total = None
    for name, w in weights.items():
        total = F.lit(w) * F.col(name) if total is None else total + F.lit(w) * F.col(name)
    return total


def features(curves: DataFrame, duration: float, width: int = 16) -> DataFrame:
    """curves with novelty, bright, energy, wave, arc, rhythm, impact, strong hits and anchors, one row a beat.

    All windows are over track_id in beat order, so one shuffle serves the whole chain. Nulls in a curve
    count as not finite: normalised to 0.
    """
    g = Window.partitionBy("track_id")
    hit = lambda c, q: F.round(c, 9) >= F.round(C.percentile(F.col(c), q, g), 9)
    at = F.row_number().over(g.orderBy("beat_idx")) - 1
    x = F.least(F.greatest(F.col("t") / duration, F.lit(0.0)), F.lit(1.0))
    df = curves.withColumn("slope", F.abs(C.gradient(F.col("rms"), "track_id", "beat_idx")))
    rhythm = _blend(kick=0.34, bass=0.26, clap=0.27, hihat=0.08, onset=0.05)
    df = C.with_normalised(df, g, {"nov0": _blend(flux=0.50, onset=0.35, slope=0.15), "bright": _blend(centroid=0.65, hihat=0.35), "rhythm": rhythm})
    df = C.with_normalised(df, g, {"energy": _blend(rms=0.55, flux=0.20, bright=0.15, bass=0.10)})
    df = df.withColumns({"novelty": C.smooth(F.col("nov0"), "track_id", "beat_idx", 3), "slow": C.smooth(F.col("energy"), "track_id", "beat_idx", width)})
    df = C.with_normalised(df, g, {"wave": _blend(slow=0.70, energy=0.30)})
    df = df.withColumn("arch", F.pow(F.greatest(F.lit(0.0), F.sin(F.pi() * x)), F.lit(0.65)))
    df = C.with_normalised(df, g, {"arc": _blend(arch=0.58, wave=0.42)})
    df = C.with_normalised(df, g, {"impact": _blend(rhythm=0.42, novelty=0.24, wave=0.24, arc=0.10)})
    strong = {"strong_kick": hit("kick", 0.72), "strong_clap": hit("clap", 0.74), "strong_hihat": hit("hihat", 0.82), "strong_bass": hit("bass", 0.74)}
    return df.withColumns({**strong, "bar": at % 4 == 0, "phrase": at % 8 == 0}).drop("slope", "nov0", "slow", "arch")


def novelty_boundaries(feat: DataFrame, duration: float, gap: float = 10.0, wide: bool = False) -> DataFrame:
    """(track_id, t): beats of high novelty and no low wave, `gap` after the last one taken; if `wide`, a track's are dealt to several tasks."""
    g = Window.partitionBy("track_id")
    high = lambda c, q: F.round(c, 9) >= F.round(C.percentile(F.col(c), q, g), 9)
    found = feat.select("track_id", "t", (high("novelty", 0.91) & high("wave", 0.45)).alias("ok")).where(F.col("ok") & (F.col("t") > 0) & (F.col("t") < duration))
    return C.thin_wide(written(found), "track_id", "t", gap) if wide else C.thin(found, "track_id", "t", gap)


def ward_starts(x, k: int) -> list[int]:
    """Where the parts start if rows of x (integers) are merged to k contiguous parts, always the two neighbours that add least to the squares about the means; of equal ones the first.

    Parts are a linked list, costs a heap; a cost that a merge made old is left in the heap and passed by."""
    import heapq

    n, total = [1] * len(x), [tuple(r) for r in x.tolist()]
    before, after, age = [i - 1 for i in range(len(x))], [i + 1 for i in range(len(x))], [0] * len(x)

    def cost(i: int) -> tuple:
        j = after[i]
        gap = 0.0
        for a, b in zip(total[i], total[j]):
            gap += (a / n[i] - b / n[j]) * (a / n[i] - b / n[j])
        return n[i] * n[j] / (n[i] + n[j]) * gap, i, j, age[i], age[j]

    heap = [cost(i) for i in range(len(x) - 1)]
    heapq.heapify(heap)
    left = len(x)
    while left > k:
        _, i, j, one, two = heapq.heappop(heap)
        if age[i] != one or age[j] != two:
            continue
        n[i] += n[j]
        total[i] = tuple(a + b for a, b in zip(total[i], total[j]))
        after[i] = after[j]
        age[i] += 1
        age[j] = -1
        left -= 1
        if after[i] < len(x):
            before[after[i]] = i
            heapq.heappush(heap, cost(i))
        if before[i] >= 0:
            heapq.heappush(heap, cost(before[i]))
    return [i for i in range(len(x)) if age[i] >= 0]


def change_points(feat: DataFrame, duration: float) -> DataFrame:
    """(track_id, t): starts of the second to last of k contiguous parts, made by merging neighbours by Ward's rule over wave, novelty, rhythm and impact (in millionths);
    k = duration / 32 s, 3 at least and 8 at most. Tracks pass by in order; a task holds one track's beats: four numbers each."""
    import numpy as np
    import pandas as pd

    k = min(8, max(3, round(duration / 32)))
    names = ["wave", "novelty", "rhythm", "impact"]

    def cut(batches):
        held, now = [], None  # the parts of the track that a batch may have left unfinished

        def bounds():
            t, x = (np.concatenate(p) for p in zip(*held))
            at = t[ward_starts(x, k)[1:]]
            return [now[0]] * len(at), at

        for pdf in batches:
            key, t, x = pdf["track_id"], pdf["t"].to_numpy(), pdf[names].to_numpy()
            new = ~(key.eq(key.shift()) | (key.isna() & key.shift().isna())).to_numpy(copy=True)
            new[:1] = True
            starts, done = np.flatnonzero(new), []
            for lo, hi, name in zip(starts, [*starts[1:], len(pdf)], key.iloc[starts].tolist()):
                first = (None if name != name else name,)
                if first != now:
                    if held:
                        done.append(bounds())
                    held, now = [], first
                held.append((t[lo:hi], x[lo:hi]))
            yield pd.DataFrame({"track_id": pd.Series([v for v, _ in done for v in v], dtype=object), "t": np.concatenate([*[at for _, at in done], []])})
        if held:
            name, at = bounds()
            yield pd.DataFrame({"track_id": pd.Series(name, dtype=object), "t": at})

    rows = feat.select("track_id", "beat_idx", "t", *[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in names])
    return rows.repartition("track_id").sortWithinPartitions("track_id", "beat_idx").mapInPandas(cut, f"track_id {feat.schema['track_id'].dataType.simpleString()}, t double")


def merge_boundaries(times: DataFrame, key: str, t: str, duration: float, gap: float, wide: bool = False) -> DataFrame:
    """(key, t): sorted times in [0, duration] to the millisecond, `gap` after the last one kept; both
    ends are always kept. Times that are not finite are left out; a key with no finite time has the ends. If `wide`, a key's times are dealt to several tasks."""
    at = F.round(F.least(F.greatest(F.col(t), F.lit(0.0)), F.lit(float(duration))), 3)
    inner = times.where(C.finite(F.col(t))).select(key, at.alias(t)).where(F.col(t) != float(duration))
    ends = times.select(key).distinct()
    inner = inner.unionByName(ends.select(key, F.lit(0.0).alias(t))).distinct()
    kept = C.thin_wide(written(inner), key, t, gap) if wide else C.thin(inner, key, t, gap)
    return kept.unionByName(ends.select(key, F.lit(float(duration)).alias(t)))


def sections(feat: DataFrame, duration: float, gap: float = 10.0, grid: float = 32.0) -> DataFrame:
    """(track_id, section_idx, start, end, wave, impact, bright, beats, pattern, type), from 1 s on.

    Bounds are the ends, the change points and the novelty boundaries, merged; a track without an inner
    bound has a fixed grid. A section without beats takes the track's median wave and 0.5.
    """
    points = change_points(feat, duration).unionByName(novelty_boundaries(feat, duration))
    # written: points and bounds are read more than once, and the change points are the dearest step
    points = written(points.unionByName(feat.groupBy("track_id").agg(F.lit(0.0).alias("t"))))
    steps = [i * grid for i in range(int(-(-duration // grid)))] + [float(duration)]
    g, o = Window.partitionBy("track_id"), Window.partitionBy("track_id").orderBy("start")
    bounds = written(merge_boundaries(points, "track_id", "t", duration, gap)).withColumn("n", F.count(F.lit(1)).over(g))
    bounds = bounds.where("n >= 3").select("track_id", "t").unionByName(
        bounds.where((F.col("n") < 3) & (F.col("t") == 0)).select("track_id", F.explode(F.array(*[F.lit(s) for s in steps])).alias("t"))
    )
    cut = bounds.select("track_id", F.col("t").alias("start"), F.lead("t").over(g.orderBy("t")).alias("end"))
    cut = cut.where(F.col("end") - F.col("start") >= 1).withColumn("section_idx", F.row_number().over(o) - 1)
    # sections are a handful a track: the join meets on track_id, the interval only filters
    median = feat.groupBy("track_id").agg(F.percentile("wave", F.lit(0.5)).alias("median_wave"))
    beat = feat.select(F.col("track_id").alias("k"), "t", "wave", "impact", "bright", "strong_kick", "strong_clap", "strong_bass", "strong_hihat")
    joined = cut.join(beat, (F.col("track_id") == F.col("k")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")), "left")
    ratio = [F.coalesce(F.avg(F.col(f"strong_{c}").cast("double")), F.lit(0.0)).alias(c) for c in ("kick", "clap", "bass", "hihat")]
    out = joined.groupBy("track_id", "section_idx", "start", "end").agg(F.avg("wave").alias("w"), F.avg("impact").alias("i"), F.avg("bright").alias("b"), F.count("k").alias("beats"), *ratio)
    out = out.join(median, "track_id").withColumns({"wave": F.coalesce("w", "median_wave"), "impact": F.coalesce("i", F.lit(0.5)), "bright": F.coalesce("b", F.lit(0.5))})
    return out.withColumns({"pattern": pattern(), "type": section_type(duration)}).select(
        "track_id", "section_idx", "start", "end", "wave", "impact", "bright", "beats", "kick", "clap", "bass", "hihat", "pattern", "type"
    )


def pattern() -> Column:
    """The dominant pattern from the share of beats with a strong kick, clap, bass and hihat."""
    kick, clap, bass, hihat = (F.round(c, 9) for c in ("kick", "clap", "bass", "hihat"))
    top = F.greatest(kick, clap, bass, hihat)
    return first_of(
        ((kick > 0.42) & (clap > 0.34), "kick_clap"), ((kick >= top) & (kick > 0.34), "kick"), ((clap >= top) & (clap > 0.34), "clap"),
        ((bass >= top) & (bass > 0.34), "bass"), (hihat > 0.46, "hihat"), default="mixed",
    )


def section_type(duration: float) -> Column:
    wave, impact, median = F.round("wave", 9), F.round("impact", 9), F.round("median_wave", 9)
    calm = wave <= median * 1.18
    first, last = F.col("start") / duration < 0.11, F.col("end") / duration > 0.91
    return first_of(
        (first & calm, "intro"), (first, "hook"), (last & calm, "outro"), (last, "finale"),
        ((wave >= F.greatest(F.lit(0.72), median * 1.22)) & (impact >= 0.58), "drop"), (wave >= F.greatest(F.lit(0.60), median * 1.12), "chorus"),
        ((impact >= 0.64) & (wave < median), "bridge"), (wave < median * 0.82, "breakdown"), default="verse",
    )


def beat_step(wave: Column, impact: Column, kind: Column, pat: Column) -> Column:
    """Beats to the next cut, 1 (dense) to 4."""
    low, mid, full, top = kind.isin(*CALM), kind.isin("verse", "bridge", "hook"), kind == "chorus", kind.isin(*STRONG)
    return first_of(
        (low & (wave > 0.82) & (impact > 0.76), 2), (low & (wave > 0.55), 3), (low, 4),
        (mid & (wave > 0.84) & (impact > 0.72), 2), (mid & (wave > 0.56), 3), (mid, 4),
        (full & (wave > 0.88) & (impact > 0.78), 1), (full & (wave > 0.58), 2),
        (top & (wave > 0.90) & (impact > 0.82) & pat.isin("kick_clap", "kick", "bass"), 1), (top & (wave > 0.62), 2), default=3,
    )


def min_gap(wave: Column, kind: Column) -> Column:
    return first_of(
        (kind.isin(*CALM), MIN_GAP["low"]), ((wave >= 0.90) & kind.isin(*STRONG), MIN_GAP["peak"]),
        (wave >= 0.68, MIN_GAP["high"]), (wave >= 0.38, MIN_GAP["medium"]), default=MIN_GAP["low"],
    )


def max_hold(energy: Column, kind: Column) -> Column:
    return first_of(
        (kind.isin(*CALM), MAX_HOLD["low"]), (kind.isin(*STRONG) & (energy >= 0.78), MAX_HOLD["peak"]),
        (kind.isin("chorus", *STRONG), MAX_HOLD["high"]), (energy >= 0.55, MAX_HOLD["medium"]), default=MAX_HOLD["low"],
    )


def section_beats(feat: DataFrame, secs: DataFrame) -> DataFrame:
    """Beats in their section with step, min_gap, max_hold and the cut score, normalised within the section."""
    s = secs.select(F.col("track_id").alias("k"), "section_idx", "start", "end", "pattern", "type", F.col("wave").alias("section_wave"))
    df = feat.join(s, (F.col("track_id") == F.col("k")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("k")
    flag = lambda c: F.col(c).cast("double")
    kick, clap, bass, hihat = (flag(f"strong_{c}") for c in ("kick", "clap", "bass", "hihat"))
    pat, wave, impact, kind = F.col("pattern"), F.round("wave", 9), F.round("impact", 9), F.col("type")
    extra = first_of((pat == "kick_clap", 0.12 * kick + 0.10 * clap), (pat == "kick", 0.16 * kick), (pat == "bass", 0.16 * bass), (pat == "clap", 0.14 * clap), (pat == "hihat", 0.05 * hihat), default=0.0)
    raw = _blend(impact=0.36, rhythm=0.27, wave=0.20, novelty=0.10, arc=0.07) + BAR_BONUS * flag("bar") + PHRASE_BONUS * flag("phrase") + extra
    return C.with_normalised(df, Window.partitionBy("track_id", "section_idx"), {"score": raw}).withColumns({
        "step": beat_step(wave, impact, kind, pat), "min_gap": min_gap(wave, kind), "max_hold": max_hold(F.round("section_wave", 9), kind),
    })


def _best_near(radius: int) -> Column:
    """The place of the best beat up to `radius` places from each: score, bonus and 0.06 less for each place away; the first of equal ones."""
    o = Window.partitionBy("track_id", "section_idx").orderBy("beat_idx")
    pull = F.col("score") + F.when(F.col("phrase"), NEAR_PHRASE).when(F.col("bar"), NEAR_BAR).otherwise(0.0)
    options = [F.struct((F.lag(pull, -k).over(o) - AWAY * abs(k)).alias("v"), F.lit(-k).alias("k")) for k in range(-radius, radius + 1)]
    return F.row_number().over(o) - 1 - F.array_max(F.filter(F.array(*options), lambda x: x["v"].isNotNull()))["k"]


def walk_table(beats: DataFrame) -> DataFrame:
    """One row a section, with an array over its beats (in order) for all that the walk looks up: t, score, step, min_gap and
    the best beat near each, within one place and within two."""
    g = beats.withColumns({"near1": _best_near(1), "near2": _best_near(2)})
    row = F.struct("beat_idx", "t", "score", "step", "min_gap", "near1", "near2")
    rows = g.groupBy("track_id", "section_idx", "max_hold").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return rows.select("track_id", "section_idx", "max_hold", *[F.col("r").getField(c).alias(c) for c in ("t", "score", "step", "min_gap", "near1", "near2")])


def walk_cuts(beats: DataFrame) -> DataFrame:
    """(track_id, section_idx, t): the cuts of each section, found by following its table from its start.

    From the last cut the walk looks `step` beats ahead and takes the best beat near there. Beats too near
    to the last cut are passed by; so are weak ones (score below 0.42) while the hold lasts. After a cut that would
    leave a gap of over 1.15 holds, a beat near the end of the hold is cut too. A row is one section's
    beats; sections last seconds, so a row is small whatever the number of tracks.
    """
    import numpy as np
    import pandas as pd

    def follow(t, score, step, gap, near1, near2, hold) -> list[int]:
        last_beat, cuts = len(t) - 1, [int(near1[0])]
        at = cuts[0]
        while at < last_beat:
            aim = min(last_beat, at + int(step[at]))
            best = int((near1 if step[at] <= 2 else near2)[aim])
            waited = t[best] - t[cuts[-1]]
            if waited < gap[best]:
                at = min(last_beat, aim + 1)
                continue
            if score[best] < WEAK and waited < hold:
                at = aim
                continue
            late = best + 1 + int(np.searchsorted(t[best + 1 :] - t[best], hold))
            extra = int(near2[late]) if late <= last_beat and t[late] - t[best] > OVER * hold else best
            cuts += [best, extra] if t[extra] - t[best] >= gap[best] and extra != best else [best]
            at = cuts[-1]
        return cuts

    def run(batches):
        for pdf in batches:
            cols = [pdf[c] for c in ("t", "score", "step", "min_gap", "near1", "near2", "max_hold")]
            cut = [np.asarray(r[0])[follow(*r)] for r in zip(*cols)]
            yield pd.DataFrame({"track_id": np.repeat(pdf["track_id"].to_numpy(), [len(c) for c in cut]), "section_idx": np.repeat(pdf["section_idx"].to_numpy(), [len(c) for c in cut]), "t": np.concatenate([*cut, []])})

    kind = beats.schema["track_id"].dataType.simpleString()
    return walk_table(beats).mapInPandas(run, f"track_id {kind}, section_idx int, t double")


def segment_target(kind: Column, wave: Column, impact: Column, rhythm: Column, novelty: Column, arc: Column) -> Column:
    """What a segment asks of its clip: drop, soft, build, rhythm or flow."""
    return first_of(
        (kind.isin(*STRONG) & ((wave >= 0.58) | (impact >= 0.55)), "drop"), ((impact >= 0.76) | ((wave >= 0.78) & (rhythm >= 0.62)), "drop"),
        (kind.isin(*CALM) & (wave <= 0.54), "soft"), ((wave <= 0.32) & (impact <= 0.48), "soft"),
        (kind.isin("bridge", "hook") | (novelty >= 0.68) | ((arc >= 0.62) & (wave >= 0.48)), "build"),
        ((wave >= 0.58) & (rhythm >= 0.54), "rhythm"), default="flow",
    )
