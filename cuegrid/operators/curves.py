"""Ordered operators over irregular curves, by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import finite  # noqa: F401
from .ranges import Ranges


def percentile(x: Column, p: float, by: WindowSpec, default: float = 0.0) -> Column:
    """Linear-interpolated percentile of the finite values of a partition."""
    return F.coalesce(F.percentile(F.when(finite(x), x), F.lit(p)).over(by), F.lit(default))


def normalise(x: Column, by: WindowSpec, default: float = 0.0) -> Column:
    """(x - p2) / (p98 - p2) bounded to [0, 1]; the default where x is not finite or the range is nil."""
    ends = F.percentile(F.when(finite(x), x), F.array(F.lit(0.02), F.lit(0.98))).over(by)  # both of one count
    return scaled(x, F.coalesce(ends[0], F.lit(0.0)), F.coalesce(ends[1], F.lit(0.0)), default)


def with_normalised(df: DataFrame, by: WindowSpec, of: dict[str, Column]) -> DataFrame:
    """df with the normalised column of each name. The two percentiles are a column first: a window function that an expression names five times is computed five times."""
    df = df.withColumns({f"__x_{n}": x for n, x in of.items()})
    df = df.withColumns({f"__ends_{n}": F.percentile(F.when(finite(F.col(f"__x_{n}")), F.col(f"__x_{n}")), F.array(F.lit(0.02), F.lit(0.98))).over(by) for n in of})
    end = lambda n, i: F.coalesce(F.col(f"__ends_{n}")[i], F.lit(0.0))
    df = df.withColumns({n: scaled(F.col(f"__x_{n}"), end(n, 0), end(n, 1)) for n in of})
    return df.drop(*[f"__{c}_{n}" for n in of for c in ("x", "ends")])


def scaled(x: Column, lo: Column, hi: Column, default: float = 0.0) -> Column:
    """x from [lo, hi] to [0, 1], bounded; the default where x is not finite or the range is nil."""
    share = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return F.when(finite(x) & ((hi - lo) >= 1e-8), share).otherwise(F.lit(default))


def smooth(x: Column, key: str, order: str, width: int) -> Column:
    """Centred moving average of odd width whose ends repeat the first and last value.

    Groups of fewer than three rows are returned as they are. A width over the group's counts the ends as often as it reaches beyond them.
    """
    width += 1 - width % 2
    half = width // 2
    o = Window.partitionBy(key).orderBy(order)
    full = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, at = F.count(F.lit(1)).over(full), F.row_number().over(o)
    head = F.greatest(F.lit(0), F.lit(half) - (at - 1)) * F.first(x).over(full)
    tail = F.greatest(F.lit(0), F.lit(half) - (n - at)) * F.last(x).over(full)
    mean = (F.sum(x).over(o.rowsBetween(-half, half)) + head + tail) / F.lit(width)
    return F.when((n < 3) | F.lit(width <= 1), x).otherwise(mean)


def gradient(x: Column, key: str, order: str) -> Column:
    """Central difference inside, one-sided at the ends, 0 for a single row."""
    o = Window.partitionBy(key).orderBy(order)
    a, b = F.lag(x).over(o), F.lead(x).over(o)
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2)


def _thinning(key: str, t: str, gap: float, names: list[str], begin: str | None = None):
    """A pass over rows sorted by names[:-1] (with key) and time: rows that are `gap` after the last one kept. `begin` is a column with the last one kept before a group's first row."""
    import numpy as np

    def run(batches):
        now, last = object(), None
        for pdf in batches:
            times, new = pdf[t].to_numpy(dtype=float), np.arange(len(pdf)) == 0
            for c in names:
                new |= ~(pdf[c].eq(pdf[c].shift()) | (pdf[c].isna() & pdf[c].shift().isna())).to_numpy()
            starts = np.flatnonzero(new)
            kept = []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                first = tuple(None if x != x else x for x in (pdf[c].iloc[lo] for c in names))  # a null key may come as NaN
                if first != now:
                    now, last = first, pdf[begin].iloc[lo] if begin else None
                    last = None if last is None or last != last else last
                at = lo
                while at < hi:
                    if last is None or times[at] - last >= gap:
                        last = times[at]
                        kept.append(at)
                        at += 1
                    # the first time that may be far enough, less what rounding could hide
                    at += int(np.searchsorted(times[at:hi], last + gap - 1e-6))
                    while at < hi and not times[at] - last >= gap:
                        at += 1
            yield pdf.iloc[kept][[key, t]]

    return run


def thin(df: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """(key, t): sorted times of which each is at least `gap` after the last one kept. Null keys are one key; times that are not finite are left out.

    The state is the last kept time, not the last time. Each key's times pass by in order and only the key and that time are carried
    along, from batch to batch: a key's times need not fit a row or a task's memory, and a kept time costs one binary search. thin_wide() deals a key to several tasks.
    """
    kind = df.schema[key].dataType.simpleString()
    ordered = df.where(finite(F.col(t))).select(key, F.col(t).cast("double").alias(t)).repartition(key).sortWithinPartitions(key, t)
    return ordered.mapInPandas(_thinning(key, t, gap, [key]), f"{key} {kind}, {t} double")


def _ways(times, gap: float):
    """(upto, out): for whatever time was kept last before these sorted times, the last one kept at their end is out[k] for the first k with upto[k] - kept >= gap, and that time itself where there is none.

    From each time the next one kept is known by a binary search; following it by doubling leads to the end. Ways from times that are near soon meet, so few pairs are left."""
    import numpy as np

    n = len(times)
    after = np.maximum(np.searchsorted(times, times + gap - 1e-6), np.arange(n) + 1)
    while True:
        near = np.flatnonzero(after < n)
        near = near[times[after[near]] - times[near] < gap]
        if not len(near):
            break
        after[near] += 1
    end = np.where(after < n, after, np.arange(n))
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    first = int(np.searchsorted(times, times[0] + gap + 1e-6)) + 1  # whatever was kept before, the first one kept is among these
    entry = end[:first]
    last = np.flatnonzero(np.append(entry[1:] != entry[:-1], True))
    return times[:first][last], times[entry[last]]


def thin_wide(df: DataFrame, key: str, t: str, gap: float, parts: int | None = None) -> DataFrame:
    """thin() for keys of any size: a key's times are dealt by ranges, and its tasks work at once.

    Each range of a key with several tells what time it would keep last, for each it may be given (_ways). By key these few pairs are followed from range to range; then each range is thinned from
    the time that it is given. df is read three times: give a table. A task holds a range's times of one key."""
    import numpy as np
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(finite(F.col(t))).select(key, F.col(t).cast("double").alias(t))
    deal = Ranges(key, t, rows, parts=parts)

    def tell(batches):
        held, now = [], None

        def told():
            upto, out = _ways(np.concatenate(held), gap)
            return pd.DataFrame({"__range": [now[0]], key: pd.Series([now[1]], dtype=object), "upto": [upto], "out": [out]})

        for pdf in batches:
            same = (pdf["__range"].eq(pdf["__range"].shift()) & (pdf[key].eq(pdf[key].shift()) | (pdf[key].isna() & pdf[key].shift().isna()))).to_numpy(copy=True)
            same[:1] = False
            starts = np.flatnonzero(~same)
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                name = pdf[key].iloc[lo]
                first = (int(pdf["__range"].iloc[lo]), None if name != name else name)
                if first != now:
                    if held:
                        yield told()
                    held, now = [], first
                held.append(pdf[t].to_numpy(dtype=float)[lo:hi])
        if held:
            yield told()

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, given, last = pdf.sort_values("__range"), [], None
        for upto, out in zip(pdf["upto"], pdf["out"]):
            given.append(last)
            k = 0 if last is None else int(np.argmax(upto - last >= gap)) if upto[-1] - last >= gap else -1
            last = last if k < 0 else float(out[k])
        return pdf[["__range", key]].assign(given=np.array(given, dtype=float))

    ordered = deal.dealt(deal.of_several(rows)).sortWithinPartitions("__range", key, t)
    ways = ordered.mapInPandas(tell, f"__range int, {key} {kind}, upto array<double>, out array<double>")
    # a row a range of a key with several, at most two a range
    given = ways.groupBy(key).applyInPandas(follow, f"__range int, {key} {kind}, given double").select(F.col("__range").alias("__r"), F.col(key).alias("__k"), "given")
    met = deal.dealt(rows).join(F.broadcast(given), (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")), "left").select("__range", key, t, "given")
    return met.sortWithinPartitions("__range", key, t).mapInPandas(_thinning(key, t, gap, ["__range", key], "given"), f"{key} {kind}, {t} double")


def around(queries: DataFrame, times: DataFrame, key: str, t: str, value: Column, wide: bool = False) -> DataFrame:
    """queries with `before` and `after`: value at the last of the times up to and the first from each query's time on; one ordered pass, no join.

    A key is one window's group; if `wide` it is dealt by ranges of time, with the rows next to their borders carried: both tables are then read three times."""
    row, asked = F.struct(*queries.columns), queries.select(F.struct(*queries.columns).alias("row")).schema["row"].dataType
    both = queries.select(F.col(key).alias("k"), F.col(t).alias("at"), row.alias("row"), F.lit(None).cast(times.select(value.alias("v")).schema["v"].dataType).alias("v")).unionByName(
        times.select(F.col(key).alias("k"), F.col(t).alias("at"), F.lit(None).cast(asked).alias("row"), value.alias("v"))
    )
    if wide:
        got = Ranges("k", "at", both).running(both, {"before": ("last", F.col("v"))}, {"after": ("first", F.col("v"))})
    else:
        # both frames grow: the second goes back from the end
        before, after = (F.last("v", True).over(Window.partitionBy("k").orderBy(by("at")).rangeBetween(Window.unboundedPreceding, 0)) for by in (F.asc, F.desc))
        got = both.select("row", before.alias("before"), after.alias("after"))
    return got.where("row IS NOT NULL").select("row.*", "before", "after")


def nearest_distance(queries: DataFrame, times: DataFrame, key: str, t: str, name: str, far: float = 1e9, wide: bool = False) -> DataFrame:
    """queries with `name`: the distance to the nearest of the key's times; `far` for a key without any."""
    got = around(queries, times, key, t, F.col(t), wide)
    least = F.least(F.coalesce(F.col(t) - F.col("before"), F.lit(far)), F.coalesce(F.col("after") - F.col(t), F.lit(far)))
    return got.select(*queries.columns, least.alias(name))


def nearest(queries: DataFrame, rows: DataFrame, key: str, t: str, value: str, wide: bool = False) -> DataFrame:
    """queries with `value` of the nearest row in time, the earlier one on a tie; null for a key without any. Of rows at one time any may be taken."""
    got = around(queries, rows, key, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")), wide)
    back, ahead = F.col(t) - F.col("before.t"), F.col("after.t") - F.col(t)
    return got.select(*queries.columns, F.when(F.col("after").isNull() | (back <= ahead), F.col("before.v")).otherwise(F.col("after.v")).alias(value))


def interpolate(knots: DataFrame, queries: DataFrame, key: str, t: str, value: str, wide: bool = False) -> DataFrame:
    """Linear interpolation of a curve at the queries' times, constant beyond its ends: one shuffle, no join. Of knots at one time any may be taken. `wide` as in around()."""
    got = around(queries.select(key, t), knots, key, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")), wide)
    line = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * (F.col(t) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    return got.select(key, t, F.when(F.col("before").isNull(), F.col("after.v")).when(F.col("after").isNull() | (F.col("after.t") == F.col("before.t")), F.col("before.v")).otherwise(line).alias(value))


def time_slice(df: DataFrame, t: str, start: Column, end: Column | None = None) -> DataFrame:
    """df from start on and before end, with times from the slice's start; an end that is null or not after the start is the end of the track."""
    inside = F.col(t) >= start
    if end is not None:
        inside = inside & (F.coalesce(end <= start, F.lit(True)) | (F.col(t) < end))
    return df.where(inside).withColumn(t, F.col(t) - start)


def timeline(cuts: DataFrame, key: str, t: str, duration: float, fps: float) -> DataFrame:
    """Frame-exact segments (key, seg_idx, start_frame, n_frames): every absolute time is rounded to its frame,
    so lengths never drift; both ends are always there and cuts in one frame are one."""
    if fps <= 0 or duration <= 0:
        raise ValueError("fps and duration must be positive")
    end = round(duration * fps)
    inner = cuts.where((F.col(t) > 0) & (F.col(t) < duration)).select(key, F.least(F.greatest(F.rint(F.col(t) * fps).cast("long"), F.lit(0)), F.lit(end)).alias("f"))
    ends = cuts.select(key).distinct().select(key, F.explode(F.array(F.lit(0).cast("long"), F.lit(end).cast("long"))).alias("f"))
    o = Window.partitionBy(key).orderBy("f")
    cut = inner.unionByName(ends).distinct().select(key, F.col("f").alias("start_frame"), F.lead("f").over(o).alias("z"), (F.row_number().over(o) - 1).alias("seg_idx"))
    return cut.where(F.col("z").isNotNull()).select(key, "seg_idx", "start_frame", (F.col("z") - F.col("start_frame")).alias("n_frames"))
