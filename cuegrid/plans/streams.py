"""Streaming queries, drained, with the SQL of their batch results; and reports over the timeline."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import features as O
from ..sources import views as V
from ..sources.shared import written
from ..streaming import cues as T
from .base import by_beat, query, r6
from .cues import SECTIONS_SQL, _features, _sections


def _thinned(gap: float, table: str = "beats") -> str:
    return f""", to_ AS MATERIALIZED (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM {table}),
tk(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM to_ WHERE rn = 1 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= {gap} THEN o.t ELSE k.last END, o.t - k.last >= {gap}
 FROM tk k JOIN to_ o ON o.track_id = k.track_id AND o.rn = k.rn + 1)"""


@query(f"WITH RECURSIVE {V.EVENTS_SQL}{_thinned(0.58)} SELECT track_id, round(t, 6) AS t FROM tk WHERE keep AND t <= (SELECT (max(epoch_us(ts)) - 259200000000 - 1704067200000000) / 54000000000.0 FROM events)")
def k1_stream_thinning(spark, d):
    """The events as a stream of eight files, one a batch, whose times overlap: what comes early waits for the watermark, the last kept
    time is carried over. Times within three days of the newest event are still open."""
    us = F.unix_micros("at") - F.lit(1704067200000000)
    s = T.event_stream(spark, d, 8).select(F.col("user_id").alias("track_id"), "at", (us / F.lit(54000000000.0)).alias("t"))
    return T.drained(T.thin_stream(s, "track_id", "at", "t", 0.58, "3 days")).select("track_id", r6("t", "t"))


@query(f"WITH {V.FRAMES_SQL} SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 2 ELSE 1 END AS batch, duration + CASE WHEN video_id % 2 = 0 THEN 1 ELSE 0 END AS duration FROM sources")
def k2_incremental_library(spark, d):
    """A library kept by signature: all sources arrive, then all again, of which every second has changed; only these are worked on again."""
    from .scenes import _signed

    first = _signed(spark, d).select("video_id", "signature", "duration")
    changed = F.col("video_id") % 2 == 0
    again = first.select("video_id", F.when(changed, F.concat("signature", F.lit("x"))).otherwise(F.col("signature")).alias("signature"), (F.col("duration") + changed.cast("int")).alias("duration"))
    return T.keep_library(spark, [first, again])


@query("""WITH w AS (SELECT event_type, value, (epoch_us(ts) // 10800000000 - k) * 10800 AS start FROM events, (SELECT unnest([0, 1]) AS k)), m AS (SELECT max(epoch_us(ts)) / 1000000 - 86400 AS mark FROM events)
SELECT event_type, start AS start_s, round(sum(value), 4) AS energy, count(*) AS n FROM w, m WHERE start + 21600 <= mark GROUP BY event_type, start, mark""")
def k3_stream_energy(spark, d):
    """Energy by event type in windows of six hours, every three; windows within a day of the newest event are still open."""
    s = T.energy_stream(T.event_stream(spark, d), "at", "event_type", "value", "6 hours", "3 hours", "1 day")
    return T.drained(s).select("event_type", F.unix_seconds("start").alias("start_s"), F.round("energy", 4).alias("energy"), "n")


@query(f"WITH RECURSIVE {V.EVENTS_SQL}, r AS (SELECT DISTINCT track_id, round(least(greatest(t, 0.0), 48.0), 3) AS t FROM beats UNION SELECT DISTINCT track_id, 0.0 FROM beats UNION SELECT DISTINCT track_id, 48.0 FROM beats), "
       + """ro AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM r), k(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM ro WHERE rn = 1
 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= 2.5 OR o.t = 48 THEN o.t ELSE k.last END, o.t - k.last >= 2.5 OR o.t = 48 FROM k JOIN ro o ON o.track_id = k.track_id AND o.rn = k.rn + 1)
SELECT track_id, t FROM k WHERE keep""")
def f2_merge_boundaries(spark, d):
    return O.merge_boundaries(written(V.beats(spark, d).select("track_id", "t")), "track_id", "t", V.DURATION, 2.5, wide=True)


@query(f"""WITH RECURSIVE {V.EVENTS_SQL}{_thinned(0.9)}, b AS (SELECT beats.track_id, beat_idx, beats.t, (SELECT max(x.t) FROM tk x WHERE x.keep AND x.track_id = beats.track_id AND x.t <= beats.t) AS p,
 (SELECT min(x.t) FROM tk x WHERE x.keep AND x.track_id = beats.track_id AND x.t >= beats.t) AS q FROM beats)
SELECT track_id, beat_idx, round(least(coalesce(t - p, 1e9), coalesce(q - t, 1e9)), 6) AS distance FROM b""")
def e4_nearest_distance(spark, d):
    """From every beat to the nearest time of a thinned set: both sides in one ordered pass, no join, no key in one task."""
    beats = written(V.beats(spark, d).select("track_id", "beat_idx", "t"))
    got = C.nearest_distance(beats, written(C.thin_wide(beats, "track_id", "t", 0.9)), "track_id", "t", "distance", wide=True)
    return got.select("track_id", "beat_idx", r6("distance", "distance"))


@query(f"""WITH {V.EVENTS_SQL}, g AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS x FROM beats)
SELECT track_id, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, .5), 6) AS p50, round(quantile_cont(x, .9), 6) AS p90, round(max(x), 6) AS longest, round(count(x) / sum(x), 6) AS rate FROM g GROUP BY track_id""")
def d11_timing_statistics(spark, d):
    gaps = V.beats(spark, d).select("track_id", (F.col("t") - F.lag("t").over(by_beat())).alias("x"))
    return gaps.groupBy("track_id").agg(
        F.count("x").alias("n"), r6(F.avg("x"), "mean"), r6(F.percentile("x", F.lit(0.5)), "p50"), r6(F.percentile("x", F.lit(0.9)), "p90"), r6(F.max("x"), "longest"), r6(F.count("x") / F.sum("x"), "rate"),
    )


@query(f"""WITH RECURSIVE {SECTIONS_SQL}, st AS (SELECT track_id, count(*) AS strong FROM (SELECT track_id, round(impact, 9) >= round(quantile_cont(impact, .88) OVER (PARTITION BY track_id), 9) AS hit FROM feat) WHERE hit GROUP BY track_id)
SELECT s.track_id, arg_max(type, struct_pack(a := round(e - s, 6), b := -section_idx)) AS longest_type, round(max(e - s), 6) AS longest, array_to_string(list_slice(list(type ORDER BY section_idx), 1, 5), ',') AS first_types, any_value(strong) AS strong
FROM sections s JOIN st ON st.track_id = s.track_id GROUP BY s.track_id""")
def d15_top_facts(spark, d):
    """The longest section, the first five types and the number of strong impacts of each track."""
    length = F.round(F.col("end") - F.col("start"), 6)
    feat = written(_features(spark, d))
    s = _sections(spark, d, feat).groupBy("track_id").agg(
        F.max_by("type", F.struct(length, -F.col("section_idx"))).alias("longest_type"), F.max(length).alias("longest"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("section_idx", "type"))), 1, 5), lambda x: x["type"]), ",").alias("first_types"),
    )
    top = F.round(C.percentile(F.col("impact"), 0.88, Window.partitionBy("track_id")), 9)
    strong = feat.select("track_id", (F.round("impact", 9) >= top).alias("hit")).groupBy("track_id").agg(F.count_if("hit").alias("strong"))
    return s.join(strong, "track_id")
