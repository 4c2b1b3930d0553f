"""All registered queries of the cue, section and planning operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves as C
from ..operators import planning as P
from ..operators import ranks as R
from ..sources import views as V
from ..sources.shared import written
from . import cues, ingest, library, scenes, streams  # noqa: F401 - they register their queries
from .base import QUERIES, SQL, by_beat, by_track, query, r6

K = ("track_id", "beat_idx")

_NORM = "CASE WHEN hi - lo >= 1e-8 THEN least(greatest((rms - lo)/(hi - lo), 0.0), 1.0) ELSE 0.0 END"
_PCT = "quantile_cont(rms, 0.02) OVER (PARTITION BY track_id) AS lo, quantile_cont(rms, 0.98) OVER (PARTITION BY track_id) AS hi"
_THIN = """, o AS (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM beats),
kept(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM o WHERE rn = 1
 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= 0.3 THEN o.t ELSE k.last END, o.t - k.last >= 0.3
 FROM kept k JOIN o ON o.track_id = k.track_id AND o.rn = k.rn + 1)"""


@query(f"""WITH RECURSIVE {V.EVENTS_SQL}{_THIN}, f AS (SELECT DISTINCT track_id, CAST(round_even(t*30.0, 0) AS BIGINT) AS f FROM kept WHERE keep AND t > 0 AND t < 48
 UNION SELECT DISTINCT track_id, 0 FROM beats UNION SELECT DISTINCT track_id, 1440 FROM beats),
c AS (SELECT track_id, f AS start_frame, lead(f) OVER w AS z, row_number() OVER w - 1 AS seg_idx FROM f WINDOW w AS (PARTITION BY track_id ORDER BY f))
SELECT track_id, seg_idx, start_frame, z - start_frame AS n_frames FROM c WHERE z IS NOT NULL""")
def cue_timeline(spark, d):
    cuts = C.thin(V.beats(spark, d), "track_id", "t", 0.3)
    return C.timeline(cuts, "track_id", "t", V.DURATION, V.FPS)


@query(f"WITH RECURSIVE {V.EVENTS_SQL}{_THIN} SELECT track_id, round(t, 6) AS t FROM kept WHERE keep")
def f1_min_gap_thinning(spark, d):
    """Each key dealt to as many tasks as its rows need."""
    return C.thin_wide(written(V.beats(spark, d).select("track_id", "t")), "track_id", "t", 0.3).select("track_id", r6(F.col("t"), "t"))


@query(f"WITH {V.EVENTS_SQL}, p AS (SELECT *, {_PCT} FROM curves) SELECT track_id, beat_idx, round({_NORM}, 6) AS x FROM p")
def c1_robust_normalise(spark, d):
    x = F.col("rms")
    return R.with_percentiles(V.curves(spark, d), "track_id", {"lo": (x, 0.02), "hi": (x, 0.98)}).select(*K, r6(C.scaled(x, F.col("lo"), F.col("hi")), "x"))


@query(f"""WITH {V.EVENTS_SQL}, n AS (SELECT *, count(*) OVER g AS n, row_number() OVER o AS rn, first_value(rms) OVER fu AS a, last_value(rms) OVER fu AS z,
 sum(rms) OVER (PARTITION BY track_id ORDER BY beat_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS s FROM curves
 WINDOW g AS (PARTITION BY track_id), o AS (PARTITION BY track_id ORDER BY beat_idx), fu AS (PARTITION BY track_id ORDER BY beat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT track_id, beat_idx, round(CASE WHEN n < 3 THEN rms ELSE (s + greatest(0, 8-(rn-1))*a + greatest(0, 8-(n-rn))*z)/17 END, 6) AS x FROM n""")
def c2_smooth(spark, d):
    return V.curves(spark, d).select(*K, r6(C.smooth(F.col("rms"), "track_id", "beat_idx", 16), "x"))


@query(f"""WITH {V.EVENTS_SQL}, p AS (SELECT *, round(quantile_cont(rms, .88) OVER g, 9) AS p88, round(quantile_cont(rms, .72) OVER g, 9) AS p72, round(quantile_cont(rms, .30) OVER g, 9) AS p30
 FROM curves WINDOW g AS (PARTITION BY track_id)) SELECT track_id, beat_idx, CASE WHEN round(rms,9) >= p88 THEN 'peak' WHEN round(rms,9) >= p72 THEN 'high' WHEN round(rms,9) <= p30 THEN 'low' ELSE 'medium' END AS level FROM p""")
def b7_energy_level(spark, d):
    x = F.round("rms", 9)
    known = R.with_percentiles(V.curves(spark, d), "track_id", {f"p{q}": (F.col("rms"), q / 100) for q in (88, 72, 30)})
    p = lambda q: F.round(f"p{q}", 9)
    level = F.when(x >= p(88), "peak").when(x >= p(72), "high").when(x <= p(30), "low").otherwise("medium")
    return known.select(*K, level.alias("level"))


@query(f"""WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, round(kick,9) >= round(quantile_cont(kick,.72) OVER g,9) AS kick, round(clap,9) >= round(quantile_cont(clap,.74) OVER g,9) AS clap,
 round(hihat,9) >= round(quantile_cont(hihat,.82) OVER g,9) AS hihat, round(bass,9) >= round(quantile_cont(bass,.74) OVER g,9) AS bass FROM curves WINDOW g AS (PARTITION BY track_id)""")
def b8_strong_hits(spark, d):
    least = {"kick": 0.72, "clap": 0.74, "hihat": 0.82, "bass": 0.74}
    known = R.with_percentiles(V.curves(spark, d), "track_id", {f"p_{c}": (F.col(c), q) for c, q in least.items()})
    return known.select(*K, *[(F.round(c, 9) >= F.round(f"p_{c}", 9)).alias(c) for c in least])


@query(f"""WITH {V.EVENTS_SQL}, l AS (SELECT *, lag(rms) OVER w AS a, lead(rms) OVER w AS b FROM curves WINDOW w AS (PARTITION BY track_id ORDER BY beat_idx))
SELECT track_id, beat_idx, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b-rms WHEN b IS NULL THEN rms-a ELSE (b-a)/2 END, 6) AS x FROM l""")
def c4_gradient(spark, d):
    return V.curves(spark, d).select(*K, r6(C.gradient(F.col("rms"), "track_id", "beat_idx"), "x"))


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, beat_idx % 4 = 0 AS bar, beat_idx % 8 = 0 AS phrase FROM beats")
def c5_anchors(spark, d):
    at = F.row_number().over(by_beat()) - 1
    return V.beats(spark, d).select(*K, (at % 4 == 0).alias("bar"), (at % 8 == 0).alias("phrase"))


@query(f"""WITH {V.EVENTS_SQL}, g AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS dt FROM beats)
SELECT track_id, round(avg(dt), 6) AS mean_gap, round(quantile_cont(dt, .5), 6) AS median_gap FROM g GROUP BY track_id""")
def c6_intervals(spark, d):
    gaps = V.beats(spark, d).select("track_id", (F.col("t") - F.lag("t").over(by_beat())).alias("dt"))
    return gaps.groupBy("track_id").agg(r6(F.avg("dt"), "mean_gap"), r6(F.percentile("dt", F.lit(0.5)), "median_gap"))


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, round(CASE WHEN max(abs(value-35)) OVER (PARTITION BY track_id) = 0 THEN 0 ELSE (value-35)/max(abs(value-35)) OVER (PARTITION BY track_id) END, 6) AS x FROM beats")
def d1_peak_normalise(spark, d):
    amp = F.col("value") - 35
    top = F.max(F.abs(amp)).over(by_track())
    return V.beats(spark, d).select(*K, r6(F.when(top == 0, 0.0).otherwise(amp / top), "x"))


@query(f"""WITH {V.EVENTS_SQL}, f AS (SELECT track_id, unnest(range(greatest(0, CAST(ceil((beat_idx-7)/2.0) AS BIGINT)), beat_idx//2 + 1)) AS frame, value-35 AS amp FROM beats)
SELECT track_id, frame, round(sqrt(avg(amp*amp)), 6) AS rms FROM f GROUP BY ALL""")
def d2_sliding_rms(spark, d):
    first = F.greatest(F.lit(0), F.ceil((F.col("beat_idx") - 7) / 2).cast("int"))
    rows = V.beats(spark, d).select("track_id", F.explode(F.sequence(first, F.floor(F.col("beat_idx") / 2).cast("int"))).alias("frame"), (F.col("value") - 35).alias("amp"))
    return rows.groupBy("track_id", "frame").agg(r6(F.sqrt(F.avg(F.col("amp") * F.col("amp"))), "rms"))


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, round(pow(greatest(0.0, sin(pi()*least(greatest(t/48.0,0.0),1.0))), 0.65), 6) AS arc FROM beats")
def b6_position_arc(spark, d):
    x = F.least(F.greatest(F.col("t") / V.DURATION, F.lit(0.0)), F.lit(1.0))
    return V.beats(spark, d).select(*K, r6(F.pow(F.greatest(F.lit(0.0), F.sin(F.pi() * x)), F.lit(0.65)), "arc"))


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, round(t - 10.0, 6) AS t FROM beats WHERE t >= 10 AND t < 40")
def a3_time_slice(spark, d):
    return V.beats(spark, d).where((F.col("t") >= 10) & (F.col("t") < 40)).select(*K, r6(F.col("t") - 10.0, "t"))


@query(f"""WITH {V.EVENTS_SQL}, q AS (SELECT DISTINCT track_id, unnest(range(0, 48)) + 0.25 AS t FROM beats),
a AS (SELECT q.track_id, q.t, (SELECT max(b.t) FROM curves b WHERE b.track_id=q.track_id AND b.t<=q.t) AS ta, (SELECT min(b.t) FROM curves b WHERE b.track_id=q.track_id AND b.t>=q.t) AS tb FROM q)
SELECT a.track_id, round(a.t, 6) AS t, round(CASE WHEN ta IS NULL THEN y.rms WHEN tb IS NULL OR ta=tb THEN x.rms ELSE x.rms+(y.rms-x.rms)*(a.t-ta)/(tb-ta) END, 6) AS rms
FROM a LEFT JOIN curves x ON x.track_id=a.track_id AND x.t=ta LEFT JOIN curves y ON y.track_id=a.track_id AND y.t=tb""")
def e3_interpolate(spark, d):
    curve = written(V.curves(spark, d).select("track_id", "t", "rms"))
    at = curve.select("track_id").distinct().select("track_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: i + F.lit(0.25).cast("double"))).alias("t"))
    return C.interpolate(curve, at, "track_id", "t", "rms", wide=True).select("track_id", r6(F.col("t"), "t"), r6(F.col("rms"), "rms"))


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, CAST(round_even(t*30.0,0) AS BIGINT) AS frame, CAST(greatest(round_even((t+0.25)*30.0,0),0) AS BIGINT) AS middle, round(beat_idx*512/22050.0, 6) AS seconds FROM beats")
def b4_frame_conversion(spark, d):
    t, fps = F.col("t"), F.lit(V.FPS)
    return V.beats(spark, d).select(*K, S.seconds_to_frames(t, fps).alias("frame"), S.middle_frame(t, t + 0.5, fps).alias("middle"), r6(S.frames_to_seconds(F.col("beat_idx")), "seconds"))


@query("SELECT c_custkey, substr(sha1(c_name), 1, 10) AS h FROM customer")
def b23_text_hash(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", F.substring(F.sha1("c_name"), 1, 10).alias("h"))


@query("""WITH m AS (SELECT doc_id, greatest(n_chars, 0) AS n FROM documents), r AS (SELECT doc_id, n, n // 100 + CASE WHEN n % 100 > 50 OR (n % 100 = 50 AND (n // 100) % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM m)
SELECT doc_id, CASE WHEN n < 1000 THEN concat(n, 'ms') ELSE concat(tenths // 10, '.', tenths % 10, 's') END AS said FROM r""")
def b31_duration_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.duration_text(F.col("n_chars")).alias("said"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN round(c_acctbal, 6) WHEN 1 THEN 120.0 WHEN 2 THEN 120.0 ELSE 7.5 END AS x FROM customer""")
def b2_first_number(spark, d):
    """The first element of an array as a number, else 120: of a balance, of nothing, of a name, of text that is a number."""
    text = lambda c: F.array(c.cast("string"), F.lit("1"))
    k = F.col("c_custkey") % 4
    values = F.when(k == 0, text(F.col("c_acctbal"))).when(k == 1, F.array().cast("array<string>")).when(k == 2, text(F.col("c_name"))).otherwise(text(F.lit("7.5")))
    return V.table(spark, d, "customer").select("c_custkey", r6(S.first_number(values, 120.0), "x"))


@query(f"""WITH {V.MOMENTS_SQL} SELECT video_id, id, printf('%s_%05d_%08d', substr(sha1('/src/' || video_id || '.mp4'), 1, 10), CAST(id AS INT), CAST(trunc((id - 1) * 2.0 * 1000) AS INT)) AS moment_id FROM moments""")
def b24_moment_ids(spark, d):
    m = V.moments_big(spark, d)
    path = F.concat(F.lit("/src/"), "video_id", F.lit(".mp4"))
    return m.select("video_id", "id", S.moment_id(path, F.col("id"), (F.col("id") - 1) * 2.0).alias("moment_id"))


@query(r"""SELECT p_partkey, substr(regexp_replace(p_name || ' / ' || p_brand || '#', '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 80) AS token, CASE WHEN p_partkey % 3 = 0 THEN 'item' ELSE 'p' END AS other,
 trim(regexp_replace(regexp_replace(concat('  ', p_name, chr(9), 'é  ', p_brand, ' '), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM part""")
def b30_clean_tokens(spark, d):
    """File tokens of a name, of nothing; and a name as plain ASCII words."""
    p = V.table(spark, d, "part")
    name = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("#"))
    other = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise("p")
    plain = F.concat(F.lit("  "), "p_name", F.lit("\té  "), "p_brand", F.lit(" "))
    return p.select("p_partkey", S.safe_token(name).alias("token"), S.safe_token(other).alias("other"), S.plain_text(plain).alias("plain"))


@query(f"""WITH {V.EVENTS_SQL}, w AS (SELECT *, CASE track_id % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 10.0 ELSE 40.0 END AS a, CASE track_id % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 10.0 ELSE 8.0 END AS z FROM beats)
SELECT track_id, beat_idx, round(t - a, 6) AS t FROM w WHERE t >= a AND (z <= a OR t < z)""")
def a3_open_slice(spark, d):
    """A part of each track, re-based to its start; an end that is not after the start means the end of the track."""
    b = V.beats(spark, d)
    k = F.col("track_id") % 3
    start, end = F.when(k == 0, 5.0).when(k == 1, 10.0).otherwise(40.0), F.when(k == 0, 30.0).when(k == 1, 10.0).otherwise(8.0)
    return C.time_slice(b, "t", start, end).select(*K, r6("t", "t"))


@query(f"""WITH {V.EVENTS_SQL}, o AS (SELECT track_id, beat_idx, flux AS x FROM curves), p AS (SELECT a.track_id, lag AS l, coalesce(sum(a.x * b.x), 0) * 1.0 AS s FROM (SELECT *, unnest(range(2, 25)) AS lag FROM o) a LEFT JOIN o b ON b.track_id = a.track_id AND b.beat_idx = a.beat_idx + lag GROUP BY ALL)
SELECT track_id, round(480.0 / arg_max(l, struct_pack(s := round(s * exp(-0.5 * pow(log2(480.0 / l / 120.0), 2)), 6), k := -l)), 6) AS tempo FROM p GROUP BY track_id""")
def d14_tempo(spark, d):
    """Tempo of the change curve, taken as eight frames a second."""
    return P.tempo(V.curves(spark, d), "track_id", "beat_idx", "flux", 8.0).select("track_id", r6("tempo", "tempo"))


_TEMPO = f"""{V.EVENTS_SQL}, o AS (SELECT track_id, beat_idx, flux AS x FROM curves), p AS (SELECT a.track_id, lag AS l, coalesce(sum(a.x * b.x), 0) * 1.0 AS s FROM (SELECT *, unnest(range(2, 25)) AS lag FROM o) a LEFT JOIN o b ON b.track_id = a.track_id AND b.beat_idx = a.beat_idx + lag GROUP BY ALL),
tempo AS (SELECT track_id, 480.0 / arg_max(l, struct_pack(s := round(s * exp(-0.5 * pow(log2(480.0 / l / 120.0), 2)), 6), k := -l)) AS tempo FROM p GROUP BY track_id)"""


@query(f"""WITH RECURSIVE {_TEMPO}, c AS MATERIALIZED (SELECT o.track_id, greatest(1, CAST(round_even(480.0 / any_value(tempo), 0) AS INT)) AS P, list(x ORDER BY beat_idx) AS X, coalesce(stddev_samp(x), 0) AS dev FROM o JOIN tempo t ON t.track_id = o.track_id GROUP BY o.track_id),
dp(track_id, i, C, B) AS (SELECT track_id, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]) FROM c
 UNION ALL SELECT track_id, i + 1, list_append(C, CASE WHEN dev > 0 THEN X[i + 1] / dev ELSE 0 END + CASE WHEN top > 0 THEN top ELSE 0 END), list_append(B, CASE WHEN top > 0 THEN lo + list_position(S, top) - 1 ELSE 0 END)
  FROM (SELECT *, list_max(S) AS top FROM (SELECT c.*, dp.i, dp.C, dp.B, (P + 1) // 2 AS lo, [dp.C[dp.i - lag + 1] - 100.0 * pow(ln(lag / P), 2) for lag in range((P + 1) // 2, least(2 * P, dp.i) + 1)] AS S FROM dp JOIN c ON c.track_id = dp.track_id WHERE dp.i < len(c.X)))),
e AS MATERIALIZED (SELECT track_id, C, B, [x for x in range(greatest(0, i - P), i)] AS R FROM (SELECT dp.*, c.P FROM dp JOIN c ON c.track_id = dp.track_id WHERE dp.i = len(c.X))),
back(track_id, f) AS (SELECT track_id, CAST((SELECT arg_max(x, struct_pack(s := C[x + 1], x := x)) FROM unnest(R) t(x)) AS BIGINT) FROM e UNION ALL SELECT b.track_id, f - B[f + 1] FROM back b JOIN e ON e.track_id = b.track_id WHERE B[f + 1] > 0)
SELECT track_id, f AS frame FROM back""")
def d14_beats(spark, d):
    """The beats of the change curve: a chain of frames about a period of the tempo apart with the greatest sum."""
    curve = written(V.curves(spark, d).select("track_id", "beat_idx", "flux"))
    return P.track_beats(curve, "track_id", "beat_idx", "flux", 8.0)


@query(f"""WITH RECURSIVE {V.EVENTS_SQL}, w AS (SELECT track_id, beat_idx, rms AS x, max(rms) OVER (PARTITION BY track_id ORDER BY beat_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(rms) OVER (PARTITION BY track_id ORDER BY beat_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mean,
 lag(rms) OVER g AS a, lead(rms) OVER g AS b FROM curves WINDOW g AS (PARTITION BY track_id ORDER BY beat_idx)),
v AS (SELECT *, CASE WHEN x <= coalesce(a, x) AND x <= coalesce(b, x) AND (a > x OR b > x) THEN beat_idx END AS low FROM w),
s AS MATERIALIZED (SELECT *, last_value(low IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY beat_idx) AS start FROM v),
o AS MATERIALIZED (SELECT track_id, beat_idx, start, row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) AS rn FROM s WHERE x >= top AND round(x - mean, 9) > 0),
k(track_id, rn, beat_idx, start, last, keep) AS (SELECT track_id, rn, beat_idx, start, beat_idx, true FROM o WHERE rn = 1 UNION ALL SELECT o.track_id, o.rn, o.beat_idx, o.start, CASE WHEN o.beat_idx - k.last >= 4 THEN o.beat_idx ELSE k.last END, o.beat_idx - k.last >= 4
 FROM k JOIN o ON o.track_id = k.track_id AND o.rn = k.rn + 1) SELECT track_id, beat_idx AS peak, coalesce(start, beat_idx) AS start FROM k WHERE keep""")
def c8_peaks(spark, d):
    return P.peaks(V.curves(spark, d), "track_id", "beat_idx", "rms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
