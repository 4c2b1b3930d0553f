"""Queries over frames, scenes and sources, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves as C
from ..operators import ranks as R
from ..operators import scenes as O
from ..sources import views as V
from ..sources.shared import written
from .base import query, r6

_CHANGES = """o AS MATERIALIZED (SELECT video_id, round(t, 3) AS t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS rn FROM motions WHERE 2 * motion > 0.30),
k(video_id, rn, t, last, keep) AS (SELECT video_id, rn, t, t, true FROM o WHERE rn = 1 UNION ALL
 SELECT o.video_id, o.rn, o.t, CASE WHEN o.t - k.last >= 0.08 THEN o.t ELSE k.last END, o.t - k.last >= 0.08 FROM k JOIN o ON o.video_id = k.video_id AND o.rn = k.rn + 1)"""
_WINDOWS = """, raw AS (SELECT k.video_id, t FROM k JOIN sources s ON s.video_id = k.video_id WHERE keep AND t > 0 AND t < duration
 UNION SELECT video_id, 0.0 FROM sources UNION SELECT video_id, round(duration, 3) FROM sources),
p AS MATERIALIZED (SELECT raw.video_id, t, duration, row_number() OVER (PARTITION BY raw.video_id ORDER BY t) AS rn FROM raw JOIN sources s ON s.video_id = raw.video_id),
q(video_id, rn, t, last, keep) AS (SELECT video_id, rn, t, t, true FROM p WHERE rn = 1 UNION ALL
 SELECT p.video_id, p.rn, p.t, CASE WHEN p.t - q.last >= 0.35 OR p.t = p.duration THEN p.t ELSE q.last END, p.t - q.last >= 0.35 OR p.t = p.duration
 FROM q JOIN p ON p.video_id = q.video_id AND p.rn = q.rn + 1),
sc AS (SELECT video_id, row_number() OVER w - 1 AS scene_index, t AS a, lead(t) OVER w AS z FROM q WHERE keep WINDOW w AS (PARTITION BY video_id ORDER BY t)),
ch AS (SELECT *, greatest(1, CAST(ceil((z - a) / 5.2) AS INT)) AS n FROM sc WHERE z - a >= 0.55),
wi AS (SELECT video_id, scene_index, a + c * ((z - a) / n) AS s, least(z, a + c * ((z - a) / n) + 5.2) AS e, CASE WHEN n = 1 THEN 'scene' ELSE 'scene_chunk' END AS kind FROM (SELECT *, unnest(range(0, n)) AS c FROM ch)),
windows AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS window_idx FROM wi WHERE e - s >= 0.55)"""
_SAMPLES = """, sa AS (SELECT *, CAST(least(greatest(ceil((e - s) * 1.4), 3), 8) AS INT) AS n FROM windows WHERE e - s > 0.05),
sb AS (SELECT *, s + (e - s) * 0.12 + sample_idx * ((e - s) * 0.76) / (n - 1) AS sample_t FROM (SELECT *, unnest(range(0, n)) AS sample_idx FROM sa)),
samples AS (SELECT *, CAST(greatest(round_even(sample_t * 2.0, 0), 0) AS BIGINT) AS frame_idx FROM sb)"""


def _changes(spark, d):
    scored = O.frame_motion(V.frames(spark, d)).withColumn("score", 2 * F.col("motion"))
    return O.scene_changes(scored, "score", 0.30)


def _windows(spark, d):
    return O.scene_windows(_changes(spark, d), V.sources(spark, d))


@query(f"WITH {V.FRAMES_SQL} SELECT video_id, frame_idx, round(motion, 6) AS motion FROM motions")
def c9_frame_motion(spark, d):
    return O.frame_motion(V.frames(spark, d)).select("video_id", "frame_idx", r6("motion", "motion"))


@query(f"WITH RECURSIVE {V.FRAMES_SQL}, {_CHANGES} SELECT video_id, t FROM k WHERE keep")
def f7_scene_changes(spark, d):
    return _changes(spark, d)


@query(f"WITH RECURSIVE {V.FRAMES_SQL}, {_CHANGES}{_WINDOWS} SELECT video_id, window_idx, scene_index, round(s, 6) AS \"start\", round(e, 6) AS \"end\", kind FROM windows")
def f8_candidate_windows(spark, d):
    return _windows(spark, d).select("video_id", "window_idx", "scene_index", r6("start", "start"), r6("end", "end"), "kind")


@query(f"WITH RECURSIVE {V.FRAMES_SQL}, {_CHANGES}{_WINDOWS}{_SAMPLES} SELECT video_id, window_idx, sample_idx, round(sample_t, 6) AS sample_t, frame_idx FROM samples")
def f9_sample_plan(spark, d):
    return O.sample_plan(_windows(spark, d), 2.0).select("video_id", "window_idx", "sample_idx", r6("sample_t", "sample_t"), "frame_idx")


_STATS = """, px AS (SELECT video_id, frame_idx, [(CAST(v AS DOUBLE) + 0.6) / 1.2 * 255 for v in vec] AS g FROM frames),
py AS (SELECT *, [g[(i + 21) % 64 + 1] for i in range(0, 64)] AS r, [g[(i + 42) % 64 + 1] for i in range(0, 64)] AS b FROM px),
pz AS (SELECT *, [0.114 * b[i] + 0.587 * g[i] + 0.299 * r[i] for i in range(1, 65)] AS gray, [CASE WHEN greatest(b[i], g[i], r[i]) > 0 THEN (greatest(b[i], g[i], r[i]) - least(b[i], g[i], r[i])) / greatest(b[i], g[i], r[i]) ELSE 0.0 END for i in range(1, 65)] AS sat,
 [abs(r[i] - g[i]) for i in range(1, 65)] AS rg, [abs(0.5 * (r[i] + g[i]) - b[i]) for i in range(1, 65)] AS yb FROM py),
pl AS (SELECT *, [gray[CASE WHEN i % 8 > 0 THEN i ELSE i + 2 END] + gray[CASE WHEN i % 8 < 7 THEN i + 2 ELSE i END] + gray[CASE WHEN i // 8 > 0 THEN i - 7 ELSE i + 9 END] + gray[CASE WHEN i // 8 < 7 THEN i + 9 ELSE i - 7 END] - 4 * gray[i + 1] for i in range(0, 64)] AS lap FROM pz),
stats AS MATERIALIZED (SELECT video_id, frame_idx, gray, list_avg(gray) / 255 AS brightness, list_stddev_pop(gray) / 80 AS contrast, list_avg(sat) AS saturation, list_var_pop(lap) / 520 AS sharpness, (list_stddev_pop(rg) + list_stddev_pop(yb)) / 95 AS colorfulness FROM pl)"""
_C01 = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_METRICS = f""", sj AS (SELECT p.*, t.* EXCLUDE (video_id, frame_idx), lag(gray) OVER (PARTITION BY p.video_id, p.window_idx ORDER BY sample_idx) AS was FROM samples p JOIN stats t ON t.video_id = p.video_id AND t.frame_idx = p.frame_idx),
sk2 AS (SELECT *, CASE WHEN was IS NOT NULL THEN list_avg([abs(gray[i] - was[i]) for i in range(1, 65)]) / 42 END AS step FROM sj),
sm AS (SELECT video_id, window_idx, s, e, greatest(0.01, e - s) AS duration, count(*) AS n, {', '.join(f'{_C01(f"avg({c})")} AS {c}' for c in ('brightness', 'contrast', 'saturation', 'sharpness', 'colorfulness'))}, coalesce({_C01('avg(step)')}, 0.0) AS motion,
 arg_max(sample_t, struct_pack(v := round(step, 9), k := -sample_idx)) FILTER (step IS NOT NULL) AS peak FROM sk2 GROUP BY video_id, window_idx, s, e),
metrics AS MATERIALIZED (SELECT *, {_C01(f"0.36*sharpness + 0.22*contrast + 0.18*saturation + 0.14*(1 - {_C01('(0.25 - brightness) / 0.25')}) + 0.10*(1 - {_C01('(brightness - 0.86) / 0.14')})")} AS quality,
 least(greatest(coalesce(peak - s, duration * 0.5), 0.0), duration) AS peak_offset FROM sm)"""
_SHOWN = ("brightness", "contrast", "saturation", "sharpness", "colorfulness", "motion", "quality", "peak_offset", "duration")


def _stats(spark, d):
    g = F.transform("vec", lambda v: (v.cast("double") + 0.6) / 1.2 * 255)
    turned = lambda k: F.concat(F.slice("g", k + 1, 64 - k), F.slice("g", 1, k))
    px = V.frames(spark, d).select("video_id", "frame_idx", g.alias("g")).withColumns({"r": turned(21), "b": turned(42)})
    return O.frame_statistics(px, 8, 8)


@query(f"WITH RECURSIVE {V.FRAMES_SQL}, {_CHANGES}{_WINDOWS}{_SAMPLES}{_STATS}{_METRICS} SELECT video_id, window_idx, n, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN)} FROM metrics")
def d13_window_metrics(spark, d):
    """All that is measured of a window, from its sampled frames."""
    m = O.window_metrics(O.sample_plan(_windows(spark, d), 2.0), _stats(spark, d))
    return m.select("video_id", "window_idx", "n", *[F.round(c, 5).alias(c) for c in _SHOWN])


@query(f"""WITH {V.FRAMES_SQL}, l AS (SELECT *, lag(mag) OVER (PARTITION BY video_id, i ORDER BY frame_idx) AS p FROM bins)
SELECT video_id, frame_idx, round(avg(greatest(coalesce(mag - p, 0.0), 0.0)), 6) AS mean_flux, round(quantile_cont(greatest(coalesce(mag - p, 0.0), 0.0), 0.5), 6) AS median_flux FROM l GROUP BY ALL""")
def c7_onset_strength(spark, d):
    """Rise of each bin since the frame before, by frame: mean and median over bins."""
    mag = lambda v: F.transform(v, lambda x: F.abs(x.cast("double")))
    from pyspark.sql import Window

    f = V.frames(spark, d).withColumn("p", F.lag("vec").over(Window.partitionBy("video_id").orderBy("frame_idx")))
    rise = F.zip_with(mag(F.col("vec")), mag(F.col("p")), lambda a, b: F.greatest(F.coalesce(a - b, F.lit(0.0)), F.lit(0.0)))
    rise = F.coalesce(rise, F.transform("vec", lambda x: F.lit(0.0)))
    f = f.select("video_id", "frame_idx", F.sort_array(rise).alias("r"))
    n = F.size("r")
    middle = (F.get("r", F.floor((n - 1) / 2).cast("int")) + F.get("r", F.floor(n / 2).cast("int"))) / 2
    return f.select("video_id", "frame_idx", r6(F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / n, "mean_flux"), r6(middle, "median_flux"))


@query(f"WITH {V.FRAMES_SQL} SELECT video_id, frame_idx, round(CASE WHEN sum(mag) = 0 THEN 0 ELSE sum(mag * freq) / sum(mag) END, 6) AS centroid FROM bins GROUP BY ALL")
def d3_spectral_centroid(spark, d):
    """Folded in the row: the bins of a frame are one array."""
    mag = F.transform("vec", lambda v: F.abs(v.cast("double")))
    weighted = F.transform(mag, lambda v, i: v * 20.0 * F.pow(F.lit(1.1), i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return V.frames(spark, d).select("video_id", "frame_idx", r6(F.coalesce(F.try_divide(total(weighted), total(mag)), F.lit(0.0)), "centroid"))


# The bands in Hz; they overlap.
_BANDS = {"kick": (35, 145), "bass": (35, 220), "clap": (150, 4200), "hihat": (4200, float("inf"))}
_BAND_SUMS = ", ".join(f"sum(CASE WHEN freq >= {lo} AND freq <= {min(hi, 1e12)} THEN mag ELSE 0 END) AS {b}" for b, (lo, hi) in _BANDS.items())


def _bands(spark, d):
    """Each frame's sums over the bins of each band, in the row."""
    def band(lo: float, hi: float):
        inside = [i for i in range(64) if lo <= 20 * 1.1**i <= hi]
        part = F.slice("vec", inside[0] + 1, len(inside)) if inside else F.array().cast("array<double>")
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))

    return V.frames(spark, d).select("video_id", "frame_idx", "t", *[band(*r).alias(b) for b, r in _BANDS.items()])


@query(f"WITH {V.FRAMES_SQL}, b AS (SELECT video_id, frame_idx, {_BAND_SUMS} FROM bins GROUP BY ALL) SELECT video_id, frame_idx, {', '.join(f'round({b}, 6) AS {b}' for b in _BANDS)} FROM b")
def d4_band_energy(spark, d):
    return _bands(spark, d).select("video_id", "frame_idx", *[r6(b, b) for b in _BANDS])


def _smooth3(b: str) -> str:
    w = "PARTITION BY video_id ORDER BY frame_idx"
    full = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""CASE WHEN n < 3 THEN {b} ELSE (sum({b}) OVER ({w} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + CASE WHEN frame_idx = 0 THEN first_value({b}) {full} ELSE 0 END + CASE WHEN frame_idx = n - 1 THEN last_value({b}) {full} ELSE 0 END) / 3 END AS {b}"""


def _norm(b: str) -> str:
    lo, hi = (f"quantile_cont({b}, {q}) OVER (PARTITION BY video_id)" for q in (0.02, 0.98))
    return f"CASE WHEN {hi} - {lo} >= 1e-8 THEN least(greatest(({b} - {lo}) / ({hi} - {lo}), 0.0), 1.0) ELSE 0.0 END AS {b}"


@query(f"""WITH {V.FRAMES_SQL}, b AS (SELECT video_id, frame_idx, frame_idx * 0.5 AS t, {_BAND_SUMS} FROM bins GROUP BY ALL), b1 AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM b),
b2 AS (SELECT video_id, frame_idx, t, {', '.join(_smooth3(b) for b in _BANDS)} FROM b1), b3 AS MATERIALIZED (SELECT video_id, t, {', '.join(_norm(b) for b in _BANDS)} FROM b2),
q AS (SELECT video_id, CAST(k * 0.75 AS DOUBLE) AS qt FROM (SELECT video_id, unnest(range(0, CAST(floor(CAST(duration AS DOUBLE) / 0.75) AS BIGINT))) AS k FROM sources)),
a AS (SELECT q.*, (SELECT max(t) FROM b3 x WHERE x.video_id = q.video_id AND t <= qt) AS ta, (SELECT min(t) FROM b3 x WHERE x.video_id = q.video_id AND t >= qt) AS tb FROM q)
SELECT a.video_id, qt AS t, {', '.join(f'round(CASE WHEN tb IS NULL OR ta = tb THEN x.{b} ELSE x.{b} + (y.{b} - x.{b}) * (qt - ta) / (tb - ta) END, 6) AS {b}' for b in _BANDS)}
FROM a JOIN b3 x ON x.video_id = a.video_id AND x.t = ta LEFT JOIN b3 y ON y.video_id = a.video_id AND y.t = tb""")
def d4_band_curves(spark, d):
    """Bands smoothed, normalised and read off at beats, here every 0.75 s: one pass over knots and beats for all four, dealt by ranges of time."""
    b = _bands(spark, d)
    b = written(b.select("video_id", "frame_idx", "t", *[C.smooth(F.col(c), "video_id", "frame_idx", 3).alias(c) for c in _BANDS]))
    ends = {f"{c}_{n}": (F.col(c), q) for c in _BANDS for n, q in (("lo", 0.02), ("hi", 0.98))}
    b = written(R.with_percentiles(b, "video_id", ends).select("video_id", "t", F.struct("t", *[C.scaled(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) for c in _BANDS]).alias("k")))
    beats = V.sources(spark, d).select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 0.75).cast("int") - 1)).alias("i")).select("video_id", (F.col("i") * F.lit(0.75).cast("double")).alias("t"))
    got = C.around(beats, b, "video_id", "t", F.col("k"), wide=True)
    share = F.coalesce(F.try_divide(F.col("t") - F.col("before.t"), F.col("after.t") - F.col("before.t")), F.lit(0.0))
    line = lambda c: F.coalesce(F.col(f"before.{c}") + (F.col(f"after.{c}") - F.col(f"before.{c}")) * share, F.col(f"before.{c}"))
    return got.select("video_id", "t", *[r6(line(c), c) for c in _BANDS])


@query(f"WITH {V.FRAMES_SQL}{_STATS} SELECT video_id, frame_idx, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN[:5])} FROM stats")
def d12_frame_statistics(spark, d):
    """Brightness, contrast, saturation, sharpness (variance of the mirrored four-neighbour Laplacian) and colourfulness of each frame."""
    return _stats(spark, d).select("video_id", "frame_idx", *[F.round(c, 5).alias(c) for c in _SHOWN[:5]])


def _signed(spark, d, model: str = "no_ai"):
    parts = (F.lit("v1"), F.col("path"), F.col("length").cast("string"), F.col("mtime").cast("string"), F.lit(model))
    return V.sources(spark, d).withColumn("signature", F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24))


@query(f"""WITH {V.FRAMES_SQL}, g AS (SELECT *, substr(sha1(concat_ws('|', 'v1', path, CAST(length AS VARCHAR), CAST(mtime AS VARCHAR), 'no_ai')), 1, 24) AS signature FROM sources)
SELECT video_id, signature, concat(substr(sha1(regexp_replace(path, '[^A-Za-z0-9_.-]+', '_', 'g')), 1, 8), '_', signature, '.json') AS cache_key FROM g""")
def b25_source_signature(spark, d):
    """A source's signature (version, path, size, time, tagger) and the name of its document in a cache."""
    name = F.substring(F.sha1(S.safe_token(F.col("path"))), 1, 8)
    return _signed(spark, d).select("video_id", "signature", F.concat(name, F.lit("_"), "signature", F.lit(".json")).alias("cache_key"))


@query(f"WITH {V.FRAMES_SQL} SELECT video_id FROM sources WHERE video_id % 3 <> 0")
def e7_library_misses(spark, d):
    """Sources whose signature the library lacks: an anti-join, here against the sources of every third video."""
    now = _signed(spark, d)
    library = now.where("video_id % 3 = 0").select("signature")
    return now.join(library, "signature", "left_anti").select("video_id")
