"""Queries over features, sections, cuts and segments, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import cuts as K
from ..operators import features as O
from ..sources import views as V
from ..sources.shared import written
from .base import query, r6

D = V.DURATION
_ORDER = "PARTITION BY track_id ORDER BY beat_idx"


def _norm(x: str, by: str = "track_id") -> str:
    lo, hi = (f"quantile_cont({x}, {q}) OVER (PARTITION BY {by})" for q in (0.02, 0.98))
    return f"CASE WHEN {hi} - {lo} >= 1e-8 THEN least(greatest(({x} - {lo}) / ({hi} - {lo}), 0.0), 1.0) ELSE 0.0 END"


def _smooth(x: str, half: int) -> str:
    full = f"OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""CASE WHEN n < 3 THEN {x} ELSE (sum({x}) OVER ({_ORDER} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) + greatest(0, {half} - beat_idx) * first_value({x}) {full}
 + greatest(0, {half} - (n - 1 - beat_idx)) * last_value({x}) {full}) / {2 * half + 1} END"""


def _high(x: str, q: float) -> str:
    return f"round({x}, 9) >= round(quantile_cont({x}, {q}) OVER (PARTITION BY track_id), 9)"


FEATURES_SQL = f"""{V.EVENTS_SQL}, f0 AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, lag(rms) OVER ({_ORDER}) AS a, lead(rms) OVER ({_ORDER}) AS b FROM curves),
f1 AS (SELECT *, 0.50*flux + 0.35*onset + 0.15*abs(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b-rms WHEN b IS NULL THEN rms-a ELSE (b-a)/2 END) AS x1, 0.65*centroid + 0.35*hihat AS x2,
 0.34*kick + 0.26*bass + 0.27*clap + 0.08*hihat + 0.05*onset AS x3, pow(greatest(0.0, sin(pi()*least(greatest(t/48.0,0.0),1.0))), 0.65) AS arch FROM f0),
f2 AS (SELECT *, {_norm('x1')} AS nov0, {_norm('x2')} AS bright, {_norm('x3')} AS rhythm FROM f1),
f3 AS (SELECT *, {_smooth('nov0', 1)} AS novelty, 0.55*rms + 0.20*flux + 0.15*bright + 0.10*bass AS x4 FROM f2),
f4 AS (SELECT *, {_norm('x4')} AS energy FROM f3), f5 AS (SELECT *, 0.70*({_smooth('energy', 8)}) + 0.30*energy AS x5 FROM f4),
f6 AS (SELECT *, {_norm('x5')} AS wave FROM f5), f7 AS (SELECT *, 0.58*arch + 0.42*wave AS x6 FROM f6), f8 AS (SELECT *, {_norm('x6')} AS arc FROM f7),
f9 AS (SELECT *, 0.42*rhythm + 0.24*novelty + 0.24*wave + 0.10*arc AS x7 FROM f8),
feat AS MATERIALIZED (SELECT *, {_norm('x7')} AS impact, {_high('kick', .72)} AS strong_kick, {_high('clap', .74)} AS strong_clap, {_high('hihat', .82)} AS strong_hihat, {_high('bass', .74)} AS strong_bass,
 beat_idx % 4 = 0 AS bar, beat_idx % 8 = 0 AS phrase FROM f9)"""
_NOVEL = f""", hi AS (SELECT track_id, t, {_high('novelty', .91)} AND {_high('wave', .45)} AS ok FROM feat),
ho AS MATERIALIZED (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM hi WHERE ok AND t > 0 AND t < 48),
hk(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM ho WHERE rn = 1 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= 10 THEN o.t ELSE k.last END, o.t - k.last >= 10
 FROM hk k JOIN ho o ON o.track_id = k.track_id AND o.rn = k.rn + 1)"""
_WARD = ("wave", "novelty", "rhythm", "impact")
# Neighbours are merged by recursion until three parts are left: lists of a track's parts, with their counts, sums and starts.
_SPLIT = f""", w0 AS MATERIALIZED (SELECT track_id, list(t ORDER BY beat_idx) AS T, [CAST(1 AS BIGINT) for x in list(t)] AS N, range(1, count(*) + 1) AS S, {', '.join(f'list(CAST(round({c} * 1000000) AS BIGINT) ORDER BY beat_idx) AS A{i}' for i, c in enumerate(_WARD))} FROM feat GROUP BY track_id),
ward(track_id, N, S, {', '.join(f'A{i}' for i in range(4))}) AS (SELECT track_id, N, S, {', '.join(f'A{i}' for i in range(4))} FROM w0 UNION ALL SELECT track_id, N[:i - 1] || [N[i] + N[i + 1]] || N[i + 2:], S[:i] || S[i + 2:], {', '.join(f'A{k}[:i - 1] || [A{k}[i] + A{k}[i + 1]] || A{k}[i + 2:]' for k in range(4))}
 FROM (SELECT *, list_position(cost, list_min(cost)) AS i FROM (SELECT *, [N[i] * N[i + 1] / (N[i] + N[i + 1]) * ({' + '.join(f'(A{k}[i] / N[i] - A{k}[i + 1] / N[i + 1]) * (A{k}[i] / N[i] - A{k}[i + 1] / N[i + 1])' for k in range(4))}) for i in range(1, len(N))] AS cost FROM ward WHERE len(N) > 3))),
split AS (SELECT w.track_id, w0.T[x] AS t FROM (SELECT track_id, unnest(S[2:]) AS x FROM ward WHERE len(N) <= 3) w JOIN w0 ON w0.track_id = w.track_id)"""
SECTIONS_SQL = f"""{FEATURES_SQL}{_NOVEL}{_SPLIT}, sp AS (SELECT track_id, round(t, 3) AS t FROM hk WHERE keep UNION SELECT track_id, round(t, 3) FROM split UNION SELECT DISTINCT track_id, 0.0 FROM feat UNION SELECT DISTINCT track_id, 48.0 FROM feat),
so AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM sp),
sk(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM so WHERE rn = 1 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= 10 OR o.t = 48 THEN o.t ELSE k.last END, o.t - k.last >= 10 OR o.t = 48
 FROM sk k JOIN so o ON o.track_id = k.track_id AND o.rn = k.rn + 1),
sb AS (SELECT track_id, t FROM sk WHERE keep UNION SELECT track_id, 32.0 FROM sk WHERE keep GROUP BY track_id HAVING count(*) < 3),
sc AS (SELECT track_id, t AS s, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS e FROM sb),
sd AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s) - 1 AS section_idx FROM sc WHERE e - s >= 1),
me AS (SELECT track_id, quantile_cont(wave, 0.5) AS m FROM feat GROUP BY track_id),
se AS (SELECT d.track_id, section_idx, s, e, avg(f.wave) AS w, avg(f.impact) AS i, avg(f.bright) AS b, count(f.t) AS beats, coalesce(avg(CAST(strong_kick AS INT)), 0) AS kick, coalesce(avg(CAST(strong_clap AS INT)), 0) AS clap,
 coalesce(avg(CAST(strong_bass AS INT)), 0) AS bass, coalesce(avg(CAST(strong_hihat AS INT)), 0) AS hihat FROM sd d LEFT JOIN feat f ON f.track_id = d.track_id AND f.t >= s AND f.t < e GROUP BY ALL),
sf AS (SELECT se.* EXCLUDE (w, i, b), round(coalesce(w, m), 9) AS wave, round(coalesce(i, 0.5), 9) AS impact, round(coalesce(b, 0.5), 9) AS bright, round(m, 9) AS m FROM se JOIN me ON me.track_id = se.track_id),
sections AS MATERIALIZED (SELECT *, CASE WHEN s / 48 < 0.11 THEN CASE WHEN wave <= m * 1.18 THEN 'intro' ELSE 'hook' END WHEN e / 48 > 0.91 THEN CASE WHEN wave <= m * 1.18 THEN 'outro' ELSE 'finale' END
 WHEN wave >= greatest(0.72, m * 1.22) AND impact >= 0.58 THEN 'drop' WHEN wave >= greatest(0.60, m * 1.12) THEN 'chorus' WHEN impact >= 0.64 AND wave < m THEN 'bridge' WHEN wave < m * 0.82 THEN 'breakdown' ELSE 'verse' END AS type,
 CASE WHEN kick > 0.42 AND clap > 0.34 THEN 'kick_clap' WHEN kick >= greatest(clap, bass, hihat) AND kick > 0.34 THEN 'kick' WHEN clap >= greatest(kick, bass, hihat) AND clap > 0.34 THEN 'clap'
 WHEN bass >= greatest(kick, clap, hihat) AND bass > 0.34 THEN 'bass' WHEN hihat > 0.46 THEN 'hihat' ELSE 'mixed' END AS pattern FROM sf)"""
CUTS_SQL = f"""{SECTIONS_SQL}, c0 AS (SELECT f.*, s.section_idx, s.type, s.pattern, s.wave AS section_wave, round(f.wave, 9) AS w, round(f.impact, 9) AS i FROM feat f JOIN sections s ON s.track_id = f.track_id AND f.t >= s.s AND f.t < s.e),
c1 AS (SELECT *, 0.36*impact + 0.27*rhythm + 0.20*wave + 0.10*novelty + 0.07*arc + 0.32*CAST(bar AS INT) + 0.48*CAST(phrase AS INT) + CASE pattern WHEN 'kick_clap' THEN 0.12*CAST(strong_kick AS INT) + 0.10*CAST(strong_clap AS INT)
 WHEN 'kick' THEN 0.16*CAST(strong_kick AS INT) WHEN 'bass' THEN 0.16*CAST(strong_bass AS INT) WHEN 'clap' THEN 0.14*CAST(strong_clap AS INT) WHEN 'hihat' THEN 0.05*CAST(strong_hihat AS INT) ELSE 0 END AS raw FROM c0),
cut AS (SELECT *, {_norm('raw', 'track_id, section_idx')} AS score,
 CASE WHEN type IN ('intro','outro','breakdown') THEN CASE WHEN w > 0.82 AND i > 0.76 THEN 2 WHEN w > 0.55 THEN 3 ELSE 4 END WHEN type IN ('verse','bridge','hook') THEN CASE WHEN w > 0.84 AND i > 0.72 THEN 2 WHEN w > 0.56 THEN 3 ELSE 4 END
 WHEN type = 'chorus' THEN CASE WHEN w > 0.88 AND i > 0.78 THEN 1 WHEN w > 0.58 THEN 2 ELSE 3 END ELSE CASE WHEN w > 0.90 AND i > 0.82 AND pattern IN ('kick_clap','kick','bass') THEN 1 WHEN w > 0.62 THEN 2 ELSE 3 END END AS step,
 CASE WHEN type IN ('intro','outro','breakdown') THEN 0.90 WHEN w >= 0.90 AND type IN ('drop','finale') THEN 0.30 WHEN w >= 0.68 THEN 0.38 WHEN w >= 0.38 THEN 0.58 ELSE 0.90 END AS min_gap,
 CASE WHEN type IN ('intro','outro','breakdown') THEN 3.80 WHEN type IN ('drop','finale') AND section_wave >= 0.78 THEN 1.25 WHEN type IN ('chorus','drop','finale') THEN 1.85 WHEN section_wave >= 0.55 THEN 2.80 ELSE 3.80 END AS max_hold FROM c1)"""


# The walk by recursion: lists of a section's beats, the state is the place and the last cut.
WALK_SQL = f"""{CUTS_SQL}, wb AS MATERIALIZED (SELECT track_id, section_idx, t, score, step, min_gap, max_hold, row_number() OVER (PARTITION BY track_id, section_idx ORDER BY beat_idx) - 1 AS i, score + CASE WHEN phrase THEN 0.22 WHEN bar THEN 0.12 ELSE 0.0 END AS pull FROM cut),
wn AS MATERIALIZED (SELECT a.track_id, a.section_idx, a.i, arg_max(b.i, struct_pack(v := b.pull - 0.06 * abs(b.i - a.i), k := -b.i)) FILTER (abs(b.i - a.i) <= 1) AS n1,
 arg_max(b.i, struct_pack(v := b.pull - 0.06 * abs(b.i - a.i), k := -b.i)) FILTER (abs(b.i - a.i) <= 2) AS n2, min(b.i) FILTER (b.i > a.i AND b.t - a.t >= a.max_hold) AS late
 FROM wb a JOIN wb b ON a.track_id = b.track_id AND a.section_idx = b.section_idx GROUP BY ALL),
ws AS MATERIALIZED (SELECT wb.track_id, wb.section_idx, count(*) AS n, any_value(max_hold) AS hold, list(t ORDER BY wb.i) AS T, list(min_gap ORDER BY wb.i) AS G, list(score ORDER BY wb.i) AS S, list(step ORDER BY wb.i) AS P,
 list(n1 ORDER BY wb.i) AS N1, list(n2 ORDER BY wb.i) AS N2, list(late ORDER BY wb.i) AS L FROM wb JOIN wn ON wn.track_id = wb.track_id AND wn.section_idx = wb.section_idx AND wn.i = wb.i GROUP BY ALL),
walk(track_id, section_idx, pos, lst, cut, extra) AS (SELECT track_id, section_idx, N1[1], N1[1], N1[1], CAST(NULL AS BIGINT) FROM ws UNION ALL
 SELECT track_id, section_idx, CASE act WHEN 1 THEN least(n - 1, aim + 1) WHEN 2 THEN aim ELSE coalesce(ex, best) END, CASE act WHEN 3 THEN coalesce(ex, best) ELSE lst END, CASE act WHEN 3 THEN best END, CASE act WHEN 3 THEN ex END
 FROM (SELECT *, CASE WHEN T[best + 1] - T[lst + 1] < G[best + 1] THEN 1 WHEN S[best + 1] < 0.42 AND T[best + 1] - T[lst + 1] < hold THEN 2 ELSE 3 END AS act,
  CASE WHEN T[L[best + 1] + 1] - T[best + 1] > 1.15 * hold AND T[N2[L[best + 1] + 1] + 1] - T[best + 1] >= G[best + 1] THEN N2[L[best + 1] + 1] END AS ex
  FROM (SELECT *, CASE WHEN P[pos + 1] <= 2 THEN N1[aim + 1] ELSE N2[aim + 1] END AS best
   FROM (SELECT ws.*, walk.pos, walk.lst, least(n - 1, walk.pos + P[walk.pos + 1]) AS aim FROM walk JOIN ws ON ws.track_id = walk.track_id AND ws.section_idx = walk.section_idx WHERE walk.pos < n - 1)))),
walked AS MATERIALIZED (SELECT w.track_id, w.section_idx, T[c + 1] AS t FROM (SELECT track_id, section_idx, cut AS c FROM walk WHERE cut IS NOT NULL UNION ALL SELECT track_id, section_idx, extra FROM walk WHERE extra IS NOT NULL) w
 JOIN ws ON ws.track_id = w.track_id AND ws.section_idx = w.section_idx)"""


def _thinned(name: str, table: str, gap: float) -> str:
    """SQL: `name` is the table (track_id, t) thinned."""
    return f"""{name}_o AS MATERIALIZED (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM {table}),
{name}_k(track_id, rn, t, last, keep) AS (SELECT track_id, rn, t, t, true FROM {name}_o WHERE rn = 1 UNION ALL SELECT o.track_id, o.rn, o.t, CASE WHEN o.t - k.last >= {gap} THEN o.t ELSE k.last END, o.t - k.last >= {gap}
 FROM {name}_k k JOIN {name}_o o ON o.track_id = k.track_id AND o.rn = k.rn + 1), {name} AS MATERIALIZED (SELECT track_id, t FROM {name}_k WHERE keep)"""


EXTRA_SQL = f"""{WALK_SQL}, xb AS (SELECT *, lead(t) OVER ({_ORDER}) - t AS dt FROM feat), xm AS (SELECT track_id, quantile_cont(dt, 0.5) AS median FROM xb GROUP BY track_id),
xc AS (SELECT x.track_id, x.beat_idx, median, x.t + 0.5 * dt AS t FROM (SELECT *, {_high('impact', .965)} AS hit FROM xb) x JOIN xm ON xm.track_id = x.track_id WHERE hit AND round(wave, 9) >= 0.88 AND dt IS NOT NULL AND n >= 3 AND median >= 0.22),
xd AS (SELECT xc.*, (SELECT min(abs(w.t - xc.t)) FROM walked w WHERE w.track_id = xc.track_id) AS far FROM xc WHERE xc.t > 0 AND xc.t < 48),
xr AS (SELECT track_id, round_even(count(*) * 0.025, 0) AS room FROM walked GROUP BY track_id),
extra AS MATERIALIZED (SELECT track_id, t FROM (SELECT xd.track_id, t, room, row_number() OVER (PARTITION BY xd.track_id ORDER BY beat_idx) AS place FROM xd JOIN xr ON xr.track_id = xd.track_id WHERE far >= greatest(0.34, median * 0.45)) WHERE place <= room)"""
FINAL_SQL = f"""{EXTRA_SQL}, both_ AS (SELECT track_id, t FROM walked WHERE t > 0 AND t < 48 UNION ALL SELECT track_id, t FROM extra WHERE t > 0 AND t < 48), {_thinned('inner_', 'both_', 0.3)},
lim AS (SELECT track_id, greatest(1, round_even(count(*) * 0.46, 0)) AS most, greatest(1, round_even(count(*) * 0.22, 0)) AS least FROM feat GROUP BY track_id),
wt AS (SELECT i.track_id, i.t, arg_max(round(f.impact + CASE WHEN f.phrase THEN 0.55 WHEN f.bar THEN 0.32 ELSE 0.0 END, 9), struct_pack(d := -abs(f.t - i.t), e := -f.t)) AS weight FROM inner_ i JOIN feat f ON f.track_id = i.track_id GROUP BY ALL),
cap AS MATERIALIZED (SELECT track_id, t FROM (SELECT wt.*, most, row_number() OVER (PARTITION BY wt.track_id ORDER BY weight DESC, t DESC) AS place FROM wt JOIN lim ON lim.track_id = wt.track_id) WHERE place <= most),
kept0 AS (SELECT cap.track_id, list(t) AS kept, any_value(least) AS least FROM cap JOIN lim ON lim.track_id = cap.track_id GROUP BY cap.track_id),
anch AS MATERIALIZED (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY round(impact, 9) DESC, t DESC) AS rn FROM feat WHERE bar OR phrase),
fill(track_id, rn, least, kept) AS (SELECT track_id, CAST(0 AS BIGINT), least, kept FROM kept0 UNION ALL
 SELECT f.track_id, a.rn, f.least, CASE WHEN list_min([abs(x - a.t) for x in f.kept]) >= 0.58 THEN list_append(f.kept, a.t) ELSE f.kept END FROM fill f JOIN anch a ON a.track_id = f.track_id AND a.rn = f.rn + 1 WHERE len(f.kept) < f.least),
filled AS (SELECT track_id, unnest(kept) AS t FROM (SELECT track_id, arg_max(kept, rn) AS kept FROM fill GROUP BY track_id)), {_thinned('clean', 'filled', 0.3)},
fb AS (SELECT track_id, t FROM feat WHERE bar AND track_id NOT IN (SELECT track_id FROM clean)), {_thinned('back', 'fb', 0.9)},
fin AS MATERIALIZED (SELECT track_id, t FROM clean UNION ALL SELECT track_id, t FROM back)"""
SEGMENTS_SQL = f"""{FINAL_SQL}, fr AS (SELECT DISTINCT track_id, CAST(round_even(t * 30.0, 0) AS BIGINT) AS f FROM fin WHERE t > 0 AND t < 48 UNION SELECT DISTINCT track_id, 0 FROM feat UNION SELECT DISTINCT track_id, 1440 FROM feat),
sg AS (SELECT *, round(start_frame / 30.0, 6) AS a_t, round((start_frame + n_frames / 2) / 30.0, 6) AS m_t FROM (SELECT track_id, f AS start_frame, lead(f) OVER w - f AS n_frames, row_number() OVER w - 1 AS seg_idx FROM fr WINDOW w AS (PARTITION BY track_id ORDER BY f)) WHERE n_frames IS NOT NULL),
kn AS MATERIALIZED (SELECT track_id, t, wave, arc, impact, rhythm, novelty FROM feat),
si AS (SELECT q.track_id, q.seg_idx, q.which, coalesce(x.wave + (y.wave - x.wave) * s, x.wave, y.wave) AS wave, coalesce(x.arc + (y.arc - x.arc) * s, x.arc, y.arc) AS arc, coalesce(x.impact + (y.impact - x.impact) * s, x.impact, y.impact) AS impact,
 coalesce(x.rhythm + (y.rhythm - x.rhythm) * s, x.rhythm, y.rhythm) AS rhythm, coalesce(x.novelty + (y.novelty - x.novelty) * s, x.novelty, y.novelty) AS novelty
 FROM (SELECT z.*, CASE WHEN tb IS NULL OR ta IS NULL OR tb = ta THEN 0.0 ELSE (z.t - ta) / (tb - ta) END AS s FROM (SELECT *, (SELECT max(k.t) FROM kn k WHERE k.track_id = u.track_id AND k.t <= u.t) AS ta, (SELECT min(k.t) FROM kn k WHERE k.track_id = u.track_id AND k.t >= u.t) AS tb
  FROM (SELECT track_id, seg_idx, 1 AS which, a_t AS t FROM sg UNION ALL SELECT track_id, seg_idx, 2, m_t FROM sg) u) z) q
 LEFT JOIN kn x ON x.track_id = q.track_id AND x.t = q.ta LEFT JOIN kn y ON y.track_id = q.track_id AND y.t = q.tb),
sx AS (SELECT sg.*, m.wave, m.arc, a.impact, a.rhythm, a.novelty, coalesce((SELECT max(struct_pack(i := section_idx, y := type)) FROM sections c WHERE c.track_id = sg.track_id AND m_t >= c.s AND m_t < c.e), (SELECT max(struct_pack(i := section_idx, y := type)) FROM sections c WHERE c.track_id = sg.track_id)).y AS type
 FROM sg JOIN si m ON m.track_id = sg.track_id AND m.seg_idx = sg.seg_idx AND m.which = 2 JOIN si a ON a.track_id = sg.track_id AND a.seg_idx = sg.seg_idx AND a.which = 1),
sr AS (SELECT *, round(wave, 9) AS w, round(impact, 9) AS p, round(rhythm, 9) AS r, round(novelty, 9) AS v, round(arc, 9) AS c FROM sx),
segments AS MATERIALIZED (SELECT *, n_frames / 30.0 AS seconds, CASE WHEN type IN ('drop', 'finale') AND (w >= 0.58 OR p >= 0.55) THEN 'drop' WHEN p >= 0.76 OR (w >= 0.78 AND r >= 0.62) THEN 'drop' WHEN type IN ('intro', 'outro', 'breakdown') AND w <= 0.54 THEN 'soft'
 WHEN w <= 0.32 AND p <= 0.48 THEN 'soft' WHEN type IN ('bridge', 'hook') OR v >= 0.68 OR (c >= 0.62 AND w >= 0.48) THEN 'build' WHEN w >= 0.58 AND r >= 0.54 THEN 'rhythm' ELSE 'flow' END AS target FROM sr)"""


def _features(spark, d):
    return O.features(V.curves(spark, d), D)


def _sections(spark, d, feat=None):
    # sections read the features five times: once written, they are computed once
    return O.sections(written(_features(spark, d)) if feat is None else feat, D)


def _cut_beats(spark, d):
    feat = written(_features(spark, d))
    return O.section_beats(feat, O.sections(feat, D))


def _walked(spark, d, feat=None, secs=None):
    feat = written(_features(spark, d)) if feat is None else feat
    secs = O.sections(feat, D) if secs is None else secs
    return O.walk_cuts(O.section_beats(feat, secs))


def _final(spark, d, feat=None, secs=None):
    feat = written(_features(spark, d)) if feat is None else feat
    return K.final_cuts(written(_walked(spark, d, feat, secs)), feat, D)


def segments(spark, d):
    """(track_id, seg_idx, start_frame, n_frames, seconds, target): the profile of each segment of the timeline.

    Wave and arc are taken at its middle, impact, rhythm and novelty at its start, the section at its middle."""
    feat = written(_features(spark, d))
    secs = written(O.sections(feat, D))
    line = C.timeline(written(_final(spark, d, feat, secs)), "track_id", "t", D, V.FPS)
    line = line.withColumns({"at": F.round(F.col("start_frame") / V.FPS, 6), "mid": F.round((F.col("start_frame") + F.col("n_frames") / 2) / V.FPS, 6)})
    # one pass over knots and segments for all five curves: a shuffle, no join
    knots = feat.select("track_id", "t", F.struct("t", "wave", "arc", "impact", "rhythm", "novelty").alias("k"), F.lit(None).cast("int").alias("seg_idx"), F.lit(0).alias("q"))
    none = F.lit(None).cast(knots.schema["k"].dataType)
    ask = line.select("track_id", F.col("at").alias("t"), none.alias("k"), "seg_idx", F.lit(1).alias("q")).unionByName(line.select("track_id", F.col("mid").alias("t"), none.alias("k"), "seg_idx", F.lit(2).alias("q")))
    a, b = (F.last("k", True).over(Window.partitionBy("track_id").orderBy(by("t"), by("q")).rowsBetween(Window.unboundedPreceding, 0)) for by in (F.asc, F.desc))
    got = knots.unionByName(ask).select("track_id", "t", "seg_idx", "q", a.alias("a"), b.alias("b")).where("q > 0")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    line_of = lambda c: F.coalesce(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share, F.col(f"a.{c}"), F.col(f"b.{c}"))
    prof = got.groupBy("track_id", "seg_idx").agg(
        *[F.max(F.when(F.col("q") == q, line_of(c))).alias(c) for q, c in ((2, "wave"), (2, "arc"), (1, "impact"), (1, "rhythm"), (1, "novelty"))]
    )
    s = secs.select("track_id", F.col("start").alias("s"), F.col("end").alias("e"), "section_idx", "type")
    full = line.join(prof, ["track_id", "seg_idx"]).join(s, "track_id")
    inside = (F.col("mid") >= F.col("s")) & (F.col("mid") < F.col("e"))
    kind = F.max_by("type", F.struct(inside, F.col("section_idx")))
    keys = ("track_id", "seg_idx", "start_frame", "n_frames", "wave", "arc", "impact", "rhythm", "novelty")
    full = full.groupBy(*keys).agg(kind.alias("type"))
    target = O.segment_target(F.col("type"), *[F.round(c, 9) for c in ("wave", "impact", "rhythm", "novelty", "arc")])
    return written(full.select(*keys, "type", (F.col("n_frames") / V.FPS).alias("seconds"), target.alias("target")))


@query(f"WITH {FEATURES_SQL} SELECT track_id, beat_idx, {', '.join(f'round({c}, 6) AS {c}' for c in ('novelty', 'bright', 'energy', 'wave', 'arc', 'rhythm', 'impact'))} FROM feat")
def b5_weighted_blends(spark, d):
    return _features(spark, d).select("track_id", "beat_idx", *[r6(c, c) for c in ("novelty", "bright", "energy", "wave", "arc", "rhythm", "impact")])


@query(f"WITH RECURSIVE {FEATURES_SQL}{_NOVEL} SELECT track_id, round(t, 6) AS t FROM hk WHERE keep")
def f3_novelty_boundaries(spark, d):
    return O.novelty_boundaries(_features(spark, d), D, wide=True).select("track_id", r6("t", "t"))


@query(f"WITH RECURSIVE {FEATURES_SQL}{_SPLIT} SELECT track_id, round(t, 6) AS t FROM split")
def f5_change_points(spark, d):
    return O.change_points(_features(spark, d), D).select("track_id", r6("t", "t"))


@query(f"WITH RECURSIVE {SECTIONS_SQL} SELECT track_id, section_idx, s AS \"start\", e AS \"end\", beats, round(wave, 6) AS wave, round(impact, 6) AS impact, round(bright, 6) AS bright, pattern, type FROM sections")
def f4_sections(spark, d):
    return _sections(spark, d).select("track_id", "section_idx", "start", "end", "beats", r6("wave", "wave"), r6("impact", "impact"), r6("bright", "bright"), "pattern", "type")


@query(f"WITH RECURSIVE {SECTIONS_SQL} SELECT track_id, section_idx, round(kick, 6) AS kick, round(clap, 6) AS clap, round(bass, 6) AS bass, round(hihat, 6) AS hihat FROM sections")
def d6_flag_ratios(spark, d):
    return _sections(spark, d).select("track_id", "section_idx", *[r6(c, c) for c in ("kick", "clap", "bass", "hihat")])


@query(f"WITH RECURSIVE {CUTS_SQL} SELECT track_id, section_idx, beat_idx, round(score, 6) AS score, step, CAST(min_gap AS DOUBLE) AS min_gap, CAST(max_hold AS DOUBLE) AS max_hold FROM cut")
def b14_cut_columns(spark, d):
    return _cut_beats(spark, d).select("track_id", "section_idx", "beat_idx", r6("score", "score"), "step", "min_gap", "max_hold")


@query(f"WITH RECURSIVE {WALK_SQL} SELECT track_id, section_idx, round(t, 6) AS t FROM walked")
def f11_cut_walk(spark, d):
    """The scored walk of each section."""
    return _walked(spark, d).select("track_id", "section_idx", r6("t", "t"))


@query(f"WITH RECURSIVE {EXTRA_SQL} SELECT track_id, round(t, 6) AS t FROM extra")
def f12_extra_cuts(spark, d):
    """Extra cuts far from the walked ones. Few tracks of the tables have as many walked cuts as allow one (30 extras on events at 6 times sf0.1)."""
    feat = written(_features(spark, d))
    return K.extra_cuts(written(_walked(spark, d, feat)), feat, D).select("track_id", r6("t", "t"))


@query(f"WITH RECURSIVE {FINAL_SQL} SELECT track_id, round(t, 6) AS t FROM clean")
def f13_cut_cleanup(spark, d):
    """Walked and extra cuts together, thinned, capped by weight, filled up with anchors, thinned again."""
    feat = written(_features(spark, d))
    walked = written(_walked(spark, d, feat)).select("track_id", "t")
    return K.clean_up(walked.unionByName(K.extra_cuts(walked, feat, D)), feat, D).select("track_id", r6("t", "t"))


@query(f"""WITH RECURSIVE {WALK_SQL}, odd AS (SELECT w.track_id, w.t FROM walked w JOIN sections s ON s.track_id = w.track_id AND s.section_idx = w.section_idx WHERE type IN ('drop', 'finale')), fb AS (SELECT track_id, t FROM feat WHERE bar AND track_id NOT IN (SELECT track_id FROM odd)), {_thinned('back', 'fb', 0.9)}
SELECT track_id, round(t, 6) AS t FROM odd UNION ALL SELECT track_id, round(t, 6) FROM back""")
def f14_fallback_cuts(spark, d):
    """The walked cuts of drops and finales only; tracks without one fall back."""
    feat = written(_features(spark, d))
    secs = written(O.sections(feat, D))
    strong = _walked(spark, d, feat, secs).join(secs.where(F.col("type").isin(*O.STRONG)).select("track_id", "section_idx"), ["track_id", "section_idx"], "left_semi")
    return K.with_fallback(written(strong.select("track_id", "t")), feat).select("track_id", r6("t", "t"))


@query(f"WITH RECURSIVE {CUTS_SQL}, p AS (SELECT track_id, section_idx, t, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9) DESC, t DESC) AS place FROM cut) SELECT track_id, section_idx, round(t, 6) AS t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS at FROM p WHERE place <= 12")
def g3_top_beats(spark, d):
    """The twelve best beats of each track, of equal ones the later, back in time order."""
    g = Window.partitionBy("track_id")
    top = _cut_beats(spark, d).select("track_id", "section_idx", "t", F.row_number().over(g.orderBy(F.desc(F.round("score", 9)), F.desc("t"))).alias("place")).where("place <= 12")
    return top.select("track_id", "section_idx", r6("t", "t"), F.row_number().over(g.orderBy("t")).alias("at"))


@query(f"WITH RECURSIVE {EXTRA_SQL} SELECT track_id, round(t, 6) AS t FROM walked UNION ALL SELECT track_id, round(t, 6) FROM extra")
def h3_all_cuts(spark, d):
    """Walked and extra cuts as one bag."""
    feat = written(_features(spark, d))
    walked = written(_walked(spark, d, feat)).select("track_id", "t")
    return walked.unionByName(K.extra_cuts(walked, feat, D)).select("track_id", r6("t", "t"))


@query(f"""WITH RECURSIVE {WALK_SQL}, n AS (SELECT track_id, section_idx, count(*) AS k FROM walked GROUP BY ALL)
SELECT s.track_id, s.section_idx, type, coalesce(k, 0) AS selected, beats, round(coalesce(k, 0) / beats, 6) AS density FROM sections s LEFT JOIN n ON n.track_id = s.track_id AND n.section_idx = s.section_idx WHERE beats > 0""")
def d7_selection_report(spark, d):
    """Cuts chosen, beats and density of each section with beats."""
    feat = written(_features(spark, d))
    return selection(feat, written(O.sections(feat, D)), spark, d).select("track_id", "section_idx", "type", "selected", "beats", r6("density", "density"))


def selection(feat, secs, spark, d):
    cuts = _walked(spark, d, feat, secs).groupBy("track_id", "section_idx").agg(F.count("*").alias("selected"))
    s = secs.where("beats > 0").join(cuts, ["track_id", "section_idx"], "left")
    n = F.coalesce("selected", F.lit(0))
    return s.select("track_id", "section_idx", "type", n.alias("selected"), "beats", (n / F.col("beats")).alias("density"))


_LINE = "printf('      - %s: %d/%d beats (%.1f%%)', upper(type[1]) || type[2:], selected, beats, round_even(density * 100, 1))"


@query(f"""WITH RECURSIVE {WALK_SQL}, n AS (SELECT track_id, section_idx, count(*) AS k FROM walked GROUP BY ALL),
r AS (SELECT s.track_id, s.section_idx, type, coalesce(k, 0) AS selected, CAST(beats AS BIGINT) AS beats, round(coalesce(k, 0) / beats, 9) AS density, row_number() OVER (PARTITION BY s.track_id ORDER BY s.section_idx) AS rn, count(*) OVER (PARTITION BY s.track_id) AS m
 FROM sections s LEFT JOIN n ON n.track_id = s.track_id AND n.section_idx = s.section_idx WHERE beats > 0)
SELECT track_id, 'Sections analyzed and processed:' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY rn) FILTER (rn <= 12) || CASE WHEN any_value(m) > 12 THEN chr(10) || printf('      - ... plus %d more sections', any_value(m) - 12) ELSE '' END AS said FROM r GROUP BY track_id""")
def d16_section_text(spark, d):
    """At most twelve lines on a track's sections, and how many more there are."""
    from ..operators.reports import section_text

    feat = written(_features(spark, d))
    return section_text(selection(feat, written(O.sections(feat, D)), spark, d))


@query(f"""WITH RECURSIVE {SEGMENTS_SQL} SELECT track_id, seg_idx, start_frame, n_frames, type, target, {', '.join(f'round({c}, 6) AS {c}' for c in ('wave', 'arc', 'impact', 'rhythm', 'novelty'))} FROM segments""")
def f16_segment_profiles(spark, d):
    return segments(spark, d).select("track_id", "seg_idx", "start_frame", "n_frames", "type", "target", *[r6(c, c) for c in ("wave", "arc", "impact", "rhythm", "novelty")])


@query(f"""WITH RECURSIVE {SECTIONS_SQL}, q AS (SELECT DISTINCT track_id, unnest(range(0, 48)) + 0.5 AS t FROM feat)
SELECT q.track_id, q.t, coalesce((SELECT min(section_idx) FROM sections s WHERE s.track_id = q.track_id AND q.t >= s.s AND q.t < s.e), (SELECT max(section_idx) FROM sections s WHERE s.track_id = q.track_id)) AS section_idx FROM q""")
def e1_section_at(spark, d):
    """The section of every half second: the one that holds it, else the last one. Sections don't overlap, so it is the last to start, if it has not ended; times and starts are one ordered pass, dealt by ranges."""
    s = written(_sections(spark, d))
    at = s.select("track_id").distinct().select("track_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: i + F.lit(0.5).cast("double"))).alias("t"))
    got = C.around(at, s.select("track_id", F.col("start").alias("t"), "end", "section_idx"), "track_id", "t", F.struct("end", "section_idx"), wide=True)
    last = s.groupBy("track_id").agg(F.max("section_idx").alias("last"))
    return got.join(last, "track_id").select("track_id", "t", F.coalesce(F.when(F.col("t") < F.col("before.end"), F.col("before.section_idx")), F.col("last")).alias("section_idx"))


@query(f"""WITH RECURSIVE {FINAL_SQL}, z AS (SELECT track_id, count(*) AS cuts, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 1.5 END AS gap FROM fin GROUP BY track_id), x AS (SELECT track_id, avg(wave) AS wave, avg(impact) AS impact, avg(rhythm) AS rhythm, avg(CAST(p AS INT)) AS peaks, count(*) AS beats FROM (SELECT *, {_high('wave', .82)} AS p FROM feat) GROUP BY track_id),
y AS (SELECT track_id, count(*) AS sections, count(CASE WHEN type IN ('drop', 'finale', 'chorus') THEN 1 END) AS drops, string_agg(type, ',' ORDER BY section_idx) AS types FROM sections GROUP BY track_id)
SELECT x.track_id, beats, sections, drops, types, cuts, round(gap, 6) AS cut_interval, round(wave, 6) AS wave, round(impact, 6) AS impact, round(rhythm, 6) AS rhythm, round(peaks, 6) AS peak_ratio,
 CASE WHEN round(gap, 9) <= 0.72 OR round(impact, 9) >= 0.58 THEN 'rhythmic_hype_gmv_amv' WHEN round(wave, 9) <= 0.42 AND drops <= 1 THEN 'cinematic_soft_amv' WHEN round(peaks, 9) >= 0.22 OR drops >= 2 THEN 'hybrid_drop_story' ELSE 'rhythmic_flow_gmv_amv' END AS preset
FROM x JOIN y ON y.track_id = x.track_id JOIN z ON z.track_id = x.track_id""")
def d8_track_profile(spark, d):
    """Means, share of peak beats, cuts and the mean time between them, drop-like sections, the order of types and the preset of each track."""
    feat = written(_features(spark, d))
    secs = written(O.sections(feat, D))
    z = _final(spark, d, feat, secs).groupBy("track_id").agg(F.count("*").alias("cuts"), F.when(F.count("*") > 1, (F.max("t") - F.min("t")) / (F.count("*") - 1)).otherwise(1.5).alias("gap"))
    peak = F.round("wave", 9) >= F.round(C.percentile(F.col("wave"), 0.82, Window.partitionBy("track_id")), 9)
    x = feat.withColumn("p", peak.cast("int")).groupBy("track_id").agg(F.avg("wave").alias("w"), F.avg("impact").alias("i"), F.avg("rhythm").alias("r"), F.avg("p").alias("pk"), F.count("*").alias("beats"))
    drop = F.col("type").isin("drop", "finale", "chorus")
    y = secs.groupBy("track_id").agg(
        F.count("*").alias("sections"), F.count_if(drop).alias("drops"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "type"))), lambda s: s["type"]), ",").alias("types"),
    )
    # fixed values: the names of the presets
    preset = O.first_of(((F.round("gap", 9) <= 0.72) | (F.round("i", 9) >= 0.58), "rhythmic_hype_gmv_amv"), ((F.round("w", 9) <= 0.42) & (F.col("drops") <= 1), "cinematic_soft_amv"), ((F.round("pk", 9) >= 0.22) | (F.col("drops") >= 2), "hybrid_drop_story"), default="rhythmic_flow_gmv_amv")
    return x.join(y, "track_id").join(z, "track_id").select("track_id", "beats", "sections", "drops", "types", "cuts", r6("gap", "cut_interval"), r6("w", "wave"), r6("i", "impact"), r6("r", "rhythm"), r6("pk", "peak_ratio"), preset.alias("preset"))
