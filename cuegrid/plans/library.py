"""Queries over moments: scores, tags, matches, plans; with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import moments as M
from ..operators import planning as P
from ..operators import tagging as G
from ..operators.ranges import Ranges
from ..sources import views as V
from ..sources.shared import written
from .base import query, r6
from .cues import SEGMENTS_SQL, segments

_CL = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_SCORED = f""", s1 AS (SELECT *, 1.0 - least(abs(brightness - 0.52) / 0.52, 1.0) AS light FROM moments),
s2 AS (SELECT *, {_CL('0.58*motion+0.17*contrast+0.12*saturation+0.13*quality')} AS action, {_CL('0.34*quality+0.21*colorfulness+0.18*saturation+0.17*light+0.10*sharpness')} AS beauty,
 {_CL('0.42*motion+0.22*contrast+0.18*(1-light)+0.18*saturation')} AS tension, {_CL('0.6*motion')} AS chase, {_CL('0.35*quality+0.20*sharpness+0.10*light')} AS character_focus FROM s1),
s3 AS (SELECT *, {_CL('0.55*beauty+0.25*light+0.20*(1-motion)')} AS soft FROM s2),
scored AS (SELECT *, {_CL('0.35*greatest(action,beauty,tension)+0.35*quality+0.16*saturation+0.14*contrast')} AS editorial,
 [x for x in [CASE WHEN round(action,9) >= 0.68 THEN 'action' END, CASE WHEN round(beauty,9) >= 0.62 THEN 'beauty' END, CASE WHEN round(tension,9) >= 0.62 THEN 'tension' END,
  CASE WHEN round(soft,9) >= 0.64 THEN 'soft' END, CASE WHEN round(quality,9) >= 0.68 THEN 'clean' END] if x IS NOT NULL] AS tg FROM s3)"""


def _scored(spark, d):
    return L.score_moments(V.moments_big(spark, d))


@query(f"WITH {V.MOMENTS_SQL}{_SCORED} SELECT video_id, id, round(action, 9) AS action, round(beauty, 9) AS beauty, round(tension, 9) AS tension, round(soft, 9) AS soft, round(editorial, 9) AS editorial FROM scored")
def b17_moment_scores(spark, d):
    """Nine places: the inputs are hundredths, so the sixth place would often lie on a tie."""
    return _scored(spark, d).select("video_id", "id", *[F.round(c, 9).alias(c) for c in ("action", "beauty", "tension", "soft", "editorial")])


_FEELS = """CASE WHEN round(action,9) > 0.68 THEN 'hype' WHEN round(soft,9) > 0.64 THEN 'soft' WHEN round(tension,9) > 0.62 THEN 'tension' ELSE 'neutral' END"""
_USED = """CASE WHEN round(action,9) > 0.68 THEN 'drop' WHEN round(soft,9) > 0.64 THEN 'soft' WHEN round(tension,9) > 0.62 THEN 'build' ELSE 'flow' END"""


@query(f"""WITH {V.MOMENTS_SQL}{_SCORED} SELECT video_id, id, {_FEELS} AS emotion, {_USED} AS recommended_use, round(action, 9) AS action_intensity, round(beauty, 9) AS beauty_score, 0.0::DOUBLE AS combat, round(chase, 9) AS chase, 0.0::DOUBLE AS explosion,
 round(character_focus, 9) AS character_focus, round(motion, 9) AS camera_motion, round(quality, 9) AS visual_quality, '' AS description FROM scored""")
def b18_default_semantics(spark, d):
    """All eleven fields of a moment's tag as they follow from its scores."""
    m = G.default_tag(_scored(spark, d))
    return m.select("video_id", "id", *[F.round(f"semantic.{n}", 9).alias(n) for n in G.NUMBERS], *[f"semantic.{n}" for n in ("emotion", "recommended_use", "description")])


@query(f"WITH {V.MOMENTS_SQL}{_SCORED} SELECT video_id, id, CASE WHEN len(tg) = 0 THEN 'flow' ELSE array_to_string(tg, ',') END AS tags FROM scored")
def b19_threshold_tags(spark, d):
    return _scored(spark, d).select("video_id", "id", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {V.MOMENTS_SQL}{_SCORED} SELECT video_id, id, list_has_any(tg, ['action', 'tension']) AS lively, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(tg) = 0 THEN ['flow'] ELSE tg END, ['moment']))), ',') AS all_tags FROM scored""")
def b20_tag_sets(spark, d):
    lively = F.arrays_overlap("tags", F.array(F.lit("action"), F.lit("tension")))
    return _scored(spark, d).select("video_id", "id", lively.alias("lively"), F.array_join(F.sort_array(F.array_union("tags", F.array(F.lit("moment")))), ",").alias("all_tags"))


def _tags(spark, d):
    replies = V.tag_replies(spark, d)
    return replies.select("video_id", "id", G.parsed(F.col("reply")).alias("tag")).where("tag.reason IS NULL")


def _tagged(spark, d, table=None):
    """All moments with their tags, which are joined before scores are made, as rows are narrow then; of `table`, if moment_rows() were written, only videos with tags are shuffled for it."""
    rows = (V.moment_rows(spark, d) if table is None else table).withColumn("video_id", F.col("video_id").cast("long"))
    m = G.with_tags(rows, _tags(spark, d), "video_id", "id", apart=table is not None)
    return G.merged(G.default_tag(L.score_moments(V.with_quality(m))))


def _library(spark, d, table=None):
    """All moments with their tags and their place in their video; an album is the videos of one remainder."""
    start, length = (F.col("id") - 1) * 2.0, 0.2 + F.col("quality") * 2
    return _tagged(spark, d, table).withColumns({"album": F.pmod("video_id", F.lit(50)), "start": start, "duration": length, "center": start + length / 2, "peak_time": start + F.col("motion") * length, "video_duration": start + length + 5})


def _segments(spark, d):
    return segments(spark, d).withColumn("album", F.pmod("track_id", F.lit(50)))


_OLD = ("action", "beauty", "quality", "tension", "soft", "editorial")
_MERGED = f"""{V.MOMENTS_SQL}{_SCORED}, {V.REPLIES_SQL}, m1 AS (SELECT s.*, {_FEELS} AS feels, {_USED} AS used, v.n IS NOT NULL AS tagged, v.* EXCLUDE (video_id, id, n, chase, character_focus), v.chase AS t_chase, v.character_focus AS focus,
 {_CL('motion')} AS mo FROM scored s LEFT JOIN valid v ON v.video_id = s.video_id AND v.id = s.id),
m2 AS (SELECT *, {_CL(f"0.72*{_CL('action')} + 0.28*action_intensity*{_CL('0.35+0.65*mo')}")} AS action_, {_CL('0.65*beauty + 0.35*beauty_score')} AS beauty_, {_CL('0.70*quality + 0.30*visual_quality')} AS quality_ FROM m1),
m3 AS (SELECT *, {_CL(f"0.48*tension + 0.22*{_CL('0.75*mo + 0.25*camera_motion')} + 0.18*action_ + 0.12*focus")} AS tension_, {_CL('0.48*beauty_ + 0.24*focus + 0.18*(1-action_) + 0.10*quality_')} AS soft_ FROM m2),
m4 AS (SELECT *, {_CL('0.30*greatest(action_, beauty_, tension_) + 0.42*quality_ + 0.16*saturation + 0.12*contrast')} AS editorial_, [x for x in [CASE WHEN round(action_,9) >= 0.68 THEN 'action' END, CASE WHEN round(beauty_,9) >= 0.62 THEN 'beauty' END,
  CASE WHEN round(tension_,9) >= 0.62 THEN 'tension' END, CASE WHEN round(soft_,9) >= 0.64 THEN 'soft' END, CASE WHEN round(quality_,9) >= 0.68 THEN 'clean' END] if x IS NOT NULL] AS th,
 [x for x in [CASE WHEN recommended_use <> 'drop' OR round(action_,9) >= 0.45 THEN recommended_use END, CASE WHEN emotion <> 'hype' OR round(action_,9) >= 0.45 THEN emotion END, CASE WHEN combat > 0.50 AND round(action_,9) >= 0.38 THEN 'combat' END,
  CASE WHEN t_chase > 0.50 AND round(action_,9) >= 0.38 THEN 'chase' END, CASE WHEN explosion > 0.55 AND round(action_,9) >= 0.38 THEN 'explosion' END] if x IS NOT NULL] AS more FROM m3),
merged AS MATERIALIZED (SELECT video_id, id, tagged, motion, brightness, saturation, contrast, {', '.join(f'CASE WHEN tagged THEN {c}_ ELSE {c} END AS {c}' for c in _OLD)},
 CASE WHEN tagged THEN list_sort(list_distinct(list_concat(CASE WHEN len(th) = 0 THEN ['flow'] ELSE th END, more))) WHEN len(tg) = 0 THEN ['flow'] ELSE tg END AS tags,
 CASE WHEN tagged THEN combat ELSE 0 END AS combat, CASE WHEN tagged THEN t_chase ELSE chase END AS chase, CASE WHEN tagged THEN explosion ELSE 0 END AS explosion, CASE WHEN tagged THEN focus ELSE character_focus END AS character_focus FROM m4)"""


@query(f"WITH {_MERGED} SELECT video_id, id, tagged, {', '.join(f'round({c}, 9) AS {c}' for c in _OLD)}, array_to_string(tags, ',') AS tags FROM merged")
def e5_tag_merge(spark, d):
    """Scores and tags of all moments, with what a tagger said of some."""
    return _tagged(spark, d).select("video_id", "id", "tagged", *[F.round(c, 9).alias(c) for c in _OLD], F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_MERGED} SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY round(editorial,9) DESC, id) AS place FROM merged")
def c11_rank_moments(spark, d):
    by = Window.partitionBy("video_id").orderBy(F.desc(F.round("editorial", 9)), "id")
    return _tagged(spark, d).select("video_id", "id", F.row_number().over(by).alias("place"))


@query(f"WITH {_MERGED} SELECT video_id, id, round(editorial, 9) AS editorial, row_number() OVER (PARTITION BY video_id ORDER BY round(editorial,9) DESC, id) AS place FROM merged")
def g1_sorted_moments(spark, d):
    """All moments of each source from the best to the least, with their place; a source is dealt to as many tasks as its moments need."""
    m = written(_tagged(spark, d).select("video_id", "id", (-F.round("editorial", 9)).alias("low")))
    got = Ranges("video_id", ("low", "id"), m).running(m, {"place": ("sum", F.lit(1))})
    return got.select("video_id", "id", (-F.col("low")).alias("editorial"), "place")


@query(f"WITH {_MERGED} SELECT 0 AS part, video_id, id, round(editorial, 9) AS editorial FROM merged WHERE tagged UNION ALL SELECT 1, video_id, id, round(editorial, 9) FROM merged WHERE NOT tagged")
def h1_united_moments(spark, d):
    """The lists of tagged and of other moments as one table, with what list a row is from."""
    m = _tagged(spark, d).select("video_id", "id", "tagged", F.round("editorial", 9).alias("editorial"))
    part = lambda yes, no: m.where(F.col("tagged") == yes).select(F.lit(no).alias("part"), "video_id", "id", "editorial")
    return part(True, 0).unionByName(part(False, 1))


@query(f"""WITH {_MERGED}, s AS (SELECT DISTINCT video_id, CASE WHEN video_id % 4 = 0 THEN '' ELSE 'm' || (video_id % 3) END AS model, (video_id % 7) * 0.5 AS peak FROM merged)
SELECT m.video_id % 50 AS album, count(*) AS moments, round(avg(action), 9) AS mean_action, round(avg(beauty), 9) AS mean_beauty, round(avg(quality), 9) AS mean_quality, sum(CAST(tagged AS INT)) AS tagged,
 coalesce(arg_min(nullif(model, ''), m.video_id) FILTER (model <> ''), '') AS model, max(peak) AS peak FROM merged m JOIN s ON s.video_id = m.video_id GROUP BY m.video_id % 50""")
def d10_library_summary(spark, d):
    """By album: how many moments there are, their mean scores, how many were tagged, the first model that is named, the greatest memory used."""
    v = F.col("video_id")
    m = _tagged(spark, d).withColumns({"model": F.when(v % 4 == 0, "").otherwise(F.concat(F.lit("m"), v % 3)), "peak": (v % 7) * 0.5})
    mean = lambda c: F.round(F.avg(c), 9).alias(f"mean_{c}")
    return m.groupBy((v % 50).alias("album")).agg(
        F.count("*").alias("moments"), mean("action"), mean("beauty"), mean("quality"), F.sum(F.col("tagged").cast("int")).alias("tagged"),
        F.coalesce(F.min_by(F.when(F.col("model") != "", F.col("model")), F.when(F.col("model") != "", v)), F.lit("")).alias("model"), F.max("peak").alias("peak"),
    )


_SCORES = ("action", "beauty", "quality")
_QUOTA = f"""{V.MOMENTS_SQL}{_SCORED}, r AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY video_id ORDER BY id) AS rn,
 {', '.join(f'row_number() OVER (PARTITION BY video_id ORDER BY round({c},9) DESC, id) AS r{i}' for i, c in enumerate(_SCORES))} FROM scored WINDOW g AS (PARTITION BY video_id)),
c AS (SELECT *, CASE WHEN r0<=40 THEN r0 WHEN r1<=30 THEN 120+r1 WHEN r2<=24 THEN 240+r2 END AS p FROM r),
e AS (SELECT *, count(p) OVER (PARTITION BY video_id) AS c FROM c),
f AS (SELECT *, CASE WHEN n<=120 THEN rn WHEN p IS NOT NULL THEN p WHEN c<120 AND (rn-1) % greatest(1, n // greatest(1,120-c)) = 0 THEN 480+rn END AS place FROM e),
k AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY place) AS pos FROM f WHERE place IS NOT NULL), quota AS (SELECT video_id, id FROM k WHERE pos <= 120)"""


def _quota(spark, d, *more):
    m = _scored(spark, d).select("video_id", "id", *[F.round(c, 9).alias(c) for c in (*_SCORES, *more)])
    return M.quota_sample(m, "video_id", "id", _SCORES, 120).select("video_id", "id", *(_SCORES if more else ()), *more)


@query(f"WITH {_QUOTA} SELECT video_id, id FROM quota")
def g2_quota_sample(spark, d):
    return _quota(spark, d)


def _asked(spark, d):
    """The selected moments' scores go with them, and are dealt by moment to as many tasks as a shuffle has before prompts are made of them."""
    chosen = _quota(spark, d, "motion").where("video_id IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id", "id")
    said = G.measured(G.prompt(F.lit(None).cast("string")), **{c: F.col(c) for c in ("action", "beauty", "motion", "quality")})
    return G.ask_tagger(chosen.select("video_id", "id", said.alias("prompt")), G.rule_tagger, 8).select("video_id", "id", "seconds", G.parsed(F.col("reply")).alias("tag"))


_ANSWERS = f"""{_QUOTA}, b AS (SELECT q.video_id, q.id, round(action, 9) AS a, round(beauty, 9) AS b, round(motion, 9) AS m, round(quality, 9) >= 0.3 AS ok FROM quota q JOIN scored s ON s.video_id = q.video_id AND s.id = q.id)"""


@query(f"""WITH {_ANSWERS} SELECT video_id, id, ok, CASE WHEN ok THEN CASE WHEN a > 0.6 THEN 'hype' WHEN b > 0.6 THEN 'soft' WHEN m > 0.5 THEN 'tension' ELSE 'neutral' END END AS emotion, CASE WHEN ok THEN CASE WHEN a > 0.6 THEN 'drop' WHEN b > 0.6 THEN 'soft' WHEN m > 0.5 THEN 'build' ELSE 'flow' END END AS recommended_use,
 CASE WHEN ok THEN a END AS action_intensity FROM b""")
def j1_tagger(spark, d):
    """Selected moments through a tagger that tags by rule, in waves with a retry; what stays invalid has no tag."""
    ok = F.col("tag.reason").isNull()
    return _asked(spark, d).select("video_id", "id", ok.alias("ok"), *[F.when(ok, F.col(f"tag.{c}")).alias(c) for c in ("emotion", "recommended_use")], F.when(ok, F.round("tag.action_intensity", 9)).alias("action_intensity"))


@query(f"WITH {_ANSWERS} SELECT video_id, count(*) AS selected, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS tagged, true AS timed FROM b GROUP BY video_id")
def j2_tag_counters(spark, d):
    """By source: moments selected and tagged, and whether the tagger's time was measured (the seconds themselves differ from run to run)."""
    return _asked(spark, d).groupBy("video_id").agg(F.count("*").alias("selected"), F.sum(F.col("tag.reason").isNull().cast("int")).alias("tagged"), (F.sum("seconds") > 0).alias("timed"))


_SEG = f"""{SEGMENTS_SQL}, {_MERGED}, lib AS (SELECT *, video_id % 50 AS album, 0.2 + quality * 2 AS duration FROM merged),
fit AS MATERIALIZED (SELECT album, video_id, id, duration, t.target, least(greatest(CASE t.target WHEN 'drop' THEN 0.46*action+0.16*motion+0.12*combat+0.10*chase+0.08*explosion+0.08*quality WHEN 'soft' THEN 0.45*beauty+0.18*soft+0.13*character_focus+0.14*(1-action)+0.10*quality
 WHEN 'build' THEN 0.40*tension+0.18*motion+0.15*character_focus+0.14*action+0.13*quality WHEN 'rhythm' THEN 0.30*action+0.24*motion+0.18*quality+0.16*tension+0.12*beauty ELSE 0.28*quality+0.24*beauty+0.20*action+0.16*tension+0.12*soft END
 + CASE WHEN list_contains(tags, t.target) THEN 0.08 ELSE 0 END + CASE WHEN t.target = 'drop' AND list_has_any(tags, ['action','combat','chase','explosion','hype']) THEN 0.12 WHEN t.target = 'soft' AND list_has_any(tags, ['soft','beauty','sad']) THEN 0.10
 WHEN t.target = 'build' AND list_has_any(tags, ['tension','transition']) THEN 0.10 ELSE 0 END + 0.12*quality - CASE WHEN round(brightness, 9) < 0.13 THEN 0.18 ELSE 0 END - CASE WHEN round(quality, 9) < 0.24 THEN 0.16 ELSE 0 END, -1.0), 2.0) AS fit
 FROM lib, (SELECT unnest(['drop', 'soft', 'build', 'rhythm', 'flow']) AS target) t),
pairs AS MATERIALIZED (SELECT g.track_id, g.seg_idx, g.target, f.video_id, f.id, fit - CASE WHEN greatest(0.05, duration) < greatest(0.05, seconds) * 0.55 THEN 0.18 ELSE 0 END AS base FROM segments g JOIN fit f ON f.album = g.track_id % 50 AND f.target = g.target)"""


@query(f"""WITH RECURSIVE {_SEG} SELECT track_id, seg_idx, target, count(*) AS scored, round(max(base), 6) AS best, round(avg(base), 6) AS mean, count(CASE WHEN round(base, 6) >= round(0.5, 6) THEN 1 END) AS good FROM pairs GROUP BY ALL""")
def e6_candidate_matches(spark, d):
    """Every segment against every moment of its album: how many, the best and the mean score, and how many are good."""
    got = L.segment_matches(_segments(spark, d), _library(spark, d), "album")
    return got.select("track_id", "seg_idx", "target", "scored", r6("best", "best"), r6("mean", "mean"), "good")


# The walk by recursion over all pairs: the state is the lists of moments and of sources that were chosen. A moment's number is unique within its album.
_NOISE = "CAST('0x' || substr(sha1(concat_ws('|', p.track_id, p.seg_idx, p.target, p.video_id, p.id)), 1, 12) AS BIGINT) / 281474976710656.0"
_PLAN = f"""{_SEG}, plan(track_id, seg_idx, ms, vs, best) AS (SELECT DISTINCT track_id, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(video_id BIGINT, id BIGINT, score DOUBLE)) FROM segments
UNION ALL SELECT track_id, seg_idx, list_append(ms, best.video_id * 1000000 + best.id), list_append(vs, best.video_id), best FROM (SELECT track_id, seg_idx, any_value(ms) AS ms, any_value(vs) AS vs,
  arg_max(struct_pack(video_id := CAST(video_id AS BIGINT), id := CAST(id AS BIGINT), score := score), struct_pack(s := score, v := -video_id, i := -id)) AS best
 FROM (SELECT p.track_id, p.seg_idx, l.ms, l.vs, p.video_id, p.id, base + 0.015 * ({_NOISE}) - 0.28 * CAST(list_contains(l.ms[-10:], p.video_id * 1000000 + p.id) AS INT) - 0.10 * CAST(list_contains(l.vs[-5:], p.video_id) AS INT)
   - least(0.28, 0.10 * len([x for x in l.ms if x = p.video_id * 1000000 + p.id])) - least(0.18, 0.012 * len([x for x in l.vs if x = p.video_id])) AS score
  FROM plan l JOIN pairs p ON p.track_id = l.track_id AND p.seg_idx = l.seg_idx + 1) GROUP BY track_id, seg_idx)),
planned AS MATERIALIZED (SELECT p.track_id, p.seg_idx, g.target, best.video_id AS video_id, best.id AS id, best.score AS score, g.seconds FROM plan p JOIN segments g ON g.track_id = p.track_id AND g.seg_idx = p.seg_idx)"""


def _plan(spark, d, *keep):
    """The whole plan with `keep` of each clip's moment. What is written of the moments is what all else follows from; scores are made of it where they are read."""
    lib = _library(spark, d, written(V.moment_rows(spark, d)))
    seg = written(_segments(spark, d))
    plan = L.plan_clips(seg, lib, "album", keep=keep).join(seg.select("track_id", "seg_idx", "target", "seconds"), ["track_id", "seg_idx"])
    return P.complete_plans(written(plan), seg)


@query(f"""WITH RECURSIVE {_PLAN}, c AS (SELECT p.*, (p.id - 1) * 2.0 AS s0, 0.2 + m.quality * 2 AS length, m.motion, greatest(0.05, seconds) AS dur FROM planned p JOIN merged m ON m.video_id = p.video_id AND m.id = p.id)
SELECT track_id, seg_idx, target, video_id, id, round(score, 6) AS score, round(greatest(0.0, least(CASE WHEN target IN ('drop', 'build') THEN s0 + motion * length ELSE s0 + length / 2 END - dur * CASE target WHEN 'drop' THEN 0.36 WHEN 'soft' THEN 0.50 WHEN 'build' THEN 0.48 ELSE 0.44 END,
 greatest(dur, s0 + length + 5) - dur)), 6) AS clip_start FROM c""")
def f17_diversity_plan(spark, d):
    """The plan of every track, with where each clip starts. The SQL walks over all pairs; the plan reads lists."""
    return _plan(spark, d, "start", "center", "peak_time", "video_duration").select("track_id", "seg_idx", "target", "video_id", "id", r6("score", "score"), r6(L.place_clip(F.col("target"), F.col("seconds")), "clip_start"))


@query(f"""WITH RECURSIVE {_PLAN}, t AS (SELECT p.*, m.tagged FROM planned p JOIN merged m ON m.video_id = p.video_id AND m.id = p.id), k AS (SELECT track_id, target, count(*) AS n FROM t GROUP BY ALL)
SELECT track_id, count(*) AS clips, (SELECT string_agg(target || '=' || n, ',' ORDER BY target) FROM k WHERE k.track_id = t.track_id) AS targets, CAST(sum(CAST(tagged AS INT)) AS BIGINT) AS tagged, count(DISTINCT video_id) AS sources FROM t GROUP BY track_id""")
def d9_plan_summary(spark, d):
    """By track: clips, those of each target, tagged ones, sources."""
    p = _plan(spark, d, "tagged")
    each = p.groupBy("track_id", "target").agg(F.count("*").alias("n"), F.sum(F.col("tagged").cast("int")).alias("tagged"), F.collect_set("video_id").alias("v"))
    return each.groupBy("track_id").agg(
        F.sum("n").alias("clips"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "n"))), lambda x: F.concat_ws("=", x["target"], x["n"])), ",").alias("targets"), F.sum("tagged").alias("tagged"),
        F.size(F.array_distinct(F.flatten(F.collect_list("v")))).alias("sources"),
    )


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, p AS (SELECT track_id, seg_idx FROM segments WHERE NOT (track_id % 5 = 0 AND seg_idx = 2)), n AS (SELECT track_id, count(*) AS k FROM p GROUP BY track_id), m AS (SELECT track_id, count(*) AS k FROM segments GROUP BY track_id)
SELECT p.track_id, p.seg_idx FROM p JOIN n ON n.track_id = p.track_id JOIN m ON m.track_id = p.track_id AND m.k = n.k""")
def d17_completeness_gate(spark, d):
    """A plan without one row for each segment is rejected whole: here those of every fifth track lack one."""
    seg = segments(spark, d)
    plan = seg.where("NOT (track_id % 5 = 0 AND seg_idx = 2)").select("track_id", "seg_idx")
    return P.complete_plans(plan, seg).select("track_id", "seg_idx")


@query(f"WITH {V.REPLIES_SQL} SELECT video_id, id, {', '.join(G.NUMBERS)}, emotion, recommended_use, description FROM valid")
def b28_tag_validation(spark, d):
    """Replies of a tagger: the object in the text is parsed, eight numbers are bounded, and a row with anything missing or unknown is rejected whole."""
    return _tags(spark, d).select("video_id", "id", "tag.*").drop("reason")


@query(f"WITH {V.REPLIES_SQL} SELECT video_id, id, CASE n % 7 WHEN 3 THEN 'visual_quality' WHEN 4 THEN 'emotion' WHEN 6 THEN 'description' END AS reason FROM replies WHERE n % 7 IN (3, 4, 6)")
def b27_rejected_replies(spark, d):
    """What is wrong with the replies that are rejected."""
    return V.tag_replies(spark, d).select("video_id", "id", G.parsed(F.col("reply"))["reason"].alias("reason")).where("reason IS NOT NULL")


@query("""SELECT c_custkey, concat('Tag one moment of a source video for an edit in the style ', CASE WHEN c_custkey % 3 = 0 THEN 'rhythmic_gmv_amv' ELSE lower(c_mktsegment) END,
 '. Answer with one JSON object: action_intensity, beauty_score, combat, chase, explosion, character_focus, camera_motion, visual_quality as numbers from 0 to 1, emotion one of soft, tension, hype, sad, neutral, recommended_use one of drop, soft, build, transition, flow, filler, description in fewer than 12 words.') AS prompt FROM customer""")
def b29_prompts(spark, d):
    """A prompt for each customer's style; every third has none."""
    style = F.when(F.col("c_custkey") % 3 != 0, F.lower("c_mktsegment"))
    return V.table(spark, d, "customer").select("c_custkey", G.prompt(style).alias("prompt"))
