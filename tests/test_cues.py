import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuegrid.operators import cuts as K
from cuegrid.operators import features as O
from cuegrid.operators import library as L
from cuegrid.operators import planning as P
from cuegrid.operators import scenes as N
from cuegrid.operators import tagging as G
from cuegrid.sources import ingest as I
from cuegrid.sources.catalogue import register
from cuegrid.sources.manifest import Conflict, Library


@pytest.mark.parametrize("times, want", [([], [0.0, 20.0]), ([3.0, 9.9, 12.0], [0.0, 12.0, 20.0]), ([float("nan"), 10.0, 19.0, 25.0], [0.0, 10.0, 20.0])])
def test_merged_boundaries_keep_the_ends(spark, times, want):
    df = spark.createDataFrame([(1, x) for x in times] + [(1, None)], "k long, t double")
    assert sorted(r.t for r in O.merge_boundaries(df, "k", "t", 20.0, 10.0).collect()) == want


def test_windows_of_scenes(spark):
    changes = spark.createDataFrame([(1, 0.54), (1, 6.0), (2, 99.0)], "video_id long, t double")
    sources = spark.createDataFrame([(1, 22.0), (2, 5.2), (3, 0.5), (4, 0.0)], "video_id long, duration double")
    got = sorted(tuple(r) for r in N.scene_windows(changes, sources).select("video_id", "start", "end", "kind").collect())
    # 0.54 s is too short; 5.46 s makes two windows, 16 s four that overlap; video 3 is too short, 4 has no length
    assert [(v, round(s, 3), round(e, 3)) for v, s, e, _ in got] == [(1, 0.54, 5.74), (1, 3.27, 6.0), (1, 6.0, 11.2), (1, 10.0, 15.2), (1, 14.0, 19.2), (1, 18.0, 22.0), (2, 0.0, 5.2)]
    assert {k for v, _, _, k in got if v == 2} == {"scene"}


def test_walk_respects_gaps_and_holds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sec in range(6):
        t = np.cumsum(rng.uniform(0.1, 1.2, 40))
        rows += [(1, sec, i, float(x), float(rng.random()), int(rng.integers(1, 5)), 0.58, 1.85, i % 4 == 0, i % 8 == 0) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "track_id long, section_idx int, beat_idx int, t double, score double, step int, min_gap double, max_hold double, bar boolean, phrase boolean")
    got = O.walk_cuts(df).toPandas()
    for sec, part in got.groupby("section_idx"):
        times = {r[3] for r in rows if r[1] == sec}
        assert set(part.t) <= times and len(part) > 5
        assert np.diff(part.t).min() >= 0.58


def _album(spark, n, videos, seed):
    rng = np.random.default_rng(seed)
    m = pd.DataFrame(rng.random((n, 7)), columns=["motion", "contrast", "saturation", "brightness", "sharpness", "colorfulness", "quality"])
    m["video_id"], m["id"], m["album"], m["duration"] = np.arange(n) % videos, np.arange(n, dtype="int32"), 0, rng.uniform(0.1, 3, n).round(2)
    return G.default_tag(L.score_moments(spark.createDataFrame(m).withColumn("id", F.col("id").cast("int"))))


def _plain_plan(segments, fits):
    """Segments in order, each over all moments."""
    said = []
    for track, seg_idx, target, seconds in segments:
        f = fits[fits.target == (target if target in L.MATCH else "flow")]
        base = f.fit.to_numpy() - np.where(f["at"].to_numpy() < max(0.05, seconds) * 0.55, 0.18, 0.0)
        ids, videos = [x[1] for x in said], [x[0] for x in said]
        lost = 0.28 * f.id.isin(ids[-10:]).to_numpy() + 0.10 * f.video_id.isin(videos[-5:]).to_numpy()
        lost = lost + np.minimum(0.28, 0.10 * f.id.map(Counter(ids)).fillna(0).to_numpy()) + np.minimum(0.18, 0.012 * f.video_id.map(Counter(videos)).fillna(0).to_numpy())
        near = np.flatnonzero(base - lost >= (base - lost).max() - 0.016)
        noise = [int(hashlib.sha1(f"{track}|{seg_idx}|{target}|{f.video_id.iloc[k]}|{f.id.iloc[k]}".encode()).hexdigest()[:12], 16) / 2**48 for k in near]
        k = near[np.argmax((base - lost)[near] + 0.015 * np.array(noise))]
        said.append((int(f.video_id.iloc[k]), int(f.id.iloc[k])))
    return said


@pytest.mark.parametrize("n, videos, length", [(90, 3, 25), (5000, 40, 200), (3000, 1, 60)])
def test_a_plan_from_lists_equals_the_plain_walk(spark, n, videos, length):
    moments = _album(spark, n, videos, n)
    rng = np.random.default_rng(length)
    rows = [(7, i, 0, str(rng.choice(["drop", "soft", "build", "rhythm", "flow", "odd"])), round(float(rng.uniform(0.1, 6)), 2)) for i in range(length)]
    seg = spark.createDataFrame([*rows, (8, 0, 5, "drop", 1.0), (9, 0, 0, "soft", 2.0)], "track_id long, seg_idx int, album long, target string, seconds double")
    got = sorted(tuple(r) for r in L.plan_clips(seg, moments, "album", tracks=1).collect())
    fits = L.matches(moments, "album").toPandas().sort_values(["video_id", "id"])
    assert [(r[2], r[3]) for r in got if r[0] == 7] == _plain_plan([(7, i, t, s) for _, i, _, t, s in rows], fits)
    assert [r[0] for r in got if r[0] != 7] == [9]  # album 5 has no moment
    lists = L.match_lists(seg, moments, "album")
    assert lists.count() < 5 * n * (0.4 if videos == 1 else 1)
    assert len({r[3] for r in got}) > min(10, length // 2)
    assert L.plan_clips(seg.limit(0), moments, "album").count() == 0 and L.plan_clips(seg, moments.limit(0), "album").count() == 0


def test_matches_of_segments_equal_all_pairs(spark):
    moments = _album(spark, 300, 4, 2)
    seg = spark.createDataFrame([(1, i, 0, t, s) for i, (t, s) in enumerate([("drop", 0.2), ("soft", 9.0), ("odd", 3.0), ("flow", 2.0), ("build", 0.01)])] + [(2, 0, 3, "drop", 1.0)], "track_id long, seg_idx int, album long, target string, seconds double")
    got = {r.seg_idx: r for r in L.segment_matches(seg, moments, "album").collect()}
    fits = L.matches(moments, "album").toPandas()
    assert len(got) == 5
    for r in seg.where("track_id = 1").collect():
        f = fits[fits.target == (r.target if r.target in L.MATCH else "flow")]
        base = f.fit - np.where(f["at"] < max(0.05, r.seconds) * 0.55, 0.18, 0.0)
        g = got[r.seg_idx]
        assert (g.scored, g.good, g.target) == (300, int((base.round(6) >= 0.5).sum()), r.target)
        assert g.best == pytest.approx(base.max(), abs=1e-12) and g.mean == pytest.approx(base.mean(), abs=1e-12)
    assert L.segment_matches(seg, moments.limit(0), "album").count() == 0 and L.segment_matches(seg.limit(0), moments, "album").count() == 0


def test_merged_parts_equal_a_plain_search(spark):
    rng = np.random.default_rng(11)
    for _ in range(50):
        x = rng.integers(0, rng.choice([3, 10**6]), (rng.integers(1, 60), 4))
        k = int(rng.integers(1, 8))
        parts = [[i] for i in range(len(x))]
        while len(parts) > k:
            def cost(a, b):
                gap = sum((x[a, c].sum() / len(a) - x[b, c].sum() / len(b)) * (x[a, c].sum() / len(a) - x[b, c].sum() / len(b)) for c in range(4))
                return len(a) * len(b) / (len(a) + len(b)) * gap
            i = int(np.argmin([cost(a, b) for a, b in zip(parts, parts[1:])]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert O.ward_starts(x, k) == [p[0] for p in parts]
    assert O.ward_starts(np.zeros((0, 4), int), 3) == []
    steps = spark.createDataFrame([(t, i, float(i), float(i // 20), 0.0, 0.0, 0.0) for t in (1, 2) for i in range(60)] + [(3, 0, 5.0, 1.0, 1.0, 1.0, 1.0)], "track_id long, beat_idx int, t double, wave double, novelty double, rhythm double, impact double")
    assert sorted(tuple(r) for r in O.change_points(steps, 48.0).collect()) == [(1, 20.0), (1, 40.0), (2, 20.0), (2, 40.0)]


def test_a_tagger_is_asked_again(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k long, prompt string").coalesce(1)
    tag = '{"emotion": "sad", "recommended_use": "flow", "description": "d", ' + ", ".join(f'"{n}": 0.5' for n in G.NUMBERS) + "}"

    def make():
        seen = {}

        def ask(prompts):
            out = []
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                n = int(p[1:])
                # odd ones only when asked again; 8 to 15 never in a crowd
                out.append(tag if (n < 8 and (n % 2 == 0 or seen[p] > 1)) or (8 <= n < 16 and len(prompts) <= 2) else "no" if n != 17 else None)
            return out

        return ask

    got = {r.k: r.reply for r in G.ask_tagger(df, make, 8).collect()}
    assert [k for k, v in got.items() if v is None] == [16, 17, 18, 19]


def test_a_tagger_by_rule(spark):
    rows = [(1, 0.9, 0.1, 0.2, 0.8), (2, 0.1, 0.7, 0.2, 0.8), (3, 0.1, 0.1, 0.9, 0.3), (4, 0.1, 0.1, 0.1, 0.9), (5, 0.9, 0.9, 0.9, 0.29), (6, None, None, None, 0.5)]
    m = spark.createDataFrame(rows, "k long, action double, beauty double, motion double, quality double")
    m = m.withColumn("prompt", G.measured(G.prompt(F.lit("soft")), **{c: F.col(c) for c in ("action", "beauty", "motion", "quality")}))
    got = {r.k: r for r in G.ask_tagger(m, G.rule_tagger, 4).select("k", "seconds", G.parsed(F.col("reply")).alias("tag")).collect()}
    assert [(got[k].tag.emotion, got[k].tag.recommended_use) for k in (1, 2, 3, 4, 6)] == [("hype", "drop"), ("soft", "soft"), ("tension", "build"), ("neutral", "flow"), ("neutral", "flow")]
    assert got[5].tag.reason == "object" and got[1].tag.action_intensity == 0.9 and got[1].tag.combat == 0.4 and all(r.seconds > 0 for r in got.values())
    assert G.rule_tagger()(["nothing measured"]) == ["no tag"]


def test_replies_and_merge_edges(spark):
    whole = '{"emotion": "sad", "recommended_use": "drop", "description": "' + "d" * 300 + '", ' + ", ".join(f'"{n}": 0.5' for n in G.NUMBERS) + "}"
    texts = [whole, whole.replace('"combat": 0.5', '"combat": "nan"'), whole.replace('"chase": 0.5, ', ""), "", None, "no object", "{broken", whole.replace("sad", "odd"), "```\n" + whole + "\n```"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, r string").select("k", G.parsed(F.col("r")).alias("t")).orderBy("k").select("t.reason", "t.combat", F.length("t.description").alias("n")).collect()
    assert [r.reason for r in got] == [None, None, "chase", "object", "object", "object", "object", "emotion", None]
    assert got[1].combat == 0.0 and got[0].n == 160 and got[8].reason is None


def test_peaks_tempo_and_clean_up_on_small_curves(spark):
    x = [0, 1, 0, 0, 5, 0, 0, 4, 0, 0, 0, 6, 0, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, i int, x double")
    assert sorted(tuple(r) for r in P.peaks(df, "k", "i", "x", reach=1, wait=4).collect()) == [(1, 1, 0), (1, 7, 6), (1, 11, 10)]
    beat = spark.createDataFrame([(1, i, 1.0 if i % 4 == 0 else 0.0) for i in range(64)], "k long, i int, x double")
    assert P.tempo(beat, "k", "i", "x", 8.0).first().tempo == 120.0
    feat = spark.createDataFrame([(t, i, i * 0.5, 0.5, 0.5, i % 4 == 0, i % 8 == 0) for t in (1, 2) for i in range(40)], "track_id long, beat_idx int, t double, impact double, wave double, bar boolean, phrase boolean")
    cuts = spark.createDataFrame([(1, i * 0.5 + 0.01) for i in range(40)] + [(2, 3.0)], "track_id long, t double")
    got = K.clean_up(cuts, feat, 20.0).toPandas()
    assert len(got[got.track_id == 1]) == 18 and len(got[got.track_id == 2]) == 9
    assert K.clean_up(cuts.limit(0), feat, 20.0).count() == 0 and K.with_fallback(cuts.limit(0), feat).count() == 20


def _plain_beats(x, period, tightness=100.0):
    dev = np.std(x, ddof=1)
    score, back = [], []
    for i, v in enumerate(x):
        best, lag = 0.0, 0
        for n in range((period + 1) // 2, min(2 * period, i) + 1):
            s = score[i - n] - tightness * np.log(n / period) ** 2
            if s > best:
                best, lag = s, n
        score.append((v / dev if dev > 0 else 0.0) + best)
        back.append(lag)
    at = max(range(max(0, len(x) - period), len(x)), key=lambda i: (score[i], i))
    out = [at]
    while back[at]:
        at -= back[at]
        out.append(at)
    return out[::-1]


def test_beats_of_planted_tempo(spark):
    rng = np.random.default_rng(17)
    curves, planted = {}, {}
    for k in range(20):
        period, x = int(rng.integers(9, 15)), rng.random(400) * 0.3
        at = np.arange(int(rng.integers(0, period)), 400, period)
        at = np.clip(at + rng.integers(-1, 2, len(at)) * (rng.random(len(at)) < 0.3), 0, 399)
        x[at] += 1 + rng.random(len(at)) * 0.2
        curves[k], planted[k] = x, at
    curves[20] = np.array([3.0])
    df = spark.createDataFrame([(k, i, float(v)) for k, x in curves.items() for i, v in enumerate(x)], "k long, i long, x double").repartition(6)
    got = {}
    for r in P.track_beats(df, "k", "i", "x", 22.0).collect():
        got.setdefault(r.k, []).append(r.frame)
    periods = {r.k: max(1, round(60 * 22.0 / r.tempo)) for r in P.tempo(df, "k", "i", "x", 22.0).collect()}
    for k in range(20):
        assert sorted(got[k]) == _plain_beats(curves[k], periods[k])
        near = [min(abs(planted[k] - b)) for b in got[k]]
        assert np.mean(np.array(near) <= 1) > 0.9 and len(got[k]) >= 0.8 * len(planted[k])
    assert got[20] == [0]
    peaked = {r.k for r in P.beats_or_peaks(df, "k", "i", "x", 22.0).where("tempo = 120").collect()}
    assert 20 not in {r.k for r in P.beats_or_peaks(df, "k", "i", "x", 22.0).where("tempo <> 120").collect()} and peaked <= {20} | set(range(20))
    assert P.track_beats(df.limit(0), "k", "i", "x", 22.0).count() == 0


def test_ingest_edges(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.media_files(spark, str(tmp_path))
    for name in ("a.mp4", "b.MKV", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 7)
    assert sorted(r.path[-5:] for r in I.media_files(spark, str(tmp_path)).collect()) == ["a.mp4", "b.MKV"]
    logs = spark.createDataFrame([(1, "pts_time:1.0"), (1, "pts_time:1.05 x"), (1, "pts_time:1.08"), (1, "none"), (1, "pts_time:1.2.3"), (2, None)], "k long, value string")
    assert sorted(tuple(r) for r in I.scene_times(logs, "k").collect()) == [(1, 1.0), (1, 1.08)]
    with pytest.raises(ValueError):
        I.read_series(spark, str(tmp_path / "s"), "track_id long", "csv", spark.range(1).select(F.col("id").alias("track_id"))) if (spark.range(0).write.csv(str(tmp_path / "s")) is None) else None


def test_points_are_spaced_as_one_by_one(spark):
    rng = np.random.default_rng(13)
    rows = [(int(k), float(t), float(w)) for k, t, w in zip(rng.integers(0, 3, 300), rng.integers(0, 200, 300) * 0.1, rng.integers(0, 20, 300))] + [(9, i * 0.25, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t double, w double")
    got = sorted(tuple(r) for r in K.spaced(df, "k", "t", "w", 0.58).collect())
    want = []
    for key in {r[0] for r in rows}:
        kept = []
        for _, t, w in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], -r[1])):
            if all(abs(t - x) >= 0.58 for x in kept):
                kept.append(t)
                want.append((key, t, w))
    assert got == sorted(want) and K.spaced(df.limit(0), "k", "t", "w", 0.58).count() == 0


def test_a_catalogue_is_a_source(spark, tmp_path):
    register(spark)
    for i in range(25):
        (tmp_path / f"v{i:02}.{('mp4', 'MKV', 'txt')[i % 3]}").write_bytes(b"x" * i)
    (tmp_path / "v00.json").write_text('{"width": 3}')
    read = lambda **o: spark.read.format("catalogue").options(path=str(tmp_path), **o).load()
    got = read(filesPerPartition=4).withColumn("p", F.spark_partition_id())
    rows = got.collect()
    assert len(rows) == 17 and {r.length for r in rows} == {i for i in range(25) if i % 3 != 2} and len({r.p for r in rows}) == 5
    assert [r.probe for r in rows if r.probe] == ['{"width": 3}'] and all(r.path.startswith("file:/") for r in rows)
    few = read(filesPerPartition=1).where("length > 20 AND probe IS NULL")
    assert sorted(r.length for r in few.collect()) == [21, 22, 24] and few.rdd.getNumPartitions() == 3  # only what passes is dealt
    assert read().where("length > 99").count() == 0
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no media files"):
        spark.read.format("catalogue").option("path", str(tmp_path / "none")).load().count()


def test_a_lost_commit_changes_nothing(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "video_id long, x string")
    lib, schema = Library(spark, str(tmp_path / "lib")), "video_id long, x string"
    read = lambda v=None: sorted((r.video_id or 0, r.x) for r in lib.read(schema, v).collect())
    assert read() == [] and lib.version() == 0
    assert lib.commit(rows((1, "a"), (1, "b"), (2, "c"), (None, "n"))) == 1
    assert lib.commit(rows((2, "d"), (3, "e"), (None, "m"))) == 2
    now = [(0, "m"), (1, "a"), (1, "b"), (2, "d"), (3, "e")]
    assert read() == now and read(1) == [(0, "n"), (1, "a"), (1, "b"), (2, "c")]
    with monkeypatch.context() as m:  # lost after rows and manifest, before the version is named
        m.setattr(Library, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lib.commit(rows((1, "x"), (2, "y")))
    assert read() == now and lib.version() == 2
    with pytest.raises(Conflict):  # two writers from one version
        lib.commit(rows((1, "z")), base=1)
    assert read() == now
    assert lib.commit(rows((4, "f")), gone=rows((1, ""))) == 3 and read() == [(0, "m"), (2, "d"), (3, "e"), (4, "f")]
    assert lib.vacuum() > 0 and read() == [(0, "m"), (2, "d"), (3, "e"), (4, "f")] and lib.vacuum() == 0
    assert lib.commit(rows((5, "g")).limit(0)) == 4 and len(read()) == 4


def test_extra_cuts_are_rare_and_far(spark):
    """Forty cuts allow one extra: after the first beat of huge impact whose middle is far from every cut."""
    beats = [(1, i, i * 1.0, 1.0 if i in (5, 30, 60) else 0.1, 0.95, i % 4 == 0, i % 8 == 0) for i in range(80)]
    feat = spark.createDataFrame(beats, "track_id long, beat_idx int, t double, impact double, wave double, bar boolean, phrase boolean")
    cuts = spark.createDataFrame([(1, 5.4)] + [(1, 40.0 + i / 4) for i in range(39)], "track_id long, t double")
    assert [r.t for r in K.extra_cuts(cuts, feat, 80.0).collect()] == [30.5]
    assert K.extra_cuts(cuts.limit(10), feat, 80.0).count() == 0 and K.extra_cuts(cuts.limit(0), feat, 80.0).count() == 0
