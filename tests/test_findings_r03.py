import numpy as np
import pandas as pd

from cuegrid.operators import curves as C
from cuegrid.operators import features as O


def plan_of(df):
    return df._jdf.queryExecution().toString()


def _features(spark, tracks, n):
    rng = np.random.default_rng(11)
    m = pd.DataFrame(rng.random((tracks * n, 4)), columns=["wave", "novelty", "rhythm", "impact"])
    m["track_id"], m["beat_idx"] = np.arange(tracks * n) // n, np.arange(tracks * n) % n
    m["t"] = m.beat_idx * (48.0 / n) + 0.01
    for c in ("bright", "energy"):
        m[c] = 0.5
    for c in ("kick", "clap", "bass", "hihat"):
        m[f"strong_{c}"] = m.beat_idx % 3 == 0
    return m


def test_sections_find_the_change_points_once(spark):
    feat = spark.createDataFrame(_features(spark, 5, 60))
    secs = O.sections(feat, 48.0)
    assert "InPandas" not in plan_of(secs)  # they are read from a table, not found anew by each who reads them
    assert secs.groupBy("track_id").count().count() == 5


def test_change_points_of_tracks_over_batches(spark):
    m = _features(spark, 7, 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = O.change_points(spark.createDataFrame(m), 48.0).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for track, rows in m.groupby("track_id"):
        x = (rows[["wave", "novelty", "rhythm", "impact"]] * 1000000).round().astype("int64").to_numpy()
        assert sorted(got.t[got.track_id == track]) == rows.t.to_numpy()[O.ward_starts(x, 3)[1:]].tolist()


def test_neighbours_are_found_by_growing_frames(spark):
    times = spark.createDataFrame([(1, 1.0), (1, 4.0), (2, 9.0)], "k long, t double")
    asked = spark.createDataFrame([(1, 0.5), (1, 3.0), (1, 4.0), (2, 1.0), (3, 1.0)], "k long, t double")
    got = C.nearest_distance(asked, times, "k", "t", "far")
    assert "unboundedfollowing" not in plan_of(got)
    assert {(r.k, r.t): r.far for r in got.collect()} == {(1, 0.5): 0.5, (1, 3.0): 1.0, (1, 4.0): 0.0, (2, 1.0): 8.0, (3, 1.0): 1e9}


def test_log_files_are_not_as_many_as_tracks(spark, tmp_path, monkeypatch):
    from cuegrid.plans import ingest

    monkeypatch.setattr(ingest, "_place", lambda _: f"file://{tmp_path}/log")
    assert ingest.a6_scene_log(spark, "/root/testdata/sf0.001").count() > 0
    assert not list((tmp_path / "log").glob("track_id=*"))


def test_extra_cuts_are_those_of_the_walk():
    from cuegrid.plans.registry import oracle_sql

    assert "FROM walked w WHERE w.track_id = xc.track_id" in oracle_sql()["f12_extra_cuts"]


def test_stream_state_is_by_groups_of_keys(spark, tmp_path):
    from cuegrid.streaming import cues as T

    rows = [(k, i, 0.2 * i) for k in (1, 2, 3, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, s long, t double").selectExpr("k", "timestamp_seconds(1000 + s) AS at", "t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = T.drained(T.thin_stream(stream, "k", "at", "t", 0.5, "9 seconds", groups=2)).collect()
    # the watermark is at second 20; of times 0.2 apart every third is kept
    want = [0.2 * i for i in range(0, 21, 3)]
    for k in (1, 2, 3, None):
        assert np.allclose(sorted(r.t for r in got if r.k == k), want)


def test_lists_are_short_whatever_the_number_of_sources(spark):
    from tests.test_cues import _album
    from cuegrid.operators import library as L

    moments = _album(spark, 4000, 800, 5)
    seg = spark.createDataFrame([(0, 1, i, "drop", 1.0) for i in range(6)], "album int, track_id long, seg_idx int, target string, seconds double")
    lists = L.match_lists(seg, moments, "album")
    # six sources offer at least one that was not used: a few hundred at most of 4,000 moments can be chosen, where each source kept its own six before
    assert lists.count() < 800


def test_profiles_and_facts_find_features_and_sections_once(spark, monkeypatch):
    from cuegrid.plans import cues, streams

    calls, known, plain = [], cues._features, O.sections
    for module in (cues, streams):
        monkeypatch.setattr(module, "_features", lambda *a: calls.append("features") or known(*a))
    monkeypatch.setattr(O, "sections", lambda *a: calls.append("sections") or plain(*a))
    streams.d15_top_facts(spark, "/root/testdata/sf0.001")
    cues.d8_track_profile(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["features"] * 2 + ["sections"] * 2
