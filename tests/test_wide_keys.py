"""Operators that deal one key to several tasks: the same answers as with one window or pass by key."""

import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuegrid.functions import scalars as S
from cuegrid.operators import curves as C
from cuegrid.operators import ranks as R
from cuegrid.operators.ranges import Ranges


def hot(rng, n=4000, keys=12, grid=None):
    """Times of some keys, one with over a third of all rows; null and lone keys too."""
    key = rng.choice([0] * 8 + list(range(1, keys)), n)
    t = rng.uniform(0, 50, n) if grid is None else rng.integers(0, 50 / grid, n) * grid
    return [(None if k == 3 else int(k), float(x)) for k, x in zip(key, t)] + [(99, 1.0)]


def plain_thin(times, gap):
    kept = []
    for x in sorted(times):
        if not kept or x - kept[-1] >= gap:
            kept.append(x)
    return kept


@pytest.mark.parametrize("gap, grid", [(0.3, None), (0.011, None), (5.0, None), (0.5, 0.05), (60.0, None)])
def test_thin_wide_equals_thin(spark, gap, grid):
    rows = hot(np.random.default_rng(int(gap * 100)), grid=grid)
    df = spark.createDataFrame(rows, "k long, t double")
    got = {}
    for r in C.thin_wide(df, "k", "t", gap, parts=13).collect():
        got.setdefault(r.k, []).append(r.t)
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    assert {k: sorted(x) for k, x in got.items()} == {k: plain_thin(x, gap) for k, x in by.items()}
    assert sorted(map(str, C.thin(df, "k", "t", gap).collect())) == sorted(map(str, C.thin_wide(df, "k", "t", gap, parts=3).collect()))


def test_thin_wide_edges(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(50)] + [("a", float("nan")), (None, 2.0), ("b", None)], "k string, t double")
    assert sorted(map(str, C.thin_wide(df, "k", "t", 7, 4).collect())) == sorted(map(str, C.thin(df, "k", "t", 7).collect()))
    assert C.thin_wide(df.limit(0), "k", "t", 7).count() == 0
    same = spark.range(500).select(F.lit(1).alias("k"), F.lit(2.0).alias("t"))  # one time
    assert [tuple(r) for r in C.thin_wide(same, "k", "t", 0.1, 8).collect()] == [(1, 2.0)]
    assert C.thin_wide(same, "k", "t", 0.0, 8).count() == 500


def test_ways_answer_whatever_was_kept(spark):
    rng = np.random.default_rng(4)
    for _ in range(60):
        t = np.sort(rng.choice([rng.uniform(0, 3, 40), rng.integers(0, 30, 40) * 0.1]))
        gap = float(rng.choice([0.05, 0.3, 0.7, 4]))
        upto, out = C._ways(t, gap)
        for last in [*(t[0] - rng.uniform(0, 2 * gap, 20)), t[0], t[0] - gap]:
            kept = last
            for x in t:
                if x - kept >= gap:
                    kept = x
            k = np.flatnonzero(upto - last >= gap)
            assert (out[k[0]] if len(k) else last) == kept


def test_a_hot_key_is_in_many_partitions(spark):
    df = spark.createDataFrame(hot(np.random.default_rng(9)), "k long, t double")
    deal = Ranges("k", "t", df, parts=16)
    at = deal.dealt(df).where("k = 0").select("__range", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in at}) >= 5 and len(at) == len({r["__range"] for r in at})
    sizes = [r["count"] for r in deal.dealt(df).groupBy("__range").count().collect()]
    assert max(sizes) <= 2.5 * sum(sizes) / len(sizes)


def test_running_columns_equal_plain_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, None if rng.random() < 0.3 else float(rng.integers(-9, 9))) for k, t in hot(rng, 900, grid=0.5)]
    df = spark.createDataFrame(rows, "k long, t double, v double")
    v = F.col("v")
    names = {"s": ("sum", v), "m": ("max", v), "n": ("min", v)}
    got = Ranges("k", "t", df, parts=9).running(df, names, {f"{n}_": c for n, c in names.items()}).toPandas()
    plain = pd.DataFrame(rows, columns=["k", "t", "v"])
    for r in got.itertuples():
        key = plain.k.isna() if r.k != r.k else plain.k == r.k
        up, down = plain[key & (plain.t <= r.t)].v.dropna(), plain[key & (plain.t >= r.t)].v.dropna()
        for have, want in ((r.s, up.sum() if len(up) else None), (r.m, up.max()), (r.n, up.min()), (r.s_, down.sum() if len(down) else None), (r.m_, down.max()), (r.n_, down.min())):
            assert (have == want) or (have != have and (want is None or want != want))


def test_wide_neighbours_equal_one_window(spark):
    rng = np.random.default_rng(7)
    times = spark.createDataFrame(hot(rng, 300), "k long, t double").withColumn("v", F.col("t") * F.col("t"))
    asked = spark.createDataFrame([*hot(rng, 900), (5, -1.0), (5, 80.0), (77, 3.0)], "k long, t double")
    plan = C.around(asked, times, "k", "t", F.col("v"), wide=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(plan) == rows(C.around(asked, times, "k", "t", F.col("v")))
    assert rows(C.interpolate(times, asked, "k", "t", "v", wide=True)) == rows(C.interpolate(times, asked, "k", "t", "v"))
    assert rows(C.nearest(asked, times, "k", "t", "v", wide=True)) == rows(C.nearest(asked, times, "k", "t", "v"))
    by = {}
    for r in times.collect():
        by.setdefault(r.k, []).append(r.t)
    for r in C.nearest_distance(asked, times, "k", "t", "d", wide=True).collect():
        x = sorted(by.get(r.k, []))
        i = bisect.bisect_left(x, r.t)
        assert r.d == min([abs(y - r.t) for y in x[max(0, i - 1) : i + 1]], default=1e9)
    assert C.around(asked.limit(0), times, "k", "t", F.col("v"), wide=True).count() == 0
    assert C.around(asked, times.limit(0), "k", "t", F.col("v"), wide=True).where("before IS NOT NULL").count() == 0


@pytest.mark.parametrize("shape", ["even", "steep", "few", "flat"])
def test_selected_ranks_equal_sorted_values(spark, shape):
    rng = np.random.default_rng(len(shape))
    draw = {"even": lambda n: rng.normal(size=n), "steep": lambda n: np.exp(rng.normal(size=n) * 60) * rng.choice([-1, 1], n), "few": lambda n: rng.integers(0, 3, n) * 1.5, "flat": lambda n: np.full(n, 7.25)}[shape]
    rows = [(k, float(x), float(-x)) for k, n in ((1, 3000), (None, 500), (2, 1), (3, 2)) for x in draw(n)] + [(1, float("nan"), None), (4, None, float("inf"))]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(5)
    wanted = {"a": (F.col("x"), 0.02), "b": (F.col("x"), 0.98), "c": (F.col("y"), 0.5), "d": (F.col("x"), 1.0), "e": (F.col("y"), 0.0)}
    got = {r.k: r for r in R.selected(df, "k", wanted, cells=16, few=20).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile(F.when(S.finite(x), x), F.lit(p)).alias(n) for n, (x, p) in wanted.items()]).collect()}
    assert 4 not in got or got[4].a is None
    for k in (1, None, 2, 3):
        assert tuple(got[k]) == tuple(want[k])


def test_large_and_small_keys_have_the_same_percentiles(spark):
    df = spark.createDataFrame([(k, t, None) for k, t in hot(np.random.default_rng(3), 2000)], "k long, x double, lo string").drop("lo")
    wanted = {"p": (F.col("x"), 0.9), "q": (F.col("x") * 2, 0.31)}
    rows = lambda big: sorted(map(str, R.with_percentiles(df, "k", wanted, big=big).collect()))
    assert rows(100) == rows(10**6) and len(rows(100)) == df.count()
    assert R.with_percentiles(df.limit(0), "k", wanted).count() == 0


def test_bounds_are_read_from_some_rows(spark, monkeypatch):
    from cuegrid.operators.ranges import DRAWN, Ranges

    df = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("t"))
    seen, kind = [], type(df)
    exchange = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: (seen.append(self.count()), exchange(self, *a))[1])
    deal = Ranges("k", "t", df, parts=8)
    assert len(deal.starts) == 8 and seen[0] < 2 * 8 * DRAWN  # before: all 40,000
    got = deal.running(df, {"n": ("sum", F.lit(1))}).groupBy("k").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d"), F.count("*").alias("c")).collect()
    assert all(r.n == r.d == r.c for r in got) and sum(r.c for r in got) == 40_000
