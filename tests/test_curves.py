import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuegrid.functions import scalars as S
from cuegrid.operators import curves as C


def test_thin_keeps_by_last_kept(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.2), (1, 0.4), (1, 0.6), (1, float("nan")), (2, 5.0)], "k long, t double")
    got = sorted(tuple(r) for r in C.thin(df, "k", "t", 0.4).collect())
    assert got == [(1, 0.0), (1, 0.4), (2, 5.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_smooth_repeats_the_ends(spark, n):
    x = np.arange(n) ** 2.0
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, i int, x double")
    got = [r.y for r in df.select("i", C.smooth(F.col("x"), "k", "i", 3).alias("y")).orderBy("i").collect()]
    want = x if n < 3 else np.convolve(np.pad(x, 1, mode="edge"), np.ones(3) / 3, "valid")
    assert np.allclose(got, want)


def test_normalise_constant_and_nan(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 1.0), (2, float("nan"))], "k long, x double")
    got = df.select("k", "x", C.normalise(F.col("x"), Window.partitionBy("k")).alias("y")).collect()
    assert sorted(r.y for r in got if r.k == 1) == [0.0, 0.0]
    assert sorted(r.y for r in got if r.k == 2) == [0.0, 0.0, 1.0]


def test_timeline_sums_to_the_end(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.5 / 30), (1, 2.6 / 30), (1, 3.5 / 30), (1, 9.0)], "k long, t double")
    got = C.timeline(df, "k", "t", 1.0, 30.0).collect()
    assert sum(r.n_frames for r in got) == 30 and min(r.n_frames for r in got) > 0
    with pytest.raises(ValueError):
        C.timeline(df, "k", "t", 1.0, 0.0)


def test_clamp_defaults(spark):
    df = spark.createDataFrame([("0.5",), ("x",), (None,), ("NaN",), ("7",)], "x string")
    assert [r[0] for r in df.select(S.clamp(F.col("x"), default=0.25)).collect()] == [0.5, 0.25, 0.25, 0.25, 1.0]
