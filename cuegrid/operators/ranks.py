"""Exact percentiles of keys of any size, by histograms that narrow each wanted rank to a few values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.shared import Scratch, written
from .curves import percentile

#: Cells of a histogram, and values that are few enough to be sorted as one array.
CELLS, FEW = 1024, 4096


def _same(key: str):
    return F.col(key).eqNullSafe(F.col("__k"))


def selected(df: DataFrame, key: str, wanted: dict[str, tuple[Column, float]], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """(key, a column for each of `wanted`): linear-interpolated percentiles of finite values, null for a key without any.

    Each round counts the values of the cells that hold a wanted rank in `cells` parts between the least and the greatest of them: counts, least and greatest merge, so rows are aggregated where
    they are, and a key's values never meet in one task. A cell of `few` values, or of one value, is decided by its values. What is broadcast is a row a key and wanted rank: call it for keys that are few,
    as with_percentiles() does. df is read once a round, two or three times for values that are spread evenly: give a table."""
    names = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), wanted[n][0].cast("double").alias("x")) for i, n in enumerate(names)]))
    values = df.select(F.col(key).alias("__k"), each.alias("v")).select("__k", "v.no", "v.x").where(finite(F.col("x")))
    with Scratch(df.sparkSession) as scratch:
        stats = scratch(values.groupBy("__k", "no").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        share = F.element_at(F.array(*[F.lit(float(wanted[n][1])) for n in names]), F.col("no") + 1)
        place = share * (F.col("n") - 1)
        ranks = stats.select("__k", "no", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
        decided = None
        while True:
            ranks = scratch(ranks)
            done = ranks.where((F.col("n") <= few) | (F.col("lo") == F.col("hi")))
            decided = done if decided is None else decided.unionByName(done)
            ranks = ranks.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))
            if ranks.isEmpty():
                break
            open_ = ranks.select("__k", "no", "lo", "hi", "below").distinct()
            width = F.col("hi") / 2 - F.col("lo") / 2  # halves: the difference may be over the greatest number
            cell = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / width * cells), F.lit(cells - 1)).alias("cell")
            parts = _inside(values, open_).groupBy("__k", "no", "lo", "hi", "below", cell).agg(F.count("*").alias("m"), F.min("x").alias("a"), F.max("x").alias("b"))
            o = Window.partitionBy("__k", "no", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
            parts = parts.withColumn("from", F.col("below") + F.coalesce(F.sum("m").over(o), F.lit(0)))
            met = ranks.select(*[F.col(c).alias(f"r_{c}") for c in ("__k", "no", "lo", "hi", "rank")])
            here = F.col("__k").eqNullSafe(F.col("r___k")) & (F.col("no") == F.col("r_no")) & (F.col("lo") == F.col("r_lo")) & (F.col("hi") == F.col("r_hi"))
            hit = parts.join(F.broadcast(met), here & (F.col("r_rank") >= F.col("from")) & (F.col("r_rank") < F.col("from") + F.col("m")))
            ranks = hit.select("__k", "no", F.col("r_rank").alias("rank"), F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("from").alias("below"), F.col("m").alias("n"))
        one = decided.where(F.col("lo") == F.col("hi")).select("__k", "no", "rank", F.col("lo").alias("x"))
        several = decided.where(F.col("lo") < F.col("hi"))
        sets = _inside(values, several.select("__k", "no", "lo", "hi", "below").distinct()).groupBy("__k", "no", "lo", "hi", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        several = several.select(F.col("__k").alias("d_k"), F.col("no").alias("d_no"), F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"), "rank")
        found = sets.join(several, F.col("__k").eqNullSafe(F.col("d_k")) & (F.col("no") == F.col("d_no")) & (F.col("lo") == F.col("d_lo")) & (F.col("hi") == F.col("d_hi")))
        found = one.unionByName(found.select("__k", "no", "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
        at = stats.select(F.col("__k").alias("s_k"), F.col("no").alias("s_no"), place.alias("place"))
        met = found.join(at, F.col("__k").eqNullSafe(F.col("s_k")) & (F.col("no") == F.col("s_no"))).groupBy("__k", "no", "place").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
        p = F.col("place")
        value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(p) - p) * F.col("a") + (p - F.floor(p)) * F.col("b"))
        return written(met.select("__k", "no", value.alias("v")).groupBy(F.col("__k").alias(key)).agg(*[F.max(F.when(F.col("no") == i, F.col("v"))).alias(n) for i, n in enumerate(names)]))


def _inside(values: DataFrame, cells: DataFrame) -> DataFrame:
    """The values of each cell, with the cell. Cells are a row a key and wanted rank at most."""
    c = cells.withColumnsRenamed({"__k": "c_k", "no": "c_no"})
    return values.join(F.broadcast(c), F.col("__k").eqNullSafe(F.col("c_k")) & (F.col("no") == F.col("c_no")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("c_k", "c_no")


def with_percentiles(df: DataFrame, key: str, wanted: dict[str, tuple[Column, float]], default: float = 0.0, big: int = 1_000_000) -> DataFrame:
    """df with a column for each of `wanted`, a linear-interpolated percentile of its key's finite values, the default for a key without any.

    Keys of up to `big` rows are windows, as with curves.percentile(); larger ones, of which there are rows / big at most, are decided by selected(), which gives the same numbers, and stay where they are."""
    by = Window.partitionBy(key)
    large = written(df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > big).select(F.col(key).alias("__k")))
    window = lambda part: part.withColumns({n: percentile(x, p, by, default) for n, (x, p) in wanted.items()})
    if large.isEmpty():
        return window(df)
    small = df.join(F.broadcast(large), _same(key), "left_anti")
    rows = df.join(F.broadcast(large), _same(key), "left_semi")
    found = selected(rows, key, wanted).withColumnRenamed(key, "__k")
    named = reduce(lambda d, n: d.withColumn(n, F.coalesce(F.col(n), F.lit(default))), wanted, rows.join(F.broadcast(found), _same(key), "left"))
    return window(small).unionByName(named.select(*df.columns, *wanted))
