"""Moment tables: ranking, quota samples, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_sample(df: DataFrame, key: str, order: str, scores: tuple[str, str, str], most: int) -> DataFrame:
    """At most `most` rows a key: the top third by the first score, quarter by the second, fifth by the third,
    then every s-th row in order, s = rows / places left. Keys with fewer rows keep all."""
    if most <= 0:
        return df.limit(0)
    g = Window.partitionBy(key)
    o = g.orderBy(order)
    # the count is a frame of the same order, and each score goes once its place is known: fewer and smaller sorts
    chosen = df.withColumns({"__n": F.count(F.lit(1)).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__rn": F.row_number().over(o), "__p": F.lit(None).cast("int")})
    for i, (s, d) in enumerate(zip(scores, (3, 4, 5), strict=True)):
        rank = F.row_number().over(g.orderBy(F.desc(s), order))
        chosen = chosen.withColumn("__p", F.coalesce("__p", F.when(rank <= max(1, most // d), F.lit(i * most) + rank)))
    chosen = chosen.withColumn("__c", F.count("__p").over(g))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / F.greatest(F.lit(1), F.lit(most) - F.col("__c"))))
    fill = (F.col("__c") < most) & (F.pmod(F.col("__rn") - 1, step) == 0)
    place = F.coalesce("__p", F.when(fill, F.lit(4 * most) + F.col("__rn")))
    kept = chosen.withColumn("__place", F.when(F.col("__n") <= most, F.col("__rn")).otherwise(place)).where(F.col("__place").isNotNull())
    kept = kept.withColumn("__at", F.row_number().over(g.orderBy("__place"))).where(F.col("__at") <= most)
    return kept.select(df.columns)
