"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 with the least -ln(u)/weight, u a hash of (key, shard) in (0, 1).

    Only the key and the weights decide. A shard that is added takes rows only into itself, a shard that
    goes gives away only its own rows, and a shard's share is its weight over the sum. The key is hashed
    as text, so the integer 7 and the long 7 agree; null keys are one key.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative and not all zero")
    base = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null")))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(base, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(s, w) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def with_slots(df: DataFrame, rows_per_run: int = 4096) -> DataFrame:
    """Add `slot`: 0..n-1 within each `shard`, without gaps, in no promised order.

    A shard is never sorted as a whole. Its rows are dealt by key hash to runs of about `rows_per_run`;
    runs are counted (partial sums before the shuffle), the counts of a shard are summed up run by run,
    and rows are numbered within their run. Expects doc_id and text_crc32.
    """
    n = df.count()
    shards = max(1, df.select("shard").distinct().count())
    runs = max(1, -(-n // (shards * rows_per_run)))
    dealt = df.withColumn("__run", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(runs)))
    counts = dealt.groupBy("shard", "__run").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    in_run = Window.partitionBy("shard", "__run").orderBy("doc_id", "text_crc32")
    return (
        dealt.withColumn("__at", F.row_number().over(in_run) - 1)
        .join(starts, ["shard", "__run"])
        .withColumn("slot", (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__run", "__at", "__start")
    )


def shard_documents(df: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """Deal documents(doc_id, text) to weighted shards by rendezvous hashing of doc_id.

    Returns doc_id, size (UTF-8 bytes + 8; 8 for null text), text_crc32 (unsigned; 0 for null or empty
    text), law = 'key', shard, slot (gapless from 0 in the shard) and grown_shard (the shard if one more
    of the mean weight were added). Rows with equal doc_id, and all rows with a null one, share a shard;
    repeated rows each get a slot. Other columns are not read. An empty table gives an empty table.
    The text is read once to size it and is never shuffled.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = df.select(
        "doc_id",
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, sum(weights) / n_shards]).alias("grown_shard"),
    )
    return with_slots(sized).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
