"""Streaming forms: thinning by the last kept time, energy by hopping window, an incremental library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.manifest import Library
from ..sources.shared import shared_dir

_STORE = "spark.sql.streaming.stateStore.providerClass"


def event_stream(spark: SparkSession, sf_dir: str, files: int = 0) -> DataFrame:
    """The events table as a file stream, with `at` as a timestamp.

    With `files` the events are first dealt to so many files by time (in the shared folder), each up to two days later than it happened, and a
    batch reads one of them: neighbouring batches overlap in time, as late data does."""
    if files:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        to = f"{shared_dir(spark)}/cuegrid/{uuid.uuid4().hex}"
        when = F.unix_seconds(F.col("ts").cast("timestamp"))
        first, last = events.agg(F.min(when), F.max(when)).first()
        no = F.least(F.floor((when + F.pmod(F.xxhash64("event_id"), F.lit(172_800)) - first) / max(1, -(-(last - first) // files))), F.lit(files - 1))
        for i in range(files):
            events.where(no == i).repartition(1).write.mode("append").parquet(to)  # all tasks read, one writes its eighth
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(to)
    else:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is available now goes through the stream into a table in the shared folder; its rows. What still waits for the watermark is not among them.

    States are kept by RocksDB, for this stream only: states with timers need it."""
    spark = stream.sparkSession
    to = f"{shared_dir(spark)}/cuegrid/{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{to}-log").outputMode(mode).trigger(availableNow=True).start(f"{to}-rows").awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{to}-rows")


def _thinning(t: str, gap: float):
    """A batch's step of a group of keys: what waits and what comes, with the moment that decides it; the moments that the watermark has passed are decided in order, the rest waits."""
    import numpy as np
    import pandas as pd

    def step(_, batches, state):
        keys, lasts, who, due, times = state.get if state.exists else ([], [], [], [], [])
        last, known = dict(zip(keys, lasts)), [pd.DataFrame({"key": pd.Series(who, dtype=object), "due": np.array(due, dtype=np.int64), "t": np.array(times, dtype=float)})]
        if not state.hasTimedOut:
            known += [pdf[["key", "due", t]].set_axis(["key", "due", "t"], axis=1) for pdf in batches]
        rows = pd.concat(known, ignore_index=True)
        rows["key"] = rows["key"].astype(object).where(rows["key"].notna(), None)
        open_ = rows["due"] > state.getCurrentWatermarkMs()
        closed, wait, kept = rows[~open_].sort_values(["due", "t"]), rows[open_], []
        for k, x in zip(closed["key"].tolist(), closed["t"].tolist()):
            if k not in last or x - last[k] >= gap:
                kept.append((k, x))
                last[k] = x
        state.update((list(last), list(last.values()), wait["key"].tolist(), wait["due"].tolist(), wait["t"].tolist()))
        if len(wait):
            state.setTimeoutTimestamp(max(1, int(wait["due"].min()) - 1))  # it fires once the watermark is later than this, so once it has reached the moment
        yield pd.DataFrame({"key": pd.Series([k for k, _ in kept], dtype=object), "t": np.array([x for _, x in kept], dtype=float)})

    return step


def thin_stream(stream: DataFrame, key: str, at: str, t: str, gap: float, late: str, groups: int = 256) -> DataFrame:
    """(key, t): times at least `gap` after the key's last kept one, whatever the order in which they come.

    A time that comes within `late` of the newest event may yet be preceded by another; it is decided once the watermark has passed it, in order, by a timer. Rows later than the
    watermark are dropped by it; null and not finite times are dropped. Keys are dealt to `groups`; a group's state is its keys' last kept times and the times that wait, in one row, with one timer, which a
    batch exchanges with the task once: a call for each key, or each moment and its timer, took longer than all else. A task holds a group's state; more keys want more groups."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, late).where(finite(F.col(t)))
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("group"), F.col(key).cast("string").alias("key"), t, at, F.unix_millis(at).alias("due"))
    kept = "keys array<string>, lasts array<double>, who array<string>, due array<bigint>, times array<double>"
    got = rows.groupBy("group").applyInPandasWithState(_thinning(t, gap), "key string, t double", kept, "append", "EventTimeTimeout")
    return got.select(F.col("key").cast(kind).alias(key), F.col("t").alias(t))


def energy_stream(stream: DataFrame, at: str, band: str, value: str, length: str, hop: str, late: str) -> DataFrame:
    """(start, band, energy, n): sums by hopping window and band, each emitted once the watermark has passed its end."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, length, hop).alias("w"), band)
    return w.agg(F.sum(value).alias("energy"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), band, "energy", "n")


def keep_library(spark: SparkSession, arrivals: list[DataFrame]) -> DataFrame:
    """(video_id, batch, duration): a library that a stream of source lists (video_id, signature, duration) keeps up to date.

    Each batch is met with the library by signature: what is known is left out, what is new or changed is worked on and replaces its video's rows, as one commit.
    A batch that is run again after a failure finds its own signatures and does nothing."""
    to = f"{shared_dir(spark)}/cuegrid/{uuid.uuid4().hex}"
    schema, library = "signature string, batch long, duration double, video_id long", Library(spark, f"{to}-library")

    def upsert(batch: DataFrame, no: int) -> None:
        new = batch.join(library.read(schema).select("signature"), "signature", "left_anti")
        new = new.select("signature", F.lit(no + 1).cast("long").alias("batch"), F.col("duration").cast("double").alias("duration"), F.col("video_id").cast("long").alias("video_id"))
        library.commit(new)

    for rows in arrivals:
        rows.coalesce(1).write.mode("append").parquet(f"{to}-lists")
        stream = spark.readStream.schema(rows.schema).parquet(f"{to}-lists")
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{to}-log").trigger(availableNow=True).start().awaitTermination()
    return library.read(schema).select("video_id", "batch", "duration")
