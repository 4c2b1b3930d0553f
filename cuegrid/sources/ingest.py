"""Reading what other tools leave behind: media folders, curves, logs, key frame documents, probe rows, libraries; and writing edit lists."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import curves as C
from .catalogue import _place
from .manifest import Library
from .shared import written

# Suffixes of media files, gaps in seconds of scene times and key frames, what a probe that failed counts as.
SUFFIXES, SCENE_GAP, FRAME_GAP = ("mp4", "MP4", "mkv", "MKV"), 0.08, 0.20
DURATION, FPS, WIDTH, HEIGHT = 10.0, 30.0, 1920, 1080
# Folders that edit lists are dealt to.
FOLDERS = 512


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, mtime) of a folder's media files. Contents are not read. Raises where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    files = files.select("path", "length", F.unix_seconds("modificationTime").alias("mtime"))
    if files.isEmpty():
        raise FileNotFoundError(f"no media files in {folder}")
    return files


def read_series(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", keys: DataFrame | None = None, key: str = "track_id") -> DataFrame:
    """A table of time series with the schema it must have. Raises if a key of `keys` has no row."""
    got = spark.read.format(kind).schema(schema).option("header", True).load(path)
    if keys is not None:
        lost = keys.select(key).distinct().join(got.select(key), key, "left_anti")
        if first := lost.take(5):
            raise ValueError(f"no rows for {key} {', '.join(str(r[0]) for r in first)}")
    return got


def scene_times(lines: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, t): the times after `pts_time:` in a tool's log lines, to the millisecond, each once, at least 0.08 s apart."""
    t = F.bround(F.regexp_extract(text, r"pts_time:([\d.]+)", 1).try_cast("double"), 3)
    return C.thin(lines.select(key, t.alias("t")).where("t >= 0").distinct(), key, "t", SCENE_GAP)


def keyframe_times(documents: DataFrame, key: str, text: str = "value", gap: float = FRAME_GAP) -> DataFrame:
    """(key, t): the times of the frames of JSON documents: of a frame's three fields the first that says something."""
    fields = ("best_effort_timestamp_time", "pkt_pts_time", "pkt_dts_time")
    frames = F.from_json(text, "frames array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")["frames"]
    rows = documents.select(key, F.explode(frames).alias("f"))
    said = F.coalesce(*[F.when(F.col(f"f.{f}") != "", F.col(f"f.{f}")) for f in fields])
    return C.thin(rows.select(key, F.bround(said.try_cast("double"), 3).alias("t")).where("t >= 0").distinct(), key, "t", gap)


def probe(rate: Column, duration: Column, stream: Column) -> Column:
    """(fps, duration, width, height, defaulted) from a probe's texts: a rate as num/den, a duration, a JSON object with the frame's size.
    What can't be read counts as 30 a second, 10 s and 1920 x 1080, and `defaulted` says so."""
    part = lambda i: F.split_part(rate, F.lit("/"), F.lit(i)).try_cast("double")
    fps = F.try_divide(part(1), F.when(rate.contains("/"), part(2)).otherwise(F.lit(1.0)))
    j = F.from_json(stream, "width int, height int")
    read = {"fps": (F.when(fps > 0, fps), FPS), "duration": (duration.try_cast("double"), DURATION), "width": (j["width"], WIDTH), "height": (j["height"], HEIGHT)}
    lost = None
    for c, _ in read.values():
        lost = c.isNull() if lost is None else lost | c.isNull()
    return F.struct(*[F.coalesce(c, F.lit(d)).alias(n) for n, (c, d) in read.items()], lost.alias("defaulted"))


def edit_list(plan: DataFrame) -> DataFrame:
    """(track_id, seg_idx, value): a line for each clip, for tools that join files. Backslashes become slashes; a quote is closed, escaped and opened again."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    return plan.select("track_id", "seg_idx", F.format_string("file '%s'", F.replace(path, F.lit("'"), F.lit("'\\''"))).alias("value"))


def write_edit_lists(plan: DataFrame, to: str) -> DataFrame:
    """One text file a track, its lines in segment order; a table (track_id, path) of the files. A track's lines pass by in order, and a file has its name once it is whole.

    The tasks are as many as a shuffle's: lines are few bytes, but a file costs the same however short, so tasks must not be put together by bytes."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = edit_list(plan).repartition(n, "track_id").sortWithinPartitions("track_id", "seg_idx")
    root = f"{to.rstrip('/')}/{uuid.uuid4().hex}"

    def put(batches):
        where, at = _place(root)
        out, now, done = None, object(), []

        def close():
            if out is not None:
                out.close()
                where.move(f"{path}.{mine}", path)
                done.append((now, f"{root}{path[len(at):]}"))

        def table():
            return pd.DataFrame({"track_id": pd.Series([k for k, _ in done], dtype="Int64"), "path": pd.Series([p for _, p in done], dtype=object)})

        mine = uuid.uuid4().hex  # of two runs of a task each has its own file until it is whole
        for pdf in batches:
            key = pdf["track_id"]
            starts = np.flatnonzero(~(key.eq(key.shift()) | (key.isna() & key.shift().isna())).to_numpy() | (np.arange(len(pdf)) == 0))
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                name = None if key.iloc[lo] != key.iloc[lo] else key.iloc[lo]
                if name != now:
                    close()
                    now, said = name, "null" if name is None else str(int(name))
                    folder = f"{at}/{zlib.crc32(said.encode()) % FOLDERS:03d}"
                    where.create_dir(folder)
                    path = f"{folder}/{said}.txt"
                    out = where.open_output_stream(f"{path}.{mine}")
                out.write("".join(f"{line}\n" for line in pdf["value"].iloc[lo:hi]).encode())
            yield table()
            done.clear()
        close()
        yield table()

    return written(lines.select(F.col("track_id").cast("long").alias("track_id"), "value").mapInPandas(put, "track_id long, path string"))


def read_edit_lists(files: DataFrame) -> DataFrame:
    """(track_id, value): the text of each track's file. The tasks open the files that the table names; no folder is listed."""

    def texts(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part, said = pdf.iloc[lo : lo + 1000], []
                for path in part["path"]:
                    where, at = _place(path)
                    with where.open_input_stream(at) as f:
                        said.append(f.read().decode())
                yield pd.DataFrame({"track_id": part["track_id"].astype("Int64"), "value": pd.Series(said, index=part.index, dtype=object)})

    return files.select("track_id", "path").mapInPandas(texts, "track_id long, value string")


def write_library(moments: DataFrame, to: str, version: str, ai_enabled: bool) -> int:
    """Moments with their source's video_id and signature as one commit: the videos that are there are replaced, each as a whole, all of them or none. The library's new version."""
    rows = moments.withColumns({"version": F.lit(version), "ai_enabled": F.lit(ai_enabled)})
    return Library(moments.sparkSession, to).commit(rows)


def read_library(spark: SparkSession, path: str, schema: StructType | str, version: str, need_ai: bool) -> DataFrame:
    """Moments of a library that were made by this version and, where tags are asked for, with them."""
    rows = Library(spark, path).read(schema).where(F.col("version") == version)
    return rows.where("ai_enabled") if need_ai else rows


def read_documents(lines: DataFrame, schema: str, version: str, need_ai: bool, text: str = "value") -> DataFrame:
    """Cached documents from lines of JSON: those that parse, are of this version and, where tags are asked for, have them."""
    j = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    got = lines.select(j.alias("j")).where(F.col("j.version") == version).select("j.*")
    return got.where(F.coalesce("ai_enabled", F.lit(False))) if need_ai else got
