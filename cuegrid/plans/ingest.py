"""Queries that write what other tools would leave behind from the base tables, and read it as it would be read; with their SQL."""

import uuid

from pyspark.sql import functions as F

from ..operators import planning as P
from ..sources import ingest as I
from ..sources import views as V
from ..sources.catalogue import register, write_files
from ..sources.shared import shared_dir
from .base import query, r6
from .cues import SEGMENTS_SQL, segments


def _place(spark) -> str:
    return f"{shared_dir(spark)}/cuegrid/{uuid.uuid4().hex}"


def _thinned(table: str, key: str, gap: float) -> str:
    return f"""o AS MATERIALIZED (SELECT {key}, t, row_number() OVER (PARTITION BY {key} ORDER BY t) AS rn FROM {table}), k({key}, rn, t, last, keep) AS (SELECT {key}, rn, t, t, true FROM o WHERE rn = 1
 UNION ALL SELECT o.{key}, o.rn, o.t, CASE WHEN o.t - k.last >= {gap} THEN o.t ELSE k.last END, o.t - k.last >= {gap} FROM k JOIN o ON o.{key} = k.{key} AND o.rn = k.rn + 1)"""


@query("""SELECT s_suppkey AS source, concat('clip', s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' WHEN 2 THEN '.mkv' ELSE '.MKV' END) AS name, 1 + s_suppkey % 97 AS length, CASE WHEN s_suppkey % 3 = 1 THEN 25.0 ELSE 30.0 END AS fps, CASE WHEN s_suppkey % 3 = 0 THEN 10.0 ELSE s_suppkey / 4.0 END AS duration,
 CASE WHEN s_suppkey % 3 = 0 THEN 1920 ELSE 640 END AS width, s_suppkey % 3 <> 1 AS defaulted FROM supplier WHERE s_suppkey % 5 <> 4 AND 1 + s_suppkey % 97 >= 20""")
def a1_catalogue(spark, d):
    """A folder with a file for each supplier, read as a catalogue: media files of twenty bytes or more, with what the documents beside them say. Every third has no document, every other third no rate, every fifth file is none of media."""
    k = F.col("s_suppkey")
    suppliers = V.table(spark, d, "supplier")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("mp4", "MP4", "mkv", "MKV", "txt")]), (k % 5 + 1).cast("int"))
    media = suppliers.select(F.concat(F.lit("clip"), k, F.lit("."), suffix).alias("name"), F.repeat(F.lit("x"), (1 + k % 97).cast("int")).alias("content"))
    rate = F.when(k % 3 == 1, "25").otherwise("N/A")
    said = F.to_json(F.struct(rate.alias("rate"), (k / 4).cast("string").alias("duration"), F.lit(640).alias("width"), F.lit(360).alias("height")))
    to = _place(spark)
    register(spark)
    write_files(media.unionByName(suppliers.where(k % 3 != 0).select(F.concat(F.lit("clip"), k, F.lit(".json")).alias("name"), said.alias("content"))), to)
    files = spark.read.format("catalogue").option("path", to).load().where("length >= 20")
    p = I.probe(F.coalesce(F.get_json_object("probe", "$.rate"), F.lit("")), F.get_json_object("probe", "$.duration"), F.col("probe"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("source"), name.alias("name"), "length", p.alias("p")).select("source", "name", "length", "p.fps", "p.duration", "p.width", "p.defaulted")


@query(f"WITH {V.EVENTS_SQL} SELECT track_id, beat_idx, t, rms FROM curves")
def a2_series_scan(spark, d):
    """Curves written as CSV by one tool and read with the schema they must have; no track may be lost."""
    curves = V.curves(spark, d).select("track_id", "beat_idx", "t", "rms")
    to = _place(spark)
    curves.write.option("header", True).csv(to)
    return I.read_series(spark, to, curves.schema, "csv", V.table(spark, d, "events").select(F.col("user_id").alias("track_id")))


# every fifth line has no time, every seventh no number, every eleventh a negative one
_LOG = "CASE WHEN event_id % 5 = 0 THEN 'frame dropped' WHEN event_id % 7 = 0 THEN 'frame pts_time:none x' WHEN event_id % 11 = 0 THEN concat('pts_time:-', event_id % 9) ELSE concat('frame ', event_id, ' pts_time:', (event_id * 37) % 20011, '.', (event_id * 13) % 10, ' pos') END"


@query(f"""WITH RECURSIVE l AS (SELECT user_id AS track_id, {_LOG} AS value FROM events), p AS (SELECT DISTINCT track_id, round(TRY_CAST(nullif(regexp_extract(value, 'pts_time:([\\d.]+)', 1), '') AS DOUBLE), 3) AS t FROM l),
q AS (SELECT * FROM p WHERE t >= 0), {_thinned('q', 'track_id', 0.08)} SELECT track_id, t FROM k WHERE keep""")
def a6_scene_log(spark, d):
    """Scene times out of the log lines of a tool. A line begins with its track and a tab, so files are as many as the tasks that wrote them, not as tracks."""
    lines = V.table(spark, d, "events").select(F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("\t"), F.expr(_LOG)).alias("value"))
    to = _place(spark)
    lines.write.text(to)
    return I.scene_times(spark.read.text(to).select(F.substring_index("value", "\t", 1).try_cast("long").alias("track_id"), "value"), "track_id")


_FRAME = "CASE event_id % 4 WHEN 0 THEN concat('{{\"best_effort_timestamp_time\": \"', {t}, '\"}}') WHEN 1 THEN concat('{{\"best_effort_timestamp_time\": \"\", \"pkt_pts_time\": \"', {t}, '\"}}') WHEN 2 THEN concat('{{\"pkt_dts_time\": \"', {t}, '\"}}') ELSE '{{\"pkt_pts_time\": \"N/A\"}}' END".format(
    t="concat((event_id * 41) % 997, '.', event_id % 1000 * 10 + 10001)"
)


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT user_id AS track_id, round(CAST(concat((event_id * 41) % 997, '.', event_id % 1000 * 10 + 10001) AS DOUBLE), 3) AS t FROM events WHERE event_id % 4 <> 3), {_thinned('p', 'track_id', 0.2)} SELECT track_id, t FROM k WHERE keep""")
def a7_keyframe_documents(spark, d):
    """Key frame times out of JSON documents, one a track."""
    e = V.table(spark, d, "events").select("user_id", F.expr(_FRAME).alias("frame"))
    docs = e.groupBy(F.col("user_id").alias("track_id")).agg(F.concat(F.lit('{"frames": ['), F.array_join(F.collect_list("frame"), ", "), F.lit("]}")).alias("value"))
    return I.keyframe_times(docs, "track_id")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 30000.0 / 1001 WHEN 1 THEN 25.0 ELSE 30.0 END AS fps, CASE WHEN c_custkey % 3 = 0 THEN 10.0 ELSE c_custkey / 4.0 END AS duration, CASE WHEN c_custkey % 5 = 0 THEN 1920 ELSE 640 END AS width, CASE WHEN c_custkey % 5 = 0 THEN 1080 ELSE 360 END AS height,
 c_custkey % 4 > 1 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS defaulted FROM customer""")
def a8_probe_rows(spark, d):
    """What a probe said of a file, as numbers, with defaults where it said nothing of use."""
    k = F.col("c_custkey")
    rate = F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "25").when(k % 4 == 2, "0/0").otherwise("N/A")
    stream = F.when(k % 5 == 0, "{broken").otherwise('{"width": 640, "height": 360}')
    got = I.probe(rate, F.when(k % 3 != 0, (k / 4).cast("string")), stream)
    return V.table(spark, d, "customer").select("c_custkey", got.alias("p")).select("c_custkey", "p.*")


@query(f"""WITH RECURSIVE {SEGMENTS_SQL} SELECT track_id, string_agg(concat('file ''C:/clips/', track_id, '/', seg_idx, '.mp4'''), chr(10) ORDER BY seg_idx) AS said FROM segments GROUP BY track_id""")
def a9_edit_lists(spark, d):
    """The lines of each track's edit list, as they are read back from its file."""
    plan = segments(spark, d).select("track_id", "seg_idx", F.concat(F.lit("C:\\clips\\"), "track_id", F.lit("\\"), "seg_idx", F.lit(".mp4")).alias("path"))
    read = I.read_edit_lists(I.write_edit_lists(plan, _place(spark)))
    return read.select("track_id", F.regexp_replace("value", r"\n$", "").alias("said"))


# each document as one line of JSON: every fourth of an older version, every fifth cut off, every third without tags
_DOC = "CASE WHEN c_custkey % 5 = 0 THEN concat('{\"version\": \"v2\", \"id\": ', c_custkey) ELSE concat('{\"version\": \"', CASE WHEN c_custkey % 4 = 0 THEN 'v1' ELSE 'v2' END, '\", \"id\": ', c_custkey, ', \"ai_enabled\": ', CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END, ', \"moments\": ', c_custkey % 9, '}') END"


@query("SELECT c_custkey AS id, c_custkey % 9 AS moments FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 3 <> 0")
def a4_library_documents(spark, d):
    """Cached documents that parse, are of this version and have tags."""
    lines = V.table(spark, d, "customer").select(F.expr(_DOC).alias("value"))
    to = _place(spark)
    lines.write.text(to)
    got = I.read_documents(spark.read.text(to), "version string, id long, ai_enabled boolean, moments long", "v2", True)
    return got.select("id", "moments")


@query(f"WITH {V.MOMENTS_SQL} SELECT video_id, id, round(CASE WHEN video_id % 3 = 0 THEN 1 - motion ELSE motion END, 6) AS motion FROM moments")
def a5_library_write(spark, d):
    """A library of all moments, whose every third video is then written again: one commit replaces these and no other."""
    m = V.moments_big(spark, d).select("video_id", "id", "motion")
    to = _place(spark)
    I.write_library(m, to, "v2", False)
    I.write_library(m.where("video_id % 3 = 0").withColumn("motion", 1 - F.col("motion")), to, "v2", True)
    got = I.read_library(spark, to, "id int, motion double, version string, ai_enabled boolean, video_id long", "v2", False)
    return got.select("video_id", "id", r6("motion", "motion"))


@query(f"""WITH {V.FRAMES_SQL}, own AS (SELECT video_id, path, 'proxy/' || video_id AS proxy FROM sources WHERE video_id % 3 <> 0), al AS (SELECT video_id % 2 AS album, proxy, row_number() OVER (PARTITION BY video_id % 2 ORDER BY proxy) - 1 AS no, count(*) OVER (PARTITION BY video_id % 2) AS n FROM own),
j AS (SELECT *, video_id % 2 AS album, CAST('0x' || substr(sha1(path), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM sources)
SELECT j.video_id, coalesce(own.proxy, al.proxy) AS proxy, own.proxy IS NULL AS borrowed FROM j LEFT JOIN own ON own.path = j.path LEFT JOIN al ON al.album = j.album AND al.no = CAST(floor(u * n) AS BIGINT)""")
def e8_proxies(spark, d):
    """Each source's proxy; those without borrow one of their album by hash."""
    s = V.sources(spark, d).select("video_id", "path", (F.col("video_id") % 2).alias("album"))
    own = s.where("video_id % 3 <> 0").select("path", "album", F.concat(F.lit("proxy/"), "video_id").alias("proxy"))
    return P.with_proxies(s, own, "album").select("video_id", "proxy", "borrowed")


_PICK = "CAST('0x' || substr(sha1(concat_ws('|', {0})), 1, 12) AS BIGINT) / 281474976710656.0"


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, {V.FRAMES_SQL}, src AS (SELECT video_id % 2 AS album, path, least(duration, 1.0 + video_id % 3) AS duration FROM sources), al AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY path) - 1 AS no FROM src), n AS (SELECT album, count(*) AS n FROM src GROUP BY album),
a AS (SELECT track_id, seg_idx, seconds, track_id % 2 AS album, {_PICK.format("CAST(track_id AS VARCHAR), CAST(seg_idx AS VARCHAR)")} AS u, {_PICK.format("CAST(track_id AS VARCHAR), CAST(seg_idx AS VARCHAR), 'start'")} AS w FROM segments)
SELECT a.track_id, a.seg_idx, path, round(greatest(duration - seconds, 0) * w, 6) AS start, round(least(seconds, duration), 6) AS length FROM a JOIN n ON n.album = a.album JOIN al ON al.album = a.album AND al.no = CAST(floor(u * n) AS BIGINT)""")
def f18_fallback_clips(spark, d):
    """A source and a place in it for every segment, by hash."""
    so = V.sources(spark, d).select((F.col("video_id") % 2).cast("long").alias("album"), "path", F.least("duration", 1.0 + F.col("video_id") % 3).alias("duration"))
    seg = segments(spark, d).withColumn("album", F.col("track_id") % 2)
    got = P.fallback_clips(seg, so, "album")
    return got.select("track_id", "seg_idx", "path", r6("start", "start"), r6("length", "length"))


@query(f"""WITH {V.MOMENTS_SQL}, c AS (SELECT video_id, id, (id - 1) * 2.0 - 3 AS start, CASE WHEN id % 5 = 0 THEN 0 ELSE 0.2 + quality * 2 END AS length, id % 700 / 2.0 AS duration FROM moments), f AS (SELECT *, greatest(0.05, least(length, duration)) AS fits FROM c)
SELECT video_id, id, round(greatest(0, least(start, greatest(0, duration - fits))), 6) AS start, round(fits, 6) AS length FROM f""")
def f19_bounded_clips(spark, d):
    """Planned clips within the true length of their sources."""
    m = V.moments_big(spark, d)
    start, length = (F.col("id") - 1) * 2.0 - 3, F.when(F.col("id") % 5 == 0, 0.0).otherwise(0.2 + F.col("quality") * 2)
    at, fits = P.bounded_clip(start, length, F.col("id") % 700 / 2)
    return m.select("video_id", "id", r6(at, "start"), r6(fits, "length"))
