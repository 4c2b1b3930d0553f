"""Tables of tracks, beats, curves, frames and moments derived from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DURATION, FPS = 48.0, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: thirty days are squeezed to 48 seconds for each user's track."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(order) - 1).alias("beat_idx"),
        (us / F.lit(54000000000.0)).alias("t"),
        "event_type", "value", "props",
    )


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beats with a curve for each event type, the value's change and the number in props."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)
    o = Window.partitionBy("track_id").orderBy("beat_idx")
    return beats(spark, sf_dir).select(
        "track_id", "beat_idx", "t", F.col("value").alias("rms"),
        of("click").alias("kick"), of("view").alias("bass"), of("purchase").alias("clap"), of("signup").alias("hihat"), of("error").alias("onset"),
        F.coalesce(F.abs(F.col("value") - F.lag("value").over(o)), F.lit(0.0)).alias("flux"),
        F.get_json_object("props", "$.k").cast("double").alias("centroid"),
    )


def moment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, id, motion, contrast, saturation, brightness): line items as moments, numbered within a video for each supplier; what all else of a moment follows from."""
    # by the column that stays: windows over video_id later need no second exchange
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "video_id")
    order = Window.partitionBy("video_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    return lines.select(
        "video_id", F.row_number().over(order).alias("id"), ((F.col("l_quantity") - 1) / 49).alias("motion"), (F.col("l_discount") / 0.10).alias("contrast"),
        (F.col("l_tax") / 0.08).alias("saturation"), (F.col("l_extendedprice") / 105000).alias("brightness"),
    )


def with_quality(rows: DataFrame) -> DataFrame:
    """moment_rows() with sharpness, colorfulness and quality: metrics in 0..1."""
    base = rows.withColumns({"sharpness": 1 - F.col("motion"), "colorfulness": F.col("saturation")})
    dark = F.greatest(F.lit(0.0), (0.25 - F.col("brightness")) / 0.25)
    blown = F.greatest(F.lit(0.0), (F.col("brightness") - 0.86) / 0.14)
    quality = 0.36 * F.col("sharpness") + 0.22 * F.col("contrast") + 0.18 * F.col("saturation") + 0.14 * (1 - dark) + 0.10 * (1 - blown)
    return base.withColumn("quality", F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0)))


def moments_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as moments: a video for each supplier, metrics in 0..1."""
    return with_quality(moment_rows(spark, sf_dir))


def _field(name: str, factor: int) -> str:
    return f"""'"{name}": 0.', (n * {factor}) % 10"""


_NUMBERS = ("action_intensity", "beauty_score", "combat", "chase", "explosion", "character_focus", "camera_motion", "visual_quality")
_SAYS = "CASE n % 5 WHEN 0 THEN 'soft' WHEN 1 THEN ' Tension' WHEN 2 THEN 'HYPE' WHEN 3 THEN 'sad' ELSE 'neutral' END"
_FOR = "CASE n % 6 WHEN 0 THEN 'drop' WHEN 1 THEN 'soft' WHEN 2 THEN 'build' WHEN 3 THEN 'Transition' WHEN 4 THEN 'flow' ELSE 'filler' END"


def _object(numbers: str, says: str = _SAYS, text: str = "concat('moment ', n)") -> str:
    return f"""concat('{{', {numbers}, ', "emotion": "', {says}, '", "recommended_use": "', {_FOR}, '", "description": "', {text}, '"}}')"""


_ALL = ", ', ', ".join(_field(k, 2 * i + 1) for i, k in enumerate(_NUMBERS))
#: A tagger's reply for the number n, in SQL that Spark and DuckDB both read: seven shapes, four of them valid.
REPLY = f"""CASE n % 7 WHEN 0 THEN {_object(_ALL)} WHEN 1 THEN concat('```json', chr(10), {_object(_ALL)}, chr(10), '```') WHEN 2 THEN concat('Here: ', {_object(_ALL)}, ' done')
 WHEN 3 THEN {_object(_ALL.rpartition(", ', ', ")[0])} WHEN 4 THEN {_object(_ALL, "'odd'")} WHEN 5 THEN {_object(_ALL.replace("'\"action_intensity\": 0.'", "'\"action_intensity\": 1.'").replace(_field("beauty_score", 3), "'\"beauty_score\": \"x\"'"))} ELSE {_object(_ALL, text="' '")} END"""


def tag_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, id, reply): what a tagger said of some moments, one reply a document."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"))
    return docs.select((F.col("n") % 10 + 1).alias("video_id"), F.expr("n div 10 + 1").alias("id"), F.expr(REPLY).alias("reply"))


REPLIES_SQL = f"""replies AS (SELECT n % 10 + 1 AS video_id, n // 10 + 1 AS id, n, {REPLY} AS reply FROM (SELECT doc_id AS n FROM documents WHERE doc_id IS NOT NULL)),
rj AS (SELECT *, regexp_extract(reply, '\\{{.*\\}}', 0, 's') AS j FROM replies),
rp AS (SELECT video_id, id, n, {', '.join(f"json_extract_string(j, '$.{k}') AS {k}" for k in _NUMBERS)}, lower(trim(json_extract_string(j, '$.emotion'))) AS emotion,
 lower(trim(json_extract_string(j, '$.recommended_use'))) AS recommended_use, trim(json_extract_string(j, '$.description')) AS description FROM rj),
valid AS (SELECT video_id, id, n, {', '.join(f"least(greatest(coalesce(TRY_CAST({k} AS DOUBLE), 0.0), 0.0), 1.0) AS {k}" for k in _NUMBERS)}, emotion, recommended_use, substr(description, 1, 160) AS description
 FROM rp WHERE {' AND '.join(f'{k} IS NOT NULL' for k in _NUMBERS)} AND emotion IN ('soft', 'tension', 'hype', 'sad', 'neutral') AND recommended_use IN ('drop', 'soft', 'build', 'transition', 'flow', 'filler') AND length(description) > 0)"""


EVENTS_SQL = """beats AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS beat_idx,
 (epoch_us(ts) - 1704067200000000) / 54000000000.0 AS t, event_type, value, props FROM events),
curves AS (SELECT track_id, beat_idx, t, value AS rms,
 CASE WHEN event_type='click' THEN value ELSE 0.0 END AS kick, CASE WHEN event_type='view' THEN value ELSE 0.0 END AS bass,
 CASE WHEN event_type='purchase' THEN value ELSE 0.0 END AS clap, CASE WHEN event_type='signup' THEN value ELSE 0.0 END AS hihat,
 CASE WHEN event_type='error' THEN value ELSE 0.0 END AS onset,
 coalesce(abs(value - lag(value) OVER (PARTITION BY track_id ORDER BY beat_idx)), 0.0) AS flux,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS centroid FROM beats)"""
MOMENTS_SQL = """m0 AS (SELECT l_suppkey AS video_id,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS id,
 (l_quantity-1)/49 AS motion, l_discount/0.10 AS contrast, l_tax/0.08 AS saturation, l_extendedprice/105000 AS brightness,
 1-(l_quantity-1)/49 AS sharpness, l_tax/0.08 AS colorfulness FROM lineitem),
moments AS (SELECT *, least(greatest(0.36*sharpness+0.22*contrast+0.18*saturation+0.14*(1-greatest(0.0,(0.25-brightness)/0.25))
 +0.10*(1-greatest(0.0,(brightness-0.86)/0.14)),0.0),1.0) AS quality FROM m0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of a video for each label, two a second."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), at.alias("frame_idx"), (at * 0.5).alias("t"), F.col("embedding").alias("vec"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each label: its length follows from its frames."""
    n = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("video_id")).agg(F.count("*").alias("n"))
    return n.select(
        "video_id", F.concat(F.lit("/src/"), F.col("video_id"), F.lit(".mp4")).alias("path"), F.lit(2.0).alias("fps"),
        (F.col("n") * 0.5).alias("duration"), (F.col("n") * 1000).alias("length"), (F.col("video_id") + 1704067200).alias("mtime"),
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes by frame and frequency, one row a bin."""
    f = frames(spark, sf_dir).select("video_id", "frame_idx", F.posexplode("vec").alias("i", "v"))
    return f.select("video_id", "frame_idx", "i", F.abs(F.col("v").cast("double")).alias("mag"), (20.0 * F.pow(F.lit(1.1), F.col("i"))).alias("freq"))


FRAMES_SQL = """frames AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
 (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 0.5 AS t, embedding AS vec FROM embeddings),
sources AS (SELECT label AS video_id, '/src/' || label || '.mp4' AS path, 2.0 AS fps, count(*) * 0.5 AS duration, count(*) * 1000 AS length, label + 1704067200 AS mtime FROM embeddings GROUP BY label),
bins AS (SELECT video_id, frame_idx, i - 1 AS i, abs(CAST(vec[i] AS DOUBLE)) AS mag, 20.0 * pow(1.1, i - 1) AS freq FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM frames)),
motions AS (SELECT *, coalesce(list_sum([abs(CAST(vec[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)) for i in range(1, len(vec) + 1)]) / len(vec), 0.0) AS motion
 FROM (SELECT *, lag(vec) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM frames))"""
