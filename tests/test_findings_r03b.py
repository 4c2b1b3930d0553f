from pyspark.sql import functions as F

from cuegrid.sources import ingest as I


def test_edit_lists_are_written_by_many_tasks(spark, tmp_path):
    rows = [(k, i, f"C:\\a\\it's {k}-{i}.mp4") for k in [*range(40), None] for i in (2, 0, 1)]
    plan = spark.createDataFrame(rows, "track_id long, seg_idx int, path string")
    files = I.write_edit_lists(plan, f"file://{tmp_path}/lists")
    assert len(files.inputFiles()) == 4  # before: one task, since the lines are few bytes
    got = {r.track_id: r.value for r in I.read_edit_lists(files).collect()}
    assert got == {k: "".join(f"file 'C:/a/it'\\''s {k}-{i}.mp4'\n" for i in range(3)) for k in [*range(40), None]}
    found = [p for p in (tmp_path / "lists").rglob("*") if p.is_file()]
    assert len(found) == 41 and all(p.suffix == ".txt" for p in found)


def test_edit_lists_over_batches(spark, tmp_path):
    plan = spark.range(300).select(F.floor(F.col("id") / 100).alias("track_id"), (F.col("id") % 100).alias("seg_idx"), F.format_string("%05d", "id").alias("path"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = {r.track_id: r.value for r in I.read_edit_lists(I.write_edit_lists(plan, f"file://{tmp_path}/lists")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: "".join(f"file '{k * 100 + i:05d}'\n" for i in range(100)) for k in range(3)}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_take_each_percentile_once(spark):
    from cuegrid.plans import cues

    # seven normalised columns and four strong hits; before: five for each normalised column
    assert optimized(cues._features(spark, "/root/testdata/sf0.001")).count("percentile(") == 11


def test_a_reply_is_parsed_once(spark):
    from cuegrid.operators import tagging as G
    from cuegrid.sources import views as V

    tags = V.tag_replies(spark, "/root/testdata/sf0.001").select("id", G.parsed(F.col("reply")).alias("tag"))
    read = tags.select("id", *[F.when(F.col("tag.reason").isNull(), F.col(f"tag.{c}")).alias(c) for c in ("emotion", "recommended_use", "action_intensity")])
    assert optimized(read).count("from_json(") == 1  # before: once for each field that is looked at


def test_selected_moments_are_scored_once_and_asked_by_many_tasks(spark, monkeypatch):
    from cuegrid.operators import tagging as G
    from cuegrid.plans import library

    asked = []
    known = G.ask_tagger
    monkeypatch.setattr(G, "ask_tagger", lambda m, *a: asked.append(m) or known(m, *a))
    library.j1_tagger(spark, "/root/testdata/sf0.001")
    assert optimized(asked[0]).count("Join") == 0  # before: the scores were made anew and joined
    assert asked[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_moments_are_exchanged_once(spark):
    from cuegrid.plans import library

    plan = library.g2_quota_sample(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # before: two, by l_suppkey and by video_id


def test_quota_sample_of_few(spark):
    from cuegrid.operators.moments import quota_sample

    df = spark.createDataFrame([(k, i, float(i % 3), float(-i), float(i % 5)) for k in (1, None) for i in range(9)], "k int, i int, a double, b double, c double")
    got = {k: sorted(r.i for r in quota_sample(df, "k", "i", ("a", "b", "c"), 4).collect() if r.k == k) for k in (1, None)}
    # the best by a is 2, by b 0, by c 4; one more is 0, 1, .. in order, and 0 is taken
    assert all(len(v) <= 4 and {0, 2, 4} <= set(v) for v in got.values()) and got[1] == got[None]
    assert quota_sample(df, "k", "i", ("a", "b", "c"), 9).count() == 18
