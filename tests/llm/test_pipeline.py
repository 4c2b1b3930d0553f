import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cuegrid.llm import queries

from .test_operators import DOC, words


def test_stages_on_planted_documents(spark, tmp_path):
    """Each stage takes what it should and leaves the rest; clashing columns come through; the sequences hold the texts that are left."""
    rng = random.Random(41)
    clean = {i: "\n".join(words(rng, 30) for _ in range(3)) for i in range(10, 18)}
    item = "A train leaves the old station at 40 km and reaches the small harbour after 12 minutes with 7 people aboard"
    near = clean[10].split(" ")
    near[20] = "edit"
    shared = words(rng, 25)
    texts = dict(clean) | {
        1: "same words here now again " * 30, 2: "too few words", 3: None, 4: "",
        18: " ".join(near), 19: clean[11], 20: f"{words(rng, 40)}\n{shared}\n{words(rng, 30)}", 21: f"{words(rng, 40)}\n{shared}\n{words(rng, 30)}",
        22: f"{words(rng, 20)} {item.replace('40', '55')} {words(rng, 20)}",
    }
    rows = [(k, v, len(v) if v else None, 7, "r") for k, v in texts.items()] + [(None, words(rng, 30), 1, 7, "r")]
    docs = spark.createDataFrame(rows, DOC + ", n_chars long, n_dropped int, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{at}")
        read = spark.read.parquet(f"{tmp_path}/{at}")
        if name != "packing":
            assert read.columns == docs.columns and {r.n_dropped for r in read.collect()} == {7}
            left[name] = {r.doc_id: r.text for r in read.collect()}
    assert set(left["quality_rules"]) == {*range(10, 23), None}
    lines = [x for t in left["line_dedup"].values() for x in t.split("\n")]
    assert lines.count(shared) == 1 and len({11, 19} & set(left["line_dedup"])) == 1 and sum(x in lines for x in clean[11].split("\n")) == 3
    assert all(len(t) == n for t, n in spark.read.parquet(f"{tmp_path}/1").where("doc_id IN (20, 21)").select("text", "n_chars").collect())
    assert set(left["line_dedup"]) - set(left["near_duplicates"]) <= {10, 18}
    assert set(left["near_duplicates"]) - set(left["benchmark_decontamination"]) == {22}
    assert {12, 13, 14, 15, 16, 17, 20, 21, None} <= set(left["benchmark_decontamination"])
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([*model.encode(t, add_special_tokens=False).ids, 1] for t in left["benchmark_decontamination"].values())
    parts = {}
    for r in read.orderBy("start").collect():
        parts.setdefault(r.doc_id, []).extend(r.ids)
    assert sorted(parts.values()) == want
    full = corpus_pipeline.run(spark, str(tmp_path))
    assert full.columns == read.columns and full.agg(F.sum("length")).first()[0] == int(np.sum([len(w) for w in want]))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOC + ", n_lines int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_queries_with_sql_are_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 18
