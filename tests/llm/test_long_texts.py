"""Operators on very long texts of one letter, mark, word or line, and of one word between marks."""

import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import decontamination, jaccard, lines, packing, quality, sharding, substrings, toxicity

N = 300_000
LONG = ["a" * N, "." * N, "word " * (N // 5), "one more line of text that is long enough to count here\n" * (N // 57), "a" + "." * N + "b", "1" * N, "é" * (N // 2), "\n" * N, "x-" * (N // 2), None, ""]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(LONG)], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)


def test_marks_are_stripped_as_by_a_pattern():
    edge, rng = re.compile(r"^[^\w$€£+-]+|[^\w%]+$"), random.Random(1)
    for _ in range(20_000):
        word = "".join(rng.choice("ab1.,$%+-€(") for _ in range(rng.randint(0, 8)))
        assert decontamination._bare(word) == edge.sub("", word)
    start = time.time()
    for word in ("a" + "." * 10**6 + "b", "-" * 10**6, "1" * 10**6, ".'" * 500_000 + "x", "1," * 500_000 + "x", "$" * 10**6, "1:" * 500_000 + "st"):
        decontamination._Canon()(word)
    assert time.time() - start < 10


def test_leaks_of_long_texts(spark, long_docs):
    items = spark.createDataFrame([(1, "what is the distance that a train covers in three hours at this speed"), (2, " ".join(["word"] * 12))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(long_docs, items).collect()} == {(2, 2)}


def test_sharding_and_quality_of_long_texts(long_docs):
    assert sharding.shard_documents(long_docs, 24).count() == len(LONG)
    got = {r.doc_id: r for r in quality.repetition_rules(long_docs).collect()}
    assert not any(got[i].kept for i in range(len(LONG))) and got[2].n_repeat_words == N // 5


def test_packing_of_long_texts(long_docs):
    got = packing.pack_documents(long_docs, public_tokenizers.path("byte_bpe_50k.json"), 2048).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(got) == len(LONG) and all(r.n == r.m for r in got)


def test_repeats_of_long_texts(long_docs):
    got = {r.doc_id: r for r in substrings.remove_repeats(long_docs.where("doc_id < 7"), 400).collect()}
    assert all(got[i].n_removed == got[i].n_bytes for i in (0, 1, 2, 5, 6)) and got[4].n_removed == N + 2 - 2


def test_near_copies_of_long_texts(long_docs):
    got = {r.doc_id: r for r in jaccard.jaccard_classes(long_docs, 5, 0.8).collect()}
    assert len(got) == len(LONG)


def test_lines_of_long_texts(long_docs):
    got = {r.doc_id: r for r in lines.dedup_lines(long_docs, short=True).collect()}
    assert got[3].n_dropped >= N // 57 - 1


def test_toxicity_of_long_texts(spark, long_docs):
    rng = random.Random(3)
    few = [(100 + i, " ".join(rng.choice(["good", "kind", "calm", "blue"] if i % 2 else ["vile", "scum", "hate", "blue"]) for _ in range(12)), "en", "s", 50) for i in range(200)]
    docs = long_docs.unionByName(spark.createDataFrame(few, long_docs.schema))
    labels = spark.createDataFrame([(100 + i, 1, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == len(LONG) + 200 and all(0 <= r.score <= 1 for r in got)
