import random
import time

from pyspark.sql import functions as F

from cuegrid.llm import jaccard, lines, packing
from cuegrid.llm.common import Scratch

SCANNED = "d long, sid long, tid long, size long, sample array<long>"


def pairs_of_copies(spark, n, words, seed):
    """n texts, each twice, the second time with another word at its end."""
    rng = random.Random(seed)
    texts = [" ".join("%08x" % rng.randrange(1 << 32) for _ in range(words)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate([*texts, *(t + " more" for t in texts)])), "doc_id long, text string")


def shuffled(spark, run) -> float:
    """Bytes that run() writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(store.executorList(True)))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_texts_and_token_sets_are_shuffled_once(spark):
    docs = pairs_of_copies(spark, 150, 1500, 71).localCheckpoint()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written = shuffled(spark, lambda: jaccard.jaccard_classes(docs, 5, 0.8).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # a text and its token set are about as long here: 2.1 times the texts; with texts dealt anew by set and token sets joined to their tasks 3.9 times
    assert written < 2.8 * size


def test_documents_that_share_a_key_keep_their_links(spark, monkeypatch):
    docs = pairs_of_copies(spark, 6, 200, 72)
    sets = docs.select(F.lit(7).cast("long").alias("d"), "text").mapInPandas(jaccard._scan(5), SCANNED)
    monkeypatch.setattr(jaccard, "doc_key", lambda df: F.lit(7).cast("long"))
    with Scratch(spark) as s:
        sets = s(sets.select("sid", F.lit(1).cast("long").alias("w"), "size", "sample", "d"))
        got = jaccard._linked(docs, sets, 5, 0.8, 0.9999, s).groupBy("sid").agg(F.sum("links").alias("n")).collect()
    assert sorted(r.n for r in got) == [1] * 12


def test_sets_with_a_link_are_not_compared_with_all(spark):
    rng = random.Random(73)
    base = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]
    rows = [(h, [*base[:1980], *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(20))]) for h in range(400)]
    rows.append((400, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]))
    sets = spark.createDataFrame(rows, "h long, sh array<long>")
    with Scratch(spark) as s:
        sets = s(sets.select("h", "sh", *[c.alias(f"q{k}") for k, c in enumerate(lines._parities(F.col("sh")))]))
        prefixes = s(sets.select("h", F.lit(1).cast("long").alias("t")))
        roots = s(spark.range(200).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root")))
        lines._across(prefixes.where("h > 395"), sets, roots, 0.8, s).collect()  # code is compiled
        began = time.monotonic()
        got = lines._across(prefixes, sets, roots, 0.8, s).collect()
        took = time.monotonic() - began
    # half are one component, each other one asks: the least root of those alike, and nothing for the stranger
    assert sorted(tuple(r) for r in got) == [(h, 0) for h in range(200, 400)]
    assert took < 10  # 1.8 s on 4 cores; 30.3 s when each was compared with all


def test_the_second_tokenizer_is_loaded_only_for_texts_that_need_it(monkeypatch):
    import public_tokenizers
    import tokenizers

    path, loads, real = public_tokenizers.path("byte_bpe_50k.json"), [], tokenizers.Tokenizer

    class Counted:
        @staticmethod
        def from_file(at):
            loads.append(at)
            return real.from_file(at)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing.encoder(path)
    text = "alpha beta 17 é \n\n x"
    assert list(encode(text)) == real.from_file(path).encode(text, add_special_tokens=False).ids and not loads
