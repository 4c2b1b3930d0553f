import random

from pyspark.sql import functions as F

from cuegrid.llm import jaccard
from cuegrid.llm.common import Scratch


def near_copies(spark, n=300, seed=51):
    rng = random.Random(seed)
    base = ["w%05d" % rng.randrange(10**5) for _ in range(400)]
    texts = []
    for i in range(n):
        own = list(base)
        own[rng.randrange(400)] = f"own{i}"
        texts.append(" ".join(own))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_a_group_alike_throughout_is_not_split(spark):
    docs, texts = near_copies(spark)
    sets = docs.select(F.col("doc_id").alias("d"), "text").mapInPandas(jaccard._scan(5), "d long, sid long, tid long, size long, sample array<long>")
    with Scratch(spark) as s:
        sets = s(sets.select("sid", "size", "sample"))
        leaves = jaccard._leaves(sets, 0, s)
        # about six buckets a set, those that it starts; before: up to 150, the parts of the parts of each
        assert leaves.groupBy("sid").count().agg(F.max("count")).first()[0] <= 24
        met = leaves.select("sid").distinct().count()
        assert met == len(texts)


def test_links_of_a_group_alike_throughout(spark):
    docs, texts = near_copies(spark, 200, 52)
    toks = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in toks) - 1 for a in toks]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs, 5, 0.8).collect()}
    assert [got[i].n_links for i in range(len(texts))] == want and {r.class_id for r in got.values()} == {0}
