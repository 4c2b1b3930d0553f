"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import decontamination, jaccard, lines, packing, quality
from cuegrid.llm.common import Scratch

#: A stage can't be told as SQL (suffix arrays, MinHash, paths, tokenizer); tests hold each to brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, with all their columns. Null and empty texts go; repeated rows are judged each; a null doc_id is no reason to go."""
    return quality.drop_repetitive(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines; documents whose every line went elsewhere go. n_chars, where there is one, follows the text.

    Null texts and documents without a word lose no line and stay. Of rows that repeat another one wholly one stays. Columns named n_lines or n_dropped stay as they are."""
    own = {c: f"{c}__own" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = lines.dedup_lines(docs.withColumnsRenamed(own), short=True).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8. Documents without a word are one class; repeated rows leave one."""
    return jaccard.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none; a null doc_id is no shelter."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, with the ids. A null or empty text is its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input. A stage's input is deleted once its output is written, but for the last one's."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for at, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if at:
            written.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
