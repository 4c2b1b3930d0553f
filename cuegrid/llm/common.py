"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, written

__all__ = ["Scratch", "documents", "doc_key", "materialise", "text_of", "thinned"]
#: A filter of wanted keys: so many longs of bits at most, 2^25 bits in all, whatever the input.
WORDS = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back. This cuts the lineage: an executor that is
    lost later costs a re-read, not a re-run, and every later reader sees the same rows."""
    return written(df)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def doc_key(docs: DataFrame) -> Column:
    """A document by its id and text; a null id is one of its own."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("\u0000null")), F.coalesce(docs["text"].cast("string"), F.lit("")))


def thinned(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in wanted, rows whose key is not), by a set of bits of fixed size: what is broadcast is WORDS rows of two longs
    at most. The more keys are wanted, the more rows pass; a join on the key must follow and decides. Null keys are not wanted."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(WORDS * 64))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    words = wanted.select(at(key).alias("__at")).groupBy(F.shiftright("__at", 6).alias("__no")).agg(F.bit_or(bit(F.col("__at"))).alias("__bits"))
    keyed = df.withColumn("__at", at(key)).withColumn("__no", F.shiftright("__at", 6))
    hit = F.coalesce(F.col(key).isNotNull() & (F.col("__bits").bitwiseAND(bit(F.col("__at"))) != 0), F.lit(False))
    marked = keyed.join(F.broadcast(words), "__no", "left").select(*df.columns, hit.alias("__hit"))
    return marked.where("__hit").select(df.columns), marked.where("NOT __hit").select(df.columns)
