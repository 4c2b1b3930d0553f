"""Phrase collocations by partitioned mining: complete local counts, frequent phrases united, exact global counts."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, text_of, thinned
from .periodic import Codes

#: What parts a text into pieces, as one sign; a piece is parted into words by blanks.
_LEVEL = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
#: Words that are counted together, about; characters that are parted together; rows that are handed on together.
CHUNK_WORDS, CHUNK_CHARS, ROWS = 1_500_000, 1_000_000, 100_000
#: A filter of frequent phrases has so many bits, whatever the input: what is sent to the tasks is 8 MB.
BITS = 1 << 26
#: A language's phrases are ranked in so many parts before the best of these are ranked together.
RANK_PARTS = 16


def _numbers(texts: list[str], names: Codes) -> np.ndarray:
    """The texts' words as numbers from 2 on, in order, with 1 where a piece ends."""
    flat = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass").lower().translate(_LEVEL).replace(b"\n", b" \n ").split(b" ")
    got = np.fromiter(map(names.__getitem__, flat), np.int32, len(flat))
    return got[got > 0]


def _spelt(codes: np.ndarray, places: np.ndarray, size: int, words: pa.Array) -> pa.Array:
    """The phrases of `size` words from each place on, joined by a space."""
    return pc.binary_join_element_wise(*[words.take(pa.array(codes[places + k])) for k in range(size)], b" ")


def _grams(codes: np.ndarray, sizes: range, words: pa.Array, frequent) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of each size. Of phrases over two words only those are counted whose parts without the last and the first word may be `frequent`."""
    places, ids = np.flatnonzero(codes > 1), codes.astype(np.int64)
    for m in range(1, sizes[-1] + 1):
        if m > 1:
            places = places[places + m - 1 < len(codes)]
            places = places[(ids[places] >= 0) & (ids[places + 1] >= 0) & (codes[places + m - 1] > 1)]
            if not len(places):
                return
            _, first, inverse, counts = np.unique(ids[places] * len(words) + codes[places + m - 1], return_index=True, return_inverse=True, return_counts=True)
        else:
            _, first, inverse, counts = np.unique(codes[places], return_index=True, return_inverse=True, return_counts=True)
        at = places[first]
        if m in sizes:
            for lo in range(0, len(at), ROWS):
                yield _spelt(codes, at[lo : lo + ROWS], m, words), counts[lo : lo + ROWS]
        if m < sizes[-1]:
            if m >= 2:
                keep = np.concatenate([frequent(_spelt(codes, at[lo : lo + ROWS], m, words)) for lo in range(0, len(at), ROWS)] or [np.zeros(0, bool)])
                inverse = np.where(keep[inverse], inverse, -1)
            ids = np.full(len(codes), -1, np.int64)
            ids[places] = inverse


def local_counts(docs: DataFrame, sizes: range, shards: int, bits: bytes | None = None) -> DataFrame:
    """(shard, lang, phrase, n): the phrases of these sizes of a task's texts, counted in portions of about CHUNK_WORDS words. A shard is every shards-th task.

    `bits` is a filter of frequent phrases of each size under the greatest and over one word: a phrase over two words is left out if a part that is one word shorter is not in it."""
    told = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        names: dict[str, Codes] = defaultdict(lambda: Codes({b"": 0, b"\n": 1}))
        parsed, waiting = defaultdict(list), defaultdict(list)
        held = chars = 0

        def parse() -> int:
            n = 0
            for lang, texts in waiting.items():
                parsed[lang].append(_numbers(texts, names[lang]))
                n += len(parsed[lang][-1])
            waiting.clear()
            return n

        def counted() -> Iterator[pa.RecordBatch]:
            filled = np.frombuffer(told.value, np.uint8) if told.value else None
            for lang, codes in parsed.items():
                start = zlib.crc32(f"{lang} ".encode())

                def frequent(phrases: pa.Array, start=start) -> np.ndarray:
                    at = np.fromiter((zlib.crc32(x, start) for x in phrases.to_pylist()), np.int64, len(phrases)) & (BITS - 1)
                    return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

                words = pa.array(list(names[lang]), pa.binary())
                for phrases, counts in _grams(np.concatenate(codes), sizes, words, frequent):
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard, pa.int32()), n), pa.repeat(pa.scalar(lang), n), phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["shard", "lang", "phrase", "n"])
            names.clear()
            parsed.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py()
                waiting[lang].append(text)
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    held, chars = held + parse(), 0
                    if held >= CHUNK_WORDS:
                        yield from counted()
                        held = 0
        parse()
        yield from counted()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text")).mapInArrow(run, "shard int, lang string, phrase string, n long")


def frequent_bits(phrases: DataFrame) -> bytes:
    """A set of BITS bits with the CRC of each (lang, phrase): at most BITS / 64 rows of two longs reach the driver."""
    at = F.crc32(F.concat_ws(" ", "lang", "phrase")).bitwiseAND(BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    got = phrases.groupBy(F.shiftright(at, 6).alias("no")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, "<i8")
    out[got["no"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def frequent_phrases(local: DataFrame, support: int, shards: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, f) of all phrases that occur `support` times. `local` is complete: what is so frequent has its share, support / shards, in one shard at least. Phrases
    with that share somewhere are united in a set of bits of fixed size; what passes it is counted over all shards, and the count decides."""
    share = -(-support // shards)
    keyed = local.withColumn("key", F.xxhash64("lang", "phrase"))
    candidates, _ = thinned(keyed, "key", keyed.where(F.col("n") >= share).select("key"))
    return scratch(candidates.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support))


def _size() -> Column:
    return F.size(F.split("phrase", " "))


def collocations(docs: DataFrame, max_words: int = 3, support: int = 10, cover: int = 50, top: int = 2000, shards: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to max_words words.

    Texts are lower-cased (A to Z), parted into pieces at . , ; : ! ? and line ends, and these into words at spaces and tabs. a, l and r count the phrase and the two parts of its worst cut within pieces,
    overlaps included; n counts the language's words; score is floor(1000000 a a / (l r)), in whole numbers of 38 digits. Phrases with a < support are left out, and those inside a longer phrase that
    has `cover` percent of their count. Null texts are empty, a null lang is `und`; repeated rows count each; other columns are not read. An empty table, and a language without a frequent phrase, give no row.

    Phrases are mined length by length: each shard is counted completely, phrases with a support / shards share in a shard are united, and counted exactly over all. `shards` is a number of logical parts,
    each dealt over its tasks and reducers, not one task: with as many parts as tasks a share would be one occurrence and leave nothing out. Longer phrases are made only where both shorter parts
    are frequent. A hot word, line or text is counted within its task before it is shuffled.
    """
    if shards > support or support < 1 or max_words < 2:
        raise ValueError("needs 1 <= shards <= support and max_words >= 2")
    with Scratch(docs.sparkSession) as scratch:
        found, n, bits = None, None, None
        for sizes in (range(1, 3), *[range(m, m + 1) for m in range(3, max_words + 1)]):
            local = scratch(local_counts(docs, sizes, shards, bits).groupBy("shard", "lang", "phrase").agg(F.sum("n").alias("n")))
            if n is None:
                n = scratch(local.where(F.instr("phrase", " ") == 0).groupBy("lang").agg(F.sum("n").alias("n")))
            new = frequent_phrases(local, support, shards, scratch)
            found = new if found is None else found.unionByName(new)
            scratch.drop(local)
            if sizes[-1] < max_words:
                bits = frequent_bits(found.where(_size() >= 2))
        return materialise(_ranked(found, n, cover, top))


def _ranked(found: DataFrame, totals: DataFrame, cover: int, top: int) -> DataFrame:
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    several = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).withColumn("size", F.size("w")).where("size >= 2")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"top": F.lit(1000000).cast("decimal(38,0)") * big("a") * big("a"), "low": big("l") * big("r")}).withColumn("score", F.expr("top div low"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = several.where("size >= 3").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).select("lang", "a", part(F.col("i"), F.col("m")).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
