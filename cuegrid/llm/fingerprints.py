"""Fingerprints of texts by context-triggered pieces, and their likeness by edit distance."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import text_of

#: Bytes that decide whether a piece ends after them; blocks in a text, at most; bytes of a text that is cut finer than others.
WINDOW, PIECES, SHORT = 7, 128, 32
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A piece is told by two signs.
_MARKS = [a + b for a in _SIGNS for b in _SIGNS]


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes up to each byte (of fewer at the start), by shifts and sums over the whole text."""
    out = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    factor = 1
    for back in range(min(WINDOW, len(data))):
        factor = factor * 0x01000193 % (1 << 32)
        out[back:] += wide[: len(data) - back] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _signature(data: bytes, hashes: np.ndarray, block: int) -> str:
    """Two signs a piece. A piece ends after a byte whose hash is 0 by the block, half a block from its start at the earliest and two blocks at the latest: so text that repeats itself has
    pieces of like lengths too."""
    at, out = 0, []
    for end in [*(np.flatnonzero(hashes % np.uint32(block) == 0) + 1).tolist(), len(data)]:
        while end - at > 2 * block:
            out.append(_MARKS[zlib.crc32(data[at : at + 2 * block]) & 0xFFF])
            at += 2 * block
        if 2 * (end - at) >= block or end == len(data) > at:
            out.append(_MARKS[zlib.crc32(data[at:end]) & 0xFFF])
            at = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """block:signature:signature at twice the block. The block follows from the length alone: 2 for the shortest texts, else the power of two from 4 on by which the text has at most PIECES blocks."""
    data = text.encode("utf-8", "surrogatepass")
    block = 2 if len(data) <= SHORT else 4
    while block * PIECES < len(data):
        block *= 2
    hashes = rolling(np.frombuffer(data, np.uint8))
    return f"{block}:{_signature(data, hashes, block)}:{_signature(data, hashes, 2 * block)}"


@lru_cache(maxsize=2)
def _known(text: str) -> str:
    """fingerprint(), for a text that is asked twice in a row: as a document and as the next one."""
    return fingerprint(text)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of a at once as the bits of one number."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - distance / lengths, where a piece put in or taken out costs 1 and a changed one 2."""
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 2 * _common(x, y) / (len(x) + len(y)) if x or y else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints: the greater likeness of two signatures of one block. Fingerprints without a common block are 0 alike, equal ones 1."""
    if a == b:
        return 1.0
    (p, *fine), (q, *other) = a.split(":"), b.split(":")
    one, two = ({int(n): s[0], 2 * int(n): s[1]} for n, s in ((p, fine), (q, other)))
    return max((_alike(one[n], two[n]) for n in one.keys() & two.keys()), default=0.0)


def fingerprints(df: DataFrame) -> DataFrame:
    """df's doc_id with the fingerprint of its text. Null texts are empty; repeated rows have theirs each; other columns are not read; an empty table gives an empty one."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("fingerprint", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.string())], names=["doc_id", "fingerprint"])

    return df.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def _starts(keyed: DataFrame) -> list:
    """The greatest `key` of each range of an ordering of the keys alone, descending: a row a partition."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.select("key").repartitionByRange(n, F.desc("key"))
    return [r.key for r in sorted(ranged.groupBy(F.spark_partition_id().alias("no")).agg(F.max("key").alias("key")).collect(), key=lambda r: r.no)]


def with_next(docs: DataFrame, work: Callable[[str, str], tuple], schema: str) -> DataFrame:
    """doc_id and work(text, next text), of the columns in `schema`, for each document in descending order of doc_id; the last one's next is the first.

    Rows are dealt by ranges of (doc_id, hash of the text) and sorted there; the first row of each range is dealt to the range before it too. So no task sees all rows, and texts are shuffled once.
    Documents of one doc_id are ordered by their text's hash; null ids come last. Only rows equal in both stay together, whose order is immaterial. Null texts are empty; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"]
    out = T.StructType([kind, *T.StructType.fromDDL(schema)])
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    first = _starts(keyed)
    if not first:
        return docs.sparkSession.createDataFrame([], out)
    starts = F.array(*[F.struct(F.lit(k.doc_id).cast(kind.dataType).alias("doc_id"), F.lit(k.hash).alias("hash")) for k in first])
    # the last range that starts at this key or above it, found by halving
    steps = [1 << i for i in reversed(range(len(first).bit_length()))]
    later = lambda pos, s: F.when((pos + s < len(first)) & (F.get(starts, pos + s) >= F.col("key")), pos + s).otherwise(pos)
    rows = keyed.withColumn("range", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(-1), later))
    before = F.when(F.col("range") == 0, len(first) - 1).otherwise(F.col("range") - 1)
    both = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("peek")), F.struct(before.alias("range"), F.lit(True).alias("peek")))
    rows = rows.withColumn("to", F.explode(F.when(F.get(starts, F.col("range")).eqNullSafe(F.col("key")), both).otherwise(F.slice(both, 1, 1))))
    rows = rows.select("key", "text", "to.range", "to.peek")
    ordered = rows.repartitionById(len(first), "range").sortWithinPartitions("range", "peek", F.desc("key"), "text").select("key.doc_id", "text", "range", "peek")
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got, ids = [], []
            for doc, text, no, peek in zip(batch.column("doc_id"), batch.column("text"), batch.column("range").to_pylist(), batch.column("peek").to_pylist()):
                text = text.as_py()
                if held is not None and held[2] == no:
                    ids.append(held[0])
                    got.append(work(held[1], text))
                held = None if peek else (doc.as_py(), text, no)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *zip(*got)], kinds)], schema=kinds)

    return ordered.mapInArrow(run, out)


def edited(text: str, after: str) -> str:
    """text with its last third of code points replaced by as many of the first ones of `after`, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def edit_check(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: how alike each text is to itself with its end replaced by the next document's start, and to that document.

    One row for each row of docs. See with_next() for the order and for nulls, ties and empty tables; texts under three characters are not edited."""

    def work(text: str, after: str) -> tuple:
        new = edited(text, after)
        own, changed = _known(text), fingerprint(new)
        return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, _known(after))

    return with_next(docs, work, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
