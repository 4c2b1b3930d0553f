"""Repetition rules from suffix arrays over the words of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffixes import suffix_order

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words that are suffix-sorted together, about.
CHUNK_WORDS = 300_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def common_prefixes(codes: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int, most: int) -> np.ndarray:
    """Common prefixes of neighbours in a suffix order: out[i] is that of order[i] and order[i + 1], 0 if under `least`, `most` at most."""
    a, b = order[:-1], order[1:]
    live = np.flatnonzero((a + least <= ends[a]) & (b + least <= ends[b]))
    out = np.zeros(len(a), np.int64)
    for k in range(most):
        if k >= least:
            out[live] = k
            live = live[(a[live] + k < ends[a[live]]) & (b[live] + k < ends[b[live]])]
        live = live[codes[a[live] + k] == codes[b[live] + k]]
        if not len(live):
            return out
    out[live] = most
    return out


def repeats(words: list[list[bytes]], window: int, longest_at: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words covered by repeated runs of `window` words or more, and the longest such
    run, counted up to `longest_at` words.

    All documents are one suffix array. The document is mixed into every symbol, so a suffix is only ever
    a neighbour of one of its own document. The deepest common-prefix interval that holds a suffix is as deep as the greater of its common
    prefixes with its two neighbours: that is the longest repeat from there on. Spans of `window` words or more are united with a running sum.
    """
    lens = np.array([len(w) for w in words], np.int64)
    n = int(lens.sum())
    covered, longest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if n == 0:
        return covered, longest
    flat = np.empty(n, object)
    flat[:] = [x for w in words for x in w]
    codes = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), lens)
    ends = np.repeat(np.cumsum(lens), lens)
    codes += doc * (int(codes.max()) + 1)
    # refined as far as a repeat is counted: among three copies the two that share most must be neighbours
    order, _ = suffix_order(codes, ends, 1 << max(0, (max(window, longest_at) - 1).bit_length()))
    shared = common_prefixes(codes, ends, order, window, max(window, longest_at))
    reach = np.zeros(n, np.int64)
    reach[order[:-1]] = shared
    reach[order[1:]] = np.maximum(reach[order[1:]], shared)
    starts = np.flatnonzero(reach)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + reach[starts], -1)
    inside = np.cumsum(edge[:-1]) > 0
    covered += np.bincount(doc[inside], minlength=len(words))
    np.maximum.at(longest, doc[starts], reach[starts])
    return covered, np.minimum(longest, longest_at)


def measure(texts: list[str | None], window: int, max_longest: int) -> dict[str, list[int]]:
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    covered, longest = repeats(words, window, max_longest + 1)
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        dup.append(len(lines) - len(set(lines)))
    got = (
        [len(w) for w in words],
        [len(t) - sum(map(t.count, SPACE)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        dup, covered.tolist(), longest.tolist(),
    )
    return dict(zip(MEASURES, got, strict=True))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_WORDS words (six characters each), of one row at least. Rows stay in Arrow, so no id goes through a float."""
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > 6 * CHUNK_WORDS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(batch):
            yield batch.slice(start)


def repetition_rules(
    df: DataFrame,
    window: int = 5,
    min_words: int = 10,
    max_covered: float = 0.20,
    max_longest: int = 400,
) -> DataFrame:
    """Judge each document by the text it repeats within itself.

    Words are runs of characters other than ASCII white space. A suffix array over a document's words,
    refined by doubling, gives the intervals of suffixes that share `window` words or more; the union of
    these maximal repeats is the covered part (`n_repeat_words`), and the longest of them is
    `longest_repeat` (counted up to `max_longest` + 1). A document fails the base rules with fewer than `min_words` words or more than
    `max_covered` of them covered, and the method's own limit with a verbatim repeat longer than
    `max_longest` words.

    Returns doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words, base_failed, kept and longest_repeat, one row for each
    input row, repeated rows and null doc_ids included. Null and empty texts have no words and fail. Whole texts are read; other columns are not, whatever their names.
    An empty table gives an empty table. Memory per task is one batch: the documents of about 300,000 words, or one longer document.
    """
    key = df.schema["doc_id"]
    schema = T.StructType([key, *[T.StructField(n, T.LongType()) for n in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            m = measure(part.column("text").to_pylist(), window, max_longest)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(m[n], pa.int64()) for n in MEASURES]], names=["doc_id", *MEASURES])

    found = df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_covered) * F.col("n_words"))
    return found.withColumn("base_failed", failed).select(
        "doc_id", *MEASURES[:5], "base_failed",
        (~F.col("base_failed") & (F.col("longest_repeat") <= max_longest)).alias("kept"),
        "longest_repeat",
    )


def drop_repetitive(df: DataFrame, window: int = 5, min_words: int = 10, max_covered: float = 0.20, max_longest: int = 400) -> DataFrame:
    """df, with all its columns whatever their names, without the rows that repetition_rules() would not keep: null and empty texts go, repeated rows
    are judged each. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            m = {k: np.array(v, np.int64) for k, v in measure(part.column("text").to_pylist(), window, max_longest).items()}
            ok = (m["n_words"] >= min_words) & (100 * m["n_repeat_words"] <= round(100 * max_covered) * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            yield part.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)
