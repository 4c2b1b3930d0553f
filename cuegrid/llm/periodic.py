"""Periodic runs of words, found through string synchronising sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import _parts as parts

#: Periods under this are found by comparing the words with themselves, so many places on; the others by the synchronising sets of the scales from here on.
SMALL = 8
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Codes(dict):
    """A number for each new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible order (shifts and odd factors)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of 2 * width words from those of width words."""
    return _mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[width:] + np.uint64(width)))


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, in two passes over blocks."""
    n, pad = len(x), -len(x) % width
    blocks = np.concatenate([x, np.full(pad, _LAST)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _agreement(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """[lo, hi) around `at` in which every word equals the one a period on: compared word by word, in spans of growing length."""
    lo, size = at, 64
    while lo > 0:
        a = max(0, lo - size)
        odd = np.flatnonzero(codes[a:lo] != codes[a + period : lo + period])
        if len(odd):
            lo = a + int(odd[-1]) + 1
            break
        lo, size = a, 2 * size
    hi, size, end = at, 64, len(codes) - period
    while hi < end:
        b = min(end, hi + size)
        odd = np.flatnonzero(codes[hi:b] != codes[hi + period : b + period])
        if len(odd):
            hi += int(odd[0])
            break
        hi, size = b, 2 * size
    return lo, hi


def synchronising_set(ids: np.ndarray, width: int, periodic: np.ndarray) -> np.ndarray:
    """Places i where the least id of the windows i .. i + width is that of the first or the last of them. `ids` are by the window's words, `periodic` marks the windows left out.

    Whether i belongs to the set is decided by the 2 * width words from i on. In each `width` successive places there is one of the set, unless all windows from there to
    2 * width on are left out."""
    ids = np.where(periodic, _LAST, ids)
    if len(ids) <= width:
        return np.zeros(0, np.int64)
    least = _least_of(ids, width + 1)
    return np.flatnonzero((least != _LAST) & ((least == ids[: len(least)]) | (least == ids[width:])))


def maximal_runs(codes: np.ndarray, longest: int, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least `least` words and four periods, by start, then period.

    At the scale of `width` words a run of period p, width <= p < 2 * width, has a place of the set in its first period: were all windows there left out, whose periods are a quarter of
    the scale at most, the run would have their period. The next place with the same 2 * width words is one period on, as these words hold a whole primitive period. So
    equal contexts at a distance in [width, 2 * width) propose all such runs, and comparing the words themselves decides. The windows left out are the insides of the runs of
    smaller periods, which the scales before and the comparisons under SMALL supply. `longest` bounds the length of a run.
    """
    n = len(codes)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(1, min(SMALL, longest // 4 + 1, n)):
        a, b = _stretches(codes[q:] == codes[:-q])
        ok = b - a + q >= max(least, 4 * q)
        found.append((a[ok], b[ok] + q, np.full(int(ok.sum()), q, np.int64)))
    width, h, wide = SMALL, _mixed(codes.astype(np.uint64)), 1
    while 4 * width <= longest:
        while wide < width:
            h, wide = _doubled(h, wide), 2 * wide
        start, end, period = (np.concatenate(x) for x in zip(*found))
        inner = (4 * period <= width) & (end - start >= width)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, start[inner], 1)
        np.add.at(edge, end[inner] - width + 1, -1)
        at = synchronising_set(h, width, np.cumsum(edge[:-1]) > 0)
        context = _doubled(h, width)
        at = at[at < len(context)]
        by = at[np.argsort(context[at], kind="stable")]
        gap = np.diff(by)
        near = np.flatnonzero((context[by[1:]] == context[by[:-1]]) & (gap >= width) & (gap < 2 * width))
        new, last, known = [], -1, -1
        for k in near[np.lexsort((by[near], gap[near]))].tolist():
            i, p = int(by[k]), int(gap[k])
            if p == last and i < known:  # in the stretch that was looked at
                continue
            lo, hi = _agreement(codes, i, p)
            last, known = p, hi
            if hi - lo + p >= max(least, 4 * p):
                new.append((lo, hi + p, p))
        if new:
            found.append(tuple(np.array(x, np.int64) for x in zip(*new)))
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)  # of several periods of one stretch the smallest is its own
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(texts: list[str | None], least: int = 6) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """For each text: how many words, its runs (start, length, period), and its words without those that a run repeats.

    The texts are one array of word numbers, with a number of its own between any two of them: no run passes it."""
    names = Codes()
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    offset = np.concatenate([[0], np.cumsum(lens + 1)])
    codes = np.empty(int(offset[-1]), np.int64)
    for k, w in enumerate(words):
        codes[offset[k] : offset[k] + len(w)] = np.fromiter(map(names.__getitem__, w), np.int64, len(w))
        codes[offset[k + 1] - 1] = -1 - k
    start, end, period = maximal_runs(codes, int(lens.max(initial=0)), least)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    repeated = np.cumsum(edge[:-1]) > 0
    cut = np.searchsorted(start, offset)
    runs, kept = [], []
    for k, w in enumerate(words):
        s = slice(cut[k], cut[k + 1])
        runs.append(list(zip((start[s] - offset[k]).tolist(), (end[s] - start[s]).tolist(), period[s].tolist())))
        if runs[-1]:
            w = [w[i] for i in np.flatnonzero(~repeated[offset[k] : offset[k] + len(w)]).tolist()]
        kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
    return lens.tolist(), runs, kept


def periodic_runs(df: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and `collapsed`: the text's words, joined by a space, without those that lie in a run after its first period.

    Words are what ASCII white space parts. A run is a stretch of at least `least` words and four of its smallest period that no neighbouring word extends. Null and empty texts have no word, no run and
    an empty rest; repeated rows are answered each, null doc_ids included; other columns are not read, whatever their names. An empty table gives an empty one. Whole texts are read, in one pass without a
    shuffle: a task holds the documents of about 300,000 words at a time, or one longer document.
    """
    schema = T.StructType([df.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n, runs, kept = runs_of(part.column("text").to_pylist(), least)
            flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)), rows, type=kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), lists, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
