"""Removal of byte strings that occur elsewhere in the corpus, by suffix arrays over routed contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffixes import kasai, suffix_order

#: Bytes of an anchor, and positions of one segment of a long text.
GRAM, SEGMENT = 128, 1 << 20
POS = np.uint64((1 << 22) - 1)
#: Bytes of a shard's contexts, and contexts of one anchor that a shard may hold.
SHARD_BYTES, HOT = 2_000_000, 3_000
PACK = 7


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, and the powers of an odd base and of its inverse."""
    table = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hashes:
    """Hashes of any substring of a byte string in constant time."""

    def __init__(self, b: np.ndarray):
        table, up, self.down = _powers(SEGMENT + 8192)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _contexts(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(s1, s2, anchor, anchor hash): runs of windows of `length` bytes that share an anchor.

    A window's anchor is the gram in it with the least hash, the leftmost on a tie, so equal windows have
    equal anchors at equal places. Windows s1..s2 of a run cover the bytes s1..s2+length-1, the context.
    """
    grams = len(b) - GRAM + 1
    h = _Hashes(b)
    at = np.arange(grams)
    full = h.of(at, at + GRAM)
    low = (full & ~POS) | at.astype(np.uint64)
    width, have = length - GRAM + 1, 1
    least = low
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    s1 = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    s2 = np.append(s1[1:], len(least)) - 1
    anchor = (least[s1] & POS).astype(np.int64)
    return s1, s2, anchor, full[anchor]


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Of each context a hash of its very bytes, by another function than the anchors', and of its anchor's place: with the anchor's hash 128 bits tell contexts apart."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    got = np.fromiter((digest(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return _mix(got + (anchors - starts).astype(np.uint64))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, not touching."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


CONTEXT = "key binary, s1 int, s2 int, anchor int, lo int, hi int, ah long, ch long"


def _scan(length: int):
    """Contexts of each text, each distinct one once; a row marked `own` is a stretch found twice in its own text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in pdf["text"]:
                raw = text.encode("utf-8")
                if len(raw) < length:
                    continue
                key = hashlib.sha256(raw).digest()
                b = np.frombuffer(raw, np.uint8)
                parts = []
                for lo in range(0, len(b) - length + 1, SEGMENT):
                    part = b[lo : lo + SEGMENT + length - 1]
                    s1, s2, anchor, ah = _contexts(part, length)
                    parts.append((s1 + lo, s2 + lo, anchor + lo, ah))
                s1, s2, anchor, ah = (np.concatenate(x) for x in zip(*parts, strict=True))
                ch = _digests(raw, s1, s2 + length, anchor)
                order = np.lexsort((s1, ch, ah))
                head = np.ones(len(order), bool)
                head[1:] = (ah[order][1:] != ah[order][:-1]) | (ch[order][1:] != ch[order][:-1])
                if not head.all():
                    again = ~head
                    again[:-1] |= ~head[1:]
                    a, z = _merge(s1[order[again]], s2[order[again]] + length)
                    for i, v in enumerate(([key] * len(a), a, z, a, a, a, [0] * len(a), [0] * len(a), [True] * len(a))):
                        cols[i].extend(v)
                keep = np.sort(order[head])
                left = anchor - s1
                vals = ([key] * len(keep), s1[keep], s2[keep], anchor[keep], (anchor - s2)[keep], left[keep], _signed(ah)[keep], _signed(ch)[keep], [False] * len(keep))
                for i, v in enumerate(vals):
                    cols[i].extend(v)
            if cols[0]:
                names = ("key", "s1", "s2", "anchor", "lo", "hi", "ah", "ch", "own")
                yield pd.DataFrame(dict(zip(names, cols, strict=True)))

    return run


def _cut(length: int):
    """Bytes of the wanted contexts of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, wanted in zip(pdf["key"], pdf["text"], pdf["wanted"], strict=True):
                raw = text.encode("utf-8")
                for w in wanted:
                    rows.append((key, w["s1"], w["s2"], w["anchor"], w["lo"], w["hi"], w["ah"], w["ch"], w["twice"], w["n"], raw[w["s1"] : w["s2"] + length]))
            yield pd.DataFrame(rows, columns=["key", "s1", "s2", "anchor", "lo", "hi", "ah", "ch", "twice", "n", "bytes"])

    return run


def _halve(length: int):
    """Contexts of a hot anchor, each cut in two by how far left of the anchor its windows start.

    All windows that start lo..hi bytes before the anchor share length-(hi-lo) bytes; the hash of these is
    the new anchor, so each halving tells more contexts apart, and at lo = hi only equal windows are left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, s1, anchor, cell_lo, cell_hi, ah, raw in zip(pdf["key"], pdf["s1"], pdf["anchor"], pdf["cell_lo"], pdf["cell_hi"], pdf["ah"], pdf["bytes"], strict=True):
                b = np.frombuffer(raw, np.uint8)
                h = _Hashes(b)
                mid = (cell_lo + cell_hi) // 2
                for lo, hi in ((cell_lo, mid), (mid + 1, cell_hi)):
                    a = max(s1, anchor - hi)
                    z = min(s1 + len(raw) - length, anchor - lo)
                    if a > z or lo > hi:
                        continue
                    core = anchor - lo, anchor - hi + length  # in every window of the cell
                    new = h.of(np.array([core[0] - s1]), np.array([core[1] - s1]))
                    ah2 = _mix(new + np.uint64(lo) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ah & 0xFFFFFFFFFFFFFFFF))
                    ch2 = _digests(raw, np.array([a - s1]), np.array([z + length - s1]), np.array([anchor - s1]))
                    rows.append((key, a, z, anchor, anchor - z, anchor - a, int(_signed(ah2)[0]), int(_signed(ch2)[0]), lo, hi, raw[a - s1 : z + length - s1]))
            yield pd.DataFrame(rows, columns=["key", "s1", "s2", "anchor", "lo", "hi", "ah", "ch", "cell_lo", "cell_hi", "bytes"])

    return run


def _sort_shard(length: int):
    """Stretches of a shard's contexts that another context of the shard has too, by its suffix array."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["ah", "key", "s1"])
        raws = pdf["bytes"].tolist()
        lens = np.array([len(r) for r in raws], np.int64)
        b = np.frombuffer(b"".join(raws) + b"\0" * PACK, np.uint8)
        n = int(lens.sum())
        stops = np.cumsum(lens)
        starts = stops - lens
        ends = np.repeat(stops, lens)
        left = np.minimum(ends - np.arange(n), PACK)
        packed = np.zeros(n, np.uint64)
        for k in range(PACK):
            packed = (packed << np.uint64(8)) | np.where(k < left, b[k : k + n], 0).astype(np.uint64)
        packed = (packed << np.uint64(8)) | left.astype(np.uint64)
        order, _ = suffix_order(packed, ends, int(lens.max()), PACK)  # to the end: Kasai's walk needs the whole order
        walk = lens - length + 1
        common = kasai(b[:n], starts, stops, walk, order, length)
        # the place after needs its common prefix too where its own position was not walked: it can't reach `length`
        hit = common >= length
        again = np.zeros(n, bool)
        again[order[hit]] = True
        again[order[np.flatnonzero(hit) - 1]] = True
        keys, a, z = [], [], []
        for i in np.flatnonzero(np.add.reduceat(again, starts) > 0) if n else []:
            at = np.flatnonzero(again[starts[i] : starts[i] + walk[i]])
            s = int(pdf["s1"].iloc[i])
            x, y = _merge(at + s, at + s + length)
            keys.extend([pdf["key"].iloc[i]] * len(x))
            a.extend(x)
            z.extend(y)
        return pd.DataFrame({"key": keys, "a": a, "z": z})

    return run


def _keep(pdf_rows, wanted) -> tuple[int, int, str]:
    raw = pdf_rows.encode("utf-8")
    a, z = _merge(np.array([w["a"] for w in wanted], np.int64), np.array([w["z"] for w in wanted], np.int64))
    kept = hashlib.sha256()
    at = 0
    for x, y in zip(a.tolist(), z.tolist(), strict=True):
        kept.update(raw[at:x])
        at = y
    kept.update(raw[at:])
    return int((z - a).sum()), len(a), kept.hexdigest()


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [_keep(t, w) for t, w in zip(pdf["text"], pdf["wanted"], strict=True)]
        yield pd.DataFrame({"key": pdf["key"], "removed": [g[0] for g in got], "spans": [g[1] for g in got], "kept": [g[2] for g in got]})


def repeated_stretches(texts: DataFrame, chosen: DataFrame, length: int, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, a, z): stretches of the texts (key, text, tag) whose every byte lies in a `length`-byte string
    that also starts elsewhere in the distinct texts. `chosen` (key, tag) names one row for each key."""
    rows = materialise(texts.where(F.octet_length("text") >= length).select("text").mapInPandas(_scan(length), CONTEXT + ", own boolean"))
    out = rows.where("own").select("key", F.col("s1").alias("a"), F.col("s2").alias("z"))
    level = rows.where("not own").drop("own")
    deep = 0
    while True:
        # a context is found twice if its least and greatest places differ; partial results leave each task
        place = F.struct("key", "s1", "s2", "anchor", "lo", "hi", *(["cell_lo", "cell_hi", "bytes"] if deep else []))
        where = F.struct("key", "s1")
        kinds = level.groupBy("ah", "ch").agg(F.min(where).alias("first"), F.max(where).alias("last"))
        kinds = kinds.select("ah", "ch", "first", (F.col("first") != F.col("last")).alias("twice"))
        kinds = materialise(kinds.join(kinds.groupBy("ah").agg(F.count("*").alias("n")), "ah").where("twice or n > 1"))
        out = out.unionByName(
            level.join(kinds.where("twice").select("ah", "ch"), ["ah", "ch"]).select("key", F.col("s1").alias("a"), (F.col("s2") + length).alias("z"))
        )
        wanted = kinds.where("n > 1").select("ah", "ch", "twice", "n", "first.key", "first.s1")
        # one place of each context stands for it
        if not deep:
            spans = level.join(wanted, ["ah", "ch", "key", "s1"]).groupBy("key").agg(
                F.collect_list(F.struct("s1", "s2", "anchor", "lo", "hi", "ah", "ch", "twice", "n")).alias("wanted")
            )
            one = spans.join(chosen, "key")
            cut = texts.join(one, ["key", "tag"]).select("key", "text", "wanted").mapInPandas(
                _cut(length), CONTEXT + ", twice boolean, n long, bytes binary"
            )
            cut = cut.withColumns({"cell_lo": F.lit(0), "cell_hi": F.lit(length - GRAM)})
        else:
            cut = level.join(wanted, ["ah", "ch", "key", "s1"])
        cut = materialise(cut)
        size = cut.agg(F.sum(F.length("bytes")), F.max("n")).first()
        if not size[0]:
            break
        shards = max(1, -(-size[0] // shard_bytes))
        cold = cut.where((F.col("n") <= hot) | (F.col("cell_lo") == F.col("cell_hi")))
        out = out.unionByName(
            cold.select(F.pmod(F.xxhash64("ah"), F.lit(shards)).alias("shard"), "ah", "key", "s1", "bytes")
            .groupBy("shard").applyInPandas(_sort_shard(length), "key binary, a int, z int")
        )
        if size[1] <= hot:
            break
        level = materialise(
            cut.where((F.col("n") > hot) & (F.col("cell_lo") < F.col("cell_hi"))).mapInPandas(
                _halve(length), CONTEXT + ", cell_lo int, cell_hi int, bytes binary"
            )
        )
        deep += 1
    return out


def remove_repeats(df: DataFrame, length: int = 400, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove every byte covered by a `length`-byte string (UTF-8) that also starts anywhere else in the corpus.

    Nulls: a null text is empty, a null doc_id an id like any other. Texts of any length are read whole, in segments of a million windows.

    1. Texts are keyed by SHA-256; one that occurs twice and has `length` bytes goes whole. 2. Each text is
    cut into contexts: runs of windows of `length` bytes that share their anchor, the 128-byte gram of least
    hash in the window. Equal windows have equal anchors, so equal strings meet under one key. 3. Contexts
    that occur twice as a whole are removed at once. One of each of the others whose anchor several contexts
    have goes to a shard by anchor hash. A shard is a suffix array (Larsson-Sadakane refinement) with
    Kasai's common prefixes; neighbours that share `length` bytes mark each other. A string's equals are all in its
    shard, so shards need no merging; an anchor with more than `hot` distinct contexts is halved by where
    its windows lie until its parts fit a shard. 4. Marked stretches are united per text.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row for each input row. Null and empty
    texts have no bytes. Repeated rows are copies of each other. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000null"))
    texts = df.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"), tag.alias("tag"))
    keys = materialise(df.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), tag.alias("tag"), F.octet_length(text).cast("long").alias("n_bytes")))
    distinct = materialise(keys.groupBy("key").agg(F.min("tag").alias("tag"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")))
    found = repeated_stretches(texts, distinct.select("key", "tag"), length, hot, shard_bytes)
    single = distinct.where("copies = 1").select("key", "tag")
    spans = found.distinct().join(single, "key").groupBy("key", "tag").agg(F.collect_list(F.struct("a", "z")).alias("wanted"))
    cut = texts.join(spans, ["key", "tag"]).select("key", "text", "wanted").mapInPandas(_finish, "key binary, removed long, spans long, kept string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit(""), 256)
    judged = distinct.join(cut, "key", "left").select(
        "key",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("kept", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
    # most rows are single and few are touched: only these need the join, by a key that no two rows share
    return keys.join(judged, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
