"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, doc_key, materialise, thinned
from .graph import components

#: Expected tokens of a set's shared sample, and of the paths that it starts in a run; then of each step of a path.
SAMPLE, PATHS, STEP = 48, 6, 5
#: Buckets up to this size are compared; larger ones are split DEPTH times at most, then compared in blocks.
SMALL, DEPTH, BLOCK = 64, 3, 600
#: A leaf's number starts with that of its run, at this bit.
RUN_BIT = 58
#: Rows that a task turns over at once, and words it remembers: bounds of its memory beside one bucket.
ROWS, MEMO = 1_000, 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """Hashes of words, each made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()  # kept by the Python worker


def tokens(text: str, n: int) -> np.ndarray:
    """The sorted set of hashes of a text's runs of n words; of a shorter text its only, shorter run."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i])
    return np.unique(out)


def _chosen(toks: np.ndarray, size: int, expected: float, salt: np.ndarray | int) -> np.ndarray:
    """Which tokens are chosen: each with chance expected/size, by a hash that all sets share."""
    share = min(1.0, expected / max(size, 1))
    return _mix(toks ^ np.uint64(salt)) <= np.uint64(min(int(share * 2**64), 2**64 - 1))


def _signed(x: np.ndarray) -> list[int]:
    return np.ascontiguousarray(x, np.uint64).view(np.int64).tolist()


def _scan(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                rows = []
                for d, text in zip(pdf["d"][lo : lo + ROWS], pdf["text"][lo : lo + ROWS], strict=True):
                    t = tokens(text, n)
                    tid = xxhash.xxh3_64_intdigest(text)
                    sid = xxhash.xxh3_64_intdigest(t.tobytes()) if len(t) else 0
                    at = t[_chosen(t, len(t), SAMPLE, 0x51ED270B)] if len(t) else t
                    rows.append((d, *_signed(np.array([sid, tid], np.uint64)), len(t), at.view(np.int64)))
                yield pd.DataFrame(rows, columns=["d", "sid", "tid", "size", "sample"])

    return run


def _paths(run_no: int):
    """From (sid, size, sample, path, depth) the longer paths of the set in this run: (sid, above, path), above the path it goes on from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sids, above, out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for sid, size, sample, path, depth in zip(pdf["sid"], pdf["size"], pdf["sample"], pdf["path"], pdf["depth"], strict=True):
                t = np.asarray(sample, np.int64).view(np.uint64)
                salt = int(path) & 0xFFFFFFFFFFFFFFFF
                # the sample holds a token with chance SAMPLE/size already; of a small set it holds all
                t = t[_chosen(t, min(size, SAMPLE), PATHS if depth == 0 else STEP, salt ^ 0xA5A5A5A5)]
                got = _mix(t + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - RUN_BIT)
                out.append((got | np.uint64(run_no << RUN_BIT)).view(np.int64))
                sids.append(np.full(len(got), sid, np.int64))
                above.append(np.full(len(got), path, np.int64))
            yield pd.DataFrame({"sid": np.concatenate(sids), "above": np.concatenate(above), "path": np.concatenate(out)})

    return run


def _tokens_of(n: int):
    """Token sets instead of texts, the last column; a document that only shares the key of the one that was meant is left out. The rest stays in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                toks = [tokens(t, n).tobytes() for t in part.column("text").to_pylist()]
                meant = [xxhash.xxh3_64_intdigest(t) == s & 0xFFFFFFFFFFFFFFFF for t, s in zip(toks, part.column("sid").to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(toks, pa.binary())], names=[*part.schema.names[:-1], "toks"])
                yield out.filter(pa.array(meant, pa.bool_()))

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocks of shared tokens."""
    m = len(sets)
    lens = [len(s) for s in sets]
    who = np.repeat(np.arange(m), lens)
    vals = np.concatenate(sets)
    if not len(vals):
        return np.zeros((m, m), np.float32)
    by = np.argsort(vals, kind="stable")
    vals, who = vals[by], who[by]
    head = np.concatenate([[True], vals[1:] != vals[:-1]])
    group = np.cumsum(head) - 1
    shared = np.bincount(group)[group] > 1
    who, group = who[shared], group[shared]
    if len(group):
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    out = np.zeros((m, m), np.float32)
    width = max(1, min(1024, int(group[-1]) + 1 if len(group) else 1))
    edges = np.searchsorted(group, np.arange(0, (int(group[-1]) if len(group) else -1) + 1 + width, width))
    for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if lo == hi:
            continue
        mat = np.zeros((m, width), np.float32)
        mat[who[lo:hi], group[lo:hi] - c * width] = 1
        out += mat @ mat.T
    return out


def _groups(batches: Iterator[pd.DataFrame], sets: str) -> Iterator[tuple]:
    """((leaf, block, block), rows) of a partition that is sorted by these; repeated rows of one set once."""

    def stream():
        for pdf in batches:
            yield from zip(*(pdf[c] for c in ("leaf", "ba", "bb", "sid", "w", sets, "leaves", "block")), strict=True)

    for task, rows in groupby(stream(), key=lambda r: r[:3]):
        yield task, list({r[3]: r[3:] for r in rows}.values())


def _shared_before(leaf: int, rows: list[tuple], least: int = 0) -> np.ndarray:
    """Which pairs of a task's sets share a leaf from `least` on and before this one."""
    return _overlaps([np.asarray([x for x in r[3] if least <= x < leaf], np.int64).view(np.uint64) for r in rows]) > 0


def _others(across: bool, rows: list[tuple]) -> np.ndarray:
    """Pairs of different sets; of different blocks if it is a task across two blocks."""
    block = np.array([r[4] for r in rows])
    out = block[:, None] != block[None, :] if across else np.ones((len(rows), len(rows)), bool)
    np.fill_diagonal(out, False)
    return out


LIKELY = "sid long, leaf long, ba int, bb int, block int, fresh int, near int, near_fresh int"


def _likely(threshold: float):
    """(sid, leaf, ba, bb, block, fresh, near, near_fresh) of the sets that have partners here whose sample overlaps theirs by half.

    At similarity 0.8 the samples share about 38 of 48 tokens; fewer than half has a chance under 1e-6. A pair is
    found in the least leaf of the run that it shares, and fresh if it shares none of an earlier run. Pairs whose samples reach the
    threshold are near: what earlier runs missed of these tells their recall.
    """
    names = [c.split()[0] for c in LIKELY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (leaf, a, b), rows in _groups(batches, "sample"):
            size = np.array([len(r[2]) for r in rows], np.float32)
            both = _overlaps([np.asarray(r[2], np.int64).view(np.uint64) for r in rows])
            pair = (both >= 0.5 * np.minimum(size[:, None], size[None, :])) & _others(a != b, rows)
            if pair.any():
                pair &= ~_shared_before(leaf, rows, leaf >> RUN_BIT << RUN_BIT)
                near = pair & (both >= threshold * (size[:, None] + size[None, :] - both))
                fresh = pair & ~_shared_before(leaf >> RUN_BIT << RUN_BIT, rows)
                counts = [x.sum(axis=1) for x in (fresh, near, near & fresh)]
                out.extend((rows[i][0], leaf, a, b, rows[i][4], *(int(c[i]) for c in counts)) for i in np.flatnonzero(pair.any(axis=1)).tolist())
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _compare(threshold: float):
    """Links of the sets of each (leaf, block, block): to each set its links here and a member it is joined to.

    A pair of sets may share leaves; it counts where the least of these is compared.
    """

    def one(leaf: int, a: int, b: int, rows: list[tuple]) -> list[tuple]:
        sids = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(t) for t in sets], np.float64)
        both = _overlaps(sets).astype(np.float64)
        linked = (both >= threshold * (size[:, None] + size[None, :] - both)) & _others(a != b, rows) & ~_shared_before(leaf, rows)
        links = linked @ np.array([r[1] for r in rows], np.int64)
        to, before = np.arange(len(rows)), None
        while before is None or (to != before).any():  # the least neighbour's label, and that one's own, until nothing moves
            before = to
            to = np.minimum(to, np.where(linked, to[None, :], len(rows)).min(axis=1))
            to = to[to]
        return [(sids[i], sids[to[i]], int(links[i])) for i in np.flatnonzero(linked.any(axis=1)).tolist()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (leaf, a, b), rows in _groups(batches, "toks"):
            out.extend(one(leaf, a, b, rows))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["sid", "to", "links"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["sid", "to", "links"])

    return run


def _leaves(sets: DataFrame, run_no: int, s: Scratch) -> DataFrame:
    """(sid, leaf, m): the buckets of one run that hold two sets or more, m sets each.

    A large bucket is split only if its parts have fewer pairs together than itself; members that are alike throughout would meet again in
    each part, and ever more often further down. The bucket has all pairs that its parts have, so none is lost.
    """
    large = split = leaves = None
    for depth in range(DEPTH):
        if depth == 0:
            start = sets.select("sid", "size", "sample", F.lit(run_no).cast("long").alias("path"), F.lit(0).alias("depth"))
        else:
            some, _ = thinned(sets.select("sid", "size", "sample"), "sid", large)
            start = large.join(some, "sid").select("sid", "size", "sample", "path", F.lit(depth).alias("depth"))
        paths = s(start.mapInPandas(_paths(run_no), "sid long, above long, path long"))
        counts = paths.groupBy("path", "above").agg(F.count("*").alias("m"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("who"))
        counts = s(counts.where("m > 1"))
        if depth:
            # buckets of the same members are one, so they cost once
            cost = counts.select("above", "m", "who").distinct().groupBy(F.col("above").alias("path")).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost"))
            whole = s(split.join(cost, "path").where(F.col("cost") >= F.col("m").cast("double") * F.col("m")).select("path", "m"))
            leaves = leaves.unionByName(large.join(whole, "path").select("sid", F.col("path").alias("leaf"), "m"))
            counts = s(counts.join(whole.select(F.col("path").alias("above")), "above", "left_anti"))
        last = depth == DEPTH - 1
        # buckets of the same members are one: the least of them stands for all
        ready = counts if last else counts.where(F.col("m") <= SMALL)
        ready = ready.groupBy("m", "who").agg(F.min("path").alias("path"))
        got = paths.join(ready, "path").select("sid", F.col("path").alias("leaf"), "m")
        leaves = got if leaves is None else leaves.unionByName(got)
        if not last:
            split = s(counts.where(F.col("m") > SMALL).groupBy("m", "who").agg(F.min("path").alias("path")))
            large = s(paths.join(split.select("path"), "path").select("sid", "path"))
            if large.isEmpty():
                break
    return s(leaves)


def _linked(docs: DataFrame, sets: DataFrame, n: int, threshold: float, target: float, s: Scratch) -> DataFrame:
    """(sid, to, links): for sets with a link, in each task that finds links of it: their number and a member it is joined to."""
    order = ("leaf", "ba", "bb")
    leaves = likely = None
    run_no = 0
    while True:
        new = _leaves(sets, run_no, s)
        leaves = new.drop("m") if leaves is None else s(leaves.unionByName(new.drop("m")))
        of_set = leaves.groupBy("sid").agg(F.collect_set("leaf").alias("leaves"))
        some, _ = thinned(sets.select("sid", "w", "sample"), "sid", new)
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("sid", F.lit("block")), blocks).cast("int")
        tasks = (
            new.join(of_set.join(some, "sid"), "sid")
            .select("sid", "w", "leaves", "sample", "leaf", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            .select("sid", "w", "leaves", "sample", "leaf", "block", F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"))
        )
        got = s(tasks.repartition(*order).sortWithinPartitions(*order).mapInPandas(_likely(threshold), LIKELY))
        likely = got if likely is None else likely.unionByName(got)
        near, fresh = got.agg(F.sum("near"), F.sum("near_fresh")).first()
        # a run misses a pair with chance q: what the runs before missed of this one's pairs is about q to their number
        if run_no and (not near or (fresh / near) ** ((run_no + 1) / run_no) <= 1 - target):
            break
        run_no += 1
    # the tasks of a set travel with it: token sets, which are longer than texts, are shuffled once, to their tasks
    tasks = likely.where("fresh > 0").groupBy("sid").agg(F.collect_list(F.struct(*order, "block")).alias("tasks"))
    named = s(of_set.join(sets.select("sid", "w", "d"), "sid").join(tasks, "sid"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source, _ = thinned(docs.select(doc_key(docs).alias("d"), text.alias("text")), "d", named)
    # texts by key, repeated rows once before they are shuffled; the join on the same key needs no other shuffle
    texts = source.groupBy("d").agg(F.collect_set("text").alias("texts"))
    read = named.join(texts, "d").select("sid", "w", "leaves", "tasks", F.explode("texts").alias("text"))
    read = read.mapInArrow(_tokens_of(n), T.StructType(read.schema.fields[:-1]).add("toks", T.BinaryType()))
    met = read.select("sid", "w", "leaves", "toks", F.explode("tasks").alias("task")).select("sid", "w", "leaves", "toks", "task.*")
    return s(met.repartition(*order).sortWithinPartitions(*order).mapInPandas(_compare(threshold), "sid long, to long, links long"))


def _classes(docs: DataFrame, n: int, threshold: float, target: float) -> DataFrame:
    """(d, doc_id, root, class_id, n_links, n_copies): one row for each input row; d is the document's hash."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    with Scratch(docs.sparkSession) as s:
        scanned = s(docs.select(doc_key(docs).alias("d"), text.alias("text")).mapInPandas(_scan(n), "d long, sid long, tid long, size long, sample array<long>"))
        ids = docs.select(doc_key(docs).alias("d"), "doc_id").groupBy("d").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("again"))
        texts_of = scanned.groupBy("sid", "tid").agg(F.min("d").alias("d"), F.count("*").alias("rows"))
        sets = s(
            texts_of.groupBy("sid").agg(F.count("*").alias("w"), F.min("d").alias("d"))
            .join(scanned.where(F.size("sample") > 0).select("sid", "size", "sample", "d").dropDuplicates(["sid", "d"]), ["sid", "d"])
        )
        linked = _linked(docs, sets, n, threshold, target, s)
        roots = components(linked.select(F.col("sid").alias("a"), F.col("to").alias("b")), s)
        links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
        per_set = sets.select("sid", "w").join(links, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        per_set = per_set.select("sid", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
        keyed = s(scanned.select("d", "sid", "tid").distinct().join(ids, "d"))
        texts = texts_of.select("sid", "tid", "rows").join(per_set, "sid", "left").select(
            "sid", "tid", "rows", F.coalesce("root", "sid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        )
        # the least doc_id of a class, in the order of its own type
        firsts = keyed.groupBy("sid").agg(F.min("doc_id").alias("first"))
        named = texts.join(firsts, "sid")
        classes = named.groupBy("root").agg(F.min("first").alias("class_id"))
        per_text = named.join(classes, "root").select("sid", "tid", "root", "class_id", "n_links", (F.col("rows") - 1).alias("n_copies"))
        every = keyed.join(per_text, ["sid", "tid"]).select("d", "doc_id", "root", "class_id", "n_links", "n_copies", F.explode(F.sequence(F.lit(1), F.col("again").cast("int"))).alias("no"))
        return materialise(every)


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """Near-duplicate classes of documents by the Jaccard similarity of their sets of n-word shingles.

    1. Texts become token sets; equal sets are one from here on. 2. A set keeps a sample of its tokens (48
    expected), chosen by a hash all sets share. 3. In each run a set starts 6 expected paths from its sample, other ones in every run: a bucket for each
    token. Buckets over 64 sets are split: each member goes on by tokens chosen by a hash of the path, to
    depth 3, unless the parts have more pairs together than the bucket (groups that are alike throughout). A run misses a pair of similarity 0.8 with a chance under one in a hundred. 4. Members of a bucket whose samples overlap by half are candidates.
    The share of a run's pairs with samples that reach the threshold that the runs before it had missed estimates the recall; runs are repeated until that is `target`.
    5. Candidates are compared by exact similarity of whole token sets; buckets that
    stay large (groups that are alike throughout) are compared in blocks of 600, a pair of blocks a
    task. A pair counts in the least bucket it shares, buckets of the same members are compared once.
    6. Union-find over the links gives the classes.

    Returns doc_id, class_id (the least doc_id of the class), n_links (different texts it is linked to) and
    n_copies (other rows of the same text), one row for each input row. Null and empty texts have no tokens
    and are copies of each other; null doc_ids are ids like any other, but no class is named by one that has another. A text of fewer than n words has one token, its words. Texts are read whole. Other columns are
    not read. Only the texts of sets that have a candidate are shuffled, as far as a filter of fixed size can tell. An empty table gives an empty table.
    """
    return _classes(docs, n, threshold, target).select("doc_id", "class_id", "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """docs, with all its columns, with one document of each near-duplicate class: that of the least doc_id, a null one last.

    Of documents without a word one stays. Repeated rows (doc_id and text) leave one row, any of them. Column names may clash with ours.
    """
    classes = _classes(docs, n, threshold, target)
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d")).alias("best"))
    lost = classes.join(best, "root").groupBy("d").agg(F.max(F.col("d") != F.col("best.d")).alias("lost"), F.count("*").alias("rows"))
    lost = materialise(lost.where("lost OR rows > 1").select("d", "lost"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_key(docs).alias("d"))
    some, rest = thinned(rows, "d", lost)
    some = some.join(lost, "d", "left").where("lost IS NULL OR NOT lost")
    once = some.where("lost IS NULL").select("row").unionByName(some.where("lost IS NOT NULL").dropDuplicates(["d"]).select("row"))
    return rest.select("row.*").unionByName(once.select("row.*"))
