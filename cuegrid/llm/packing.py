"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Windows of one merge group; with OPEN windows from each member a group stays at a few thousand rows.
FAN_IN = 64
OPEN = 64
#: Rows and ids that a task gathers before it hands them on.
ROWS, IDS = 4096, 1 << 19


def encoder(path: str):
    """A function text -> ids for a tokenizers file: those of Tokenizer.encode(add_special_tokens=False).

    A byte-level BPE whose ids follow its merge order is the same thing as a table of ranks, and tiktoken
    applies such a table about three times faster. So where the file is of that kind its own vocabulary is
    handed to tiktoken, and only texts that hold a special token go to tokenizers; any other file is left
    to tokenizers altogether, which is loaded for the first text that needs it. Tests compare the two.
    """

    @lru_cache(maxsize=None)
    def model():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    plain = lambda text: model().encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    bpe, pre = told["model"], told.get("pre_tokenizer") or {}
    if bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or told.get("normalizer") or bpe.get("dropout") or bpe.get("ignore_merges"):
        return plain
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    special = {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in bpe["vocab"].items() if k not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    if any(bpe["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(ranks) != 256 + len(pairs):
        return plain
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: plain(text) if any(x in text for x in special) else fast(text)


_ENCODERS: dict[str, object] = {}


class _Windows:
    """At most `most` open windows. place() puts a piece into the one it fits best, or closes the fullest."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.next = 0

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window that was closed for it)."""
        closed = None
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                closed = self.free.pop(0)[1]
            room, window = self.capacity, self.next
            self.next += 1
        insort(self.free, (room - length, window))
        return window, self.capacity - room, closed


def _pack_partition(tokenizer: str, capacity: int, open_windows: int, end_id: int, keep_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encode = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, encoder(tokenizer))  # kept by the worker
        base = TaskContext.get().partitionId() << 32
        windows = _Windows(capacity, open_windows)
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
            )

        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(batch), 64):
                for doc, text in zip(ids_of.slice(lo, 64).to_pylist(), texts.slice(lo, 64).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    total = len(ids)
                    for start in range(0, total, capacity):
                        piece = ids[start : start + capacity]
                        row = [doc, start, len(piece), zlib.crc32(piece.tobytes()), total]
                        tail = [piece.astype("int32")] if keep_ids else []
                        if len(piece) == capacity:
                            out.append((*row, base + windows.next, 0, False, *tail))
                            windows.next += 1
                            continue
                        window, offset, closed = windows.place(len(piece))
                        if closed is not None:
                            out.extend(held.pop(closed))
                        held.setdefault(window, []).append((*row, base + window, offset, False, *tail))
                if len(out) >= ROWS or (keep_ids and sum(r[2] for r in out) >= IDS):
                    yield flush()
        still = len(schema.names) - 1 if not keep_ids else len(schema.names) - 2
        for rows in held.values():
            out.extend((*r[:still], True, *r[still + 1 :]) for r in rows)
            if len(out) >= ROWS:
                yield flush()
        if out:
            yield flush()

    return run


def _merge_group(capacity: int, open_windows: int):
    """Best-fit decreasing over the leftover windows of one group; the emptiest stay open for the next level."""

    def run(pdf):
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True], kind="stable")
        windows = _Windows(capacity, len(pdf) + 1)
        names: dict[int, int] = {}
        into, base = [], []
        for window, fill in zip(pdf["window"], pdf["fill"], strict=True):
            new, offset, _ = windows.place(int(fill))
            into.append(names.setdefault(new, int(window)))
            base.append(offset)
        open_ = {names[w] for _, w in windows.free[-open_windows:]}
        pdf = pdf.assign(into=into, base=base)
        pdf["still"] = pdf["into"].isin(open_)
        return pdf[["window", "into", "base", "fill", "grp", "still"]]

    return run


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    open_windows: int = OPEN,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenise documents(doc_id, text), append end_id to each and pack them into windows of `capacity` ids.

    A document is cut every `capacity` ids. Full pieces are windows of their own; the rest of a document
    goes, within its partition, into the open window where it fits best. `open_windows` windows are open
    at a time; where none fits, the fullest is emitted and a new one opened. What is open when a partition
    ends is merged in a tree: groups of 64 partitions pack their leftovers best-fit decreasing, close all
    but the emptiest `open_windows`, and pass these on, so no task sees more than 64 x `open_windows`
    windows. Windows that stay short are to be padded to `capacity`.

    Returns per piece doc_id, start, length, ids_crc32 (unsigned, little-endian 32-bit ids), doc_tokens,
    sequence_id and offset (in the sequence, gapless from 0), and with keep_ids the ids themselves. Null
    and empty texts are the end id alone. Repeated rows are packed each. Other columns are not read. An
    empty table gives an empty table. The first pass is written to the shared folder, so that a lost
    executor can't give a piece a second place.
    """
    key = T.StructField("doc_id", df.schema["doc_id"].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "window", "offset")]
    schema = T.StructType([key, *longs, T.StructField("open", T.BooleanType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _pack_partition(tokenizer, capacity, open_windows, end_id, keep_ids, to_arrow_schema(schema))
    placed = materialise(df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    pieces = placed.where(~F.col("open"))
    left = placed.where("open")

    windows = left.groupBy("window").agg(F.sum("length").alias("fill"))
    level = windows.select("window", "fill", F.shiftright("window", 32).alias("grp"))
    moved = None
    while True:
        level = level.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        packed = materialise(
            level.groupBy("grp").applyInPandas(
                _merge_group(capacity, open_windows),
                "window long, into long, base long, fill long, grp long, still boolean",
            )
        )
        step = packed.select("window", "into", "base")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("window").alias("into"), F.col("into").alias("into2"), F.col("base").alias("base2"))
            moved = materialise(
                moved.join(later, "into", "left").select(
                    "window",
                    F.coalesce("into2", "into").alias("into"),
                    (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"),
                )
            )
        top = packed.agg(F.max("grp")).first()[0]
        if not top:
            break
        level = packed.where("still").groupBy(F.col("into").alias("window")).agg(
            F.sum("fill").alias("fill"), F.first("grp").alias("grp")
        )
    merged = left.join(moved, "window").select(
        *[c for c in placed.columns if c not in ("window", "offset", "open")],
        F.col("into").alias("sequence_id"),
        (F.col("base") + F.col("offset")).alias("offset"),
    )
    rest = pieces.withColumnRenamed("window", "sequence_id").drop("open")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return rest.select(names).unionByName(merged.select(names))
