"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, materialise, thinned

NUMBER = re.compile(r"^[$€£]?[+-]?\d[\d,.:/]*(?:st|nd|rd|th)?%?$")
MIXED = re.compile(r"^[$€£]?[+-]?\d[\d,.]*([a-zµ°%]{1,4})$")
HEAD, TAIL = re.compile(r"[^\w$€£+-]+"), re.compile(r"[^\w%]+")
STOP = re.compile(r"[.!?…:][\"')\]]*$")
# Units that stand after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd mi mile miles mg g kg lb lbs oz ton tons t ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz "
    "w kw mw v kv a ma j kj kcal cal pa kpa bar psi k c f kb mb gb tb dollar dollars euro euros cent cents usd eur percent "
    "degree degrees kmh mph km/h m/s".split()
)
#: Bits of the filter that documents' windows pass before the join; fixed size, whatever the benchmark's.
FILTER_BITS = 24


def _bare(word: str) -> str:
    """word without outer punctuation. Its end is read backwards: a pattern that ends in $ would be tried from every mark within."""
    tail = TAIL.match(word[::-1])
    word = word[: len(word) - tail.end()] if tail else word
    head = HEAD.match(word)
    return word[head.end() :] if head else word


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Flags of a word, in the last bits of its hash: a number, a unit, a capitalised word, one that ends a sentence, no word at all.
IS_NUM, IS_UNIT, IS_NAME, IS_STOP, IS_NONE, FLAGS = 1, 2, 4, 8, 16, 31
#: Marks that end most words; those that end a sentence.
ENDS, STOPS = ".,;:!?", ".:!?"
#: Words that a worker remembers.
MEMO = 100_000


class _Canon(dict):
    """Words to the hash of what they are in lower case without outer punctuation, with their flags in the last bits.

    What a word becomes depends on itself and on the flags of the word before it alone, so a text is canonicalised in a few array operations.
    """

    def __missing__(self, word: str) -> int:
        flags, bare = 0, word
        if not word.isalpha():
            if word[-1] in ENDS and word[:-1].isalpha():
                flags, bare = IS_STOP * (word[-1] in STOPS), word[:-1]
            else:  # whatever is not letters with one mark after them
                bare = _bare(word)
                low = bare.lower()
                flags = IS_STOP * bool(STOP.search(word)) | IS_NONE * (not low) | IS_NUM * bool(NUMBER.match(low) or MIXED.match(low))
        low = bare.lower()
        if low in UNITS:
            flags |= IS_UNIT
        if low != bare and bare[0].isupper() and len(bare) > 1 and not bare.isupper():
            flags |= IS_NAME
        got = self[word] = xxhash.xxh64_intdigest(low) & ~FLAGS | flags
        return got

    def __call__(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, token hashes, slot kinds); words that are all punctuation are left out."""
        words = text.split()
        if len(self) > MEMO:
            self.clear()
        got = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        flag = (got & np.uint64(FLAGS)).astype(np.uint8)
        before = np.concatenate([np.array([IS_STOP], np.uint8), flag[:-1]])
        number = flag & IS_NUM > 0
        unit = ~number & (before & IS_NUM > 0) & (flag & IS_UNIT > 0)
        name = ~number & ~unit & (before & IS_STOP == 0) & (flag & IS_NAME > 0)
        kinds = number.astype(np.int8) + np.int8(2) * name + np.int8(3) * unit
        hashes = np.where(kinds > 0, kinds.astype(np.uint64), got & np.uint64(~FLAGS & 0xFFFFFFFFFFFFFFFF))
        real = flag & IS_NONE == 0
        if not real.all():
            words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
        return words, hashes[real], kinds[real]


_CANON = _Canon()  # kept by the Python worker


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` tokens."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h + hashes[k : k + n]) * np.uint64(0x100000001B3) + np.uint64(k + 1)
        return _mix(h)


def _window_rows(key: str, kind: str, width: int, least_literal: int, bits: np.ndarray | None, shorter: tuple[int, ...] = ()):
    """Rows (key, h, pos, width, slots) of the windows with enough literal words, and that pass the filter if there is one.

    With a filter, windows of `shorter` widths are made too; without one, a text of fewer than `width` tokens is one window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {key: [], "h": [], "pos": [], "width": [], "slots": []}
            for doc, text in zip(pdf[key], pdf["text"], strict=True):
                if not isinstance(text, str):
                    continue
                words, hashes, kinds = _CANON(text)
                slots = np.concatenate([[0], np.cumsum(kinds > 0)])
                for w in (width, *shorter) if bits is not None else (min(width, len(words)),):
                    h = _windows(hashes, w)
                    if not w or not len(h):
                        continue
                    ok = w - (slots[w:] - slots[:-w]) >= least_literal
                    if bits is not None:
                        at = h >> np.uint64(64 - FILTER_BITS)
                        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    for i in np.flatnonzero(ok).tolist():
                        out[key].append(doc)
                        out["h"].append(int(h[i].astype(np.int64)))
                        out["pos"].append(i)
                        out["width"].append(w)
                        out["slots"].append([_bare(words[i + j]).lower() for j in np.flatnonzero(kinds[i : i + w]).tolist()])
            if out["h"]:
                yield pd.DataFrame(out)

    return run, f"{key} {kind}, h long, pos long, width int, slots array<string>"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    least_literal: int = 4,
    least_share: float = 0.3,
    least_windows: int = 3,
    long_run: int = 13,
) -> DataFrame:
    """Pairs of documents and benchmark items whose template the document contains.

    Words are reduced to templates: numbers, units after a number and capitalised words within a sentence
    become typed placeholders, everything else is lower-cased without outer punctuation. Windows of `width`
    template tokens with `least_literal` literal words at least are hash-joined. Joined windows of a pair are put
    into runs: of one alignment (document position minus item position), without a gap of more than `width`. The values in the slots
    must map consistently within a run: an item's slot value stands for one value of the document, so the same
    question with other parameters counts and unrelated text that shares a skeleton does not. Runs that don't are left out; they take
    nothing from others. A pair is a leak if its runs cover at least `least_share` of the item's windows (and `least_windows` of them, or all if it has fewer), or if one run is
    `long_run` tokens long, whatever the share. An item of fewer than `width` tokens is one window, itself; one with fewer than `least_literal` literal words has none.

    Returns doc_id, item_id, n_windows, share, reworded (the runs with equal slot values are no leak alone). Null or empty texts and null ids match
    nothing; repeated rows give one pair; other columns are not read, whatever their names. Texts are read whole. An empty table of either kind gives no pair. The documents are scanned once; only
    windows that pass a filter of fixed size (2 MB of bits of the benchmark's hashes) are shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    run, schema = _window_rows("item_id", kind, width, least_literal, None)
    wanted = materialise(items.mapInPandas(run, schema).dropDuplicates(["item_id", "h", "pos"]))
    sizes = wanted.groupBy("item_id").agg(F.count_distinct("h").alias("item_windows"))
    # the filter: set bits gathered byte by byte in Spark, at most 2^(FILTER_BITS - 3) bytes whatever the benchmark's size
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    got = wanted.groupBy(F.shiftright(bit, 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))).alias("v")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[got["byte"].to_numpy(np.int64)] = got["v"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    shorter = tuple(sorted(r[0] for r in wanted.where(F.col("width") < width).select("width").distinct().collect()))

    def scan(batches):
        return _window_rows("doc_id", kind_d, width, least_literal, shared.value, shorter)[0](batches)

    kind_d = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    seen = texts.mapInPandas(scan, f"doc_id {kind_d}, h long, pos long, width int, slots array<string>")
    hits = seen.withColumnRenamed("slots", "got").join(wanted.select("item_id", "h", "width", F.col("pos").alias("item_pos"), "slots"), ["h", "width"])
    pairs = F.zip_with("slots", "got", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = hits.select("doc_id", "item_id", "h", "width", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    along = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos")
    hits = hits.withColumn("gap", F.coalesce((F.col("item_pos") - F.lag("item_pos").over(along) > width).cast("int"), F.lit(0)))
    runs = hits.withColumn("run", F.sum("gap").over(along)).groupBy("doc_id", "item_id", "shift", "run").agg(
        F.collect_set("h").alias("hs"),
        (F.max("item_pos") - F.min("item_pos") + F.max("width")).alias("length"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("map"),
    )
    exact = F.forall("map", lambda x: x["a"] == x["b"])
    consistent = F.size("map") == F.size(F.array_distinct(F.transform("map", lambda x: x["a"])))
    runs = runs.withColumn("exact", exact).where(F.col("exact") | consistent)
    windows = lambda hs: F.size(F.array_distinct(F.flatten(F.collect_list(hs))))
    found = runs.groupBy("doc_id", "item_id").agg(
        windows(F.col("hs")).alias("n_windows"), windows(F.when(F.col("exact"), F.col("hs"))).alias("n_exact"),
        F.max("length").alias("length"), F.max(F.when(F.col("exact"), F.col("length"))).alias("length_exact"),
    )
    share = lambda n: F.col(n) / F.col("item_windows")
    least = F.least(F.lit(least_windows), F.col("item_windows"))
    leak = lambda n, length: ((share(n) >= least_share) & (F.col(n) >= least)) | (F.coalesce(length, F.lit(0)) >= long_run)
    return (
        found.join(sizes, "item_id").where(leak("n_windows", F.col("length")))
        .select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), share("n_windows").alias("share"), (~leak("n_exact", F.col("length_exact"))).alias("reworded"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs, with all its columns, without the documents that contain a benchmark item.

    A document is told by its id and text, so a null doc_id is no shelter and rows that repeat a leak go with it. Null and empty texts stay. Column names may clash with ours.
    """
    leaks = materialise(find_leaks(docs.select(doc_key(docs).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("d")).distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_key(docs).alias("d"))
    some, rest = thinned(rows, "d", leaks)
    return rest.select("row.*").unionByName(some.join(leaks, "d", "left_anti").select("row.*"))
