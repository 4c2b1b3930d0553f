"""Fuzzy line deduplication by MinHash, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_key, materialise, thinned
from .graph import components
from .spans import bind

# A shingle: 12 characters from each word's start on, and within a longer word from every character after its twelfth, so
# that a character more or less near the start of a line without spaces shifts none of the later ones.
SHINGLE = r"(?s)\x20?(?=([^\x20].{0,11}+))(?:(?<![^\x20])[^\x20]{1,12}+|[^\x20])"
# Of a line under min_chars: 4 characters from every character on.
SHORT_SHINGLE, SHORT_WIDTH = r"(?s)(?=(.{4})).", 4
#: Each band is the two least hashes from one of so many evenly spaced bounds on, going round at the end.
BANDS = 6
BOUNDS = tuple(i * (1 << 64) // BANDS - (1 << 63) for i in range(BANDS))
#: Longs of a sketch that rules pairs out before they are compared.
SKETCH = 4
#: Buckets up to this size are compared pair by pair; members of larger ones by prefixes, in blocks of so many.
SMALL, BLOCK = 24, 600


def shingles(line: Column, min_chars: int = 0) -> Column:
    """Hashes of a line's shingles; of a line under `min_chars` code points those of its short ones, or the whole of it."""
    cut = F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1))
    if min_chars > 0:
        short = F.when(F.length(line) < SHORT_WIDTH, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(SHORT_SHINGLE), F.lit(1)))
        cut = F.when(F.length(line) < min_chars, short).otherwise(cut)
    return F.array_distinct(F.transform(cut, lambda s: F.xxhash64(s)))


def with_bands(df: DataFrame, min_chars: int = 0) -> DataFrame:
    """df without `line`, with `size` (of its set of shingles) and the keys b0, b1, ...

    One-permutation MinHash: the set's hashes are sorted once; band i holds the two least from bound i on. Two sets
    share a band with a chance of about the square of their similarity. The bounds are sorted in with the hashes, so that a bound's place tells
    how many hashes are before it.
    """
    names = [c for c in df.columns if c != "line"]
    step = df.select(*names, F.sort_array(shingles(F.col("line"), min_chars)).alias("z"))
    step = step.select(*names, "z", F.sort_array(F.concat("z", F.array(*[F.lit(b) for b in BOUNDS]))).alias("m"), F.size("z").alias("size"))
    at = lambda i, k: F.get("z", F.pmod(F.array_position("m", F.lit(BOUNDS[i])) - 1 - i + k, F.col("size")).cast("int"))
    return step.select(*names, "size", *[F.xxhash64(at(i, 0), at(i, 1)).alias(f"b{i}") for i in range(BANDS)])


def _occurrences(docs: DataFrame, min_chars: int, short: bool) -> DataFrame:
    """(d, pos, h, g, line): eligible lines. d is the document's hash, (h, g) the line's."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.select(doc_key(docs).alias("d"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    out = out.where(F.col("line").rlike(r"\S") if short else F.length("line") >= min_chars)
    return out.select("d", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"), "line")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) whose exact Jaccard similarity reaches the threshold; other columns of pairs stay."""
    left = sets.select(F.col("h").alias("x"), F.col("sh").alias("sx"))
    right = sets.select(F.col("h").alias("y"), F.col("sh").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    met = pairs.join(left, "x").join(right, "y").select(*pairs.columns, both.alias("both"), (F.size("sx") + F.size("sy")).alias("all"))
    return met.where(F.col("both") >= F.lit(threshold) * (F.col("all") - F.col("both"))).select(pairs.columns)


def _near(p: Column, q: Column, threshold: float) -> Column:
    """Sizes that leave room for the threshold."""
    return F.least(p, q) >= F.lit(threshold) * F.greatest(p, q) - 1e-6


def _apart(rooted: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y, a, b) of members of different roots in the buckets of at most SMALL members; each bucket's least member
    has met all others already."""
    row = F.struct("h", "root", "size")
    m = rooted.groupBy("band").agg(F.slice(F.sort_array(F.collect_list(row)), 2, SMALL).alias("m"))
    x = m.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
    x = x.where((F.col("x.root") != F.col("y.root")) & _near(F.col("x.size"), F.col("y.size"), threshold))
    return x.select(F.col("x.h").alias("x"), F.col("y.h").alias("y"), F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()


def _parities(sh: Column) -> list[Column]:
    """SKETCH longs: each element flips one of their bits. What differs between two sketches is at most what differs between the sets."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(63).cast("int"))
    part = lambda v: F.shiftrightunsigned(v, 6).bitwiseAND(SKETCH - 1)

    def one(k: int) -> Column:
        return F.aggregate(sh, F.lit(0).cast("long"), lambda acc, v: F.when(part(v) == k, acc.bitwiseXOR(bit(v))).otherwise(acc))

    return [one(k) for k in range(SKETCH)]


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, t): of each set (h, sh) the rarest |x| - ceil(threshold |x|) + 1 shingles, in one order of all shingles: sets alike at `threshold` share one of these."""
    token = sets.select("h", F.explode("sh").alias("t"))
    rank = token.groupBy("t").agg(F.count("*").alias("f"))
    ranked = token.join(rank, "t").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("r"))
    n = F.size("r")
    # less a little: a product that is whole must not round up
    prefix = F.slice("r", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-6).cast("int") + 1)
    return ranked.select("h", F.explode(F.transform(prefix, lambda x: x["t"])).alias("t"))


def _across(prefixes: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float, s: Scratch) -> DataFrame:
    """Links (a, b) between components: of the pairs of sets (h, sh, sketch) of different roots that are alike, one at least for each set that has one.

    No link is found only if there is none, so called again with the wider components it ends with all of them; each call leaves half of the linked
    components at most, and of a dense group one.
    Exact, by prefixes (h, t). Of the members that share such a shingle those outside its largest component meet all others: the
    pairs grow with the product of the two, not with the square of a group that is one component already. Both sides are dealt to blocks by hash, a row
    for each pair of blocks. Sketches of parities rule most pairs out: sets that are alike differ in (1 - threshold) / (1 + threshold) of their sizes' sum at most.
    """
    root = F.coalesce("root", "h").alias("root")
    keyed = s(prefixes.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "t", root))
    by_root = keyed.groupBy("t", "root").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "root")).alias("major"), F.sum("c").alias("n"), F.count("*").alias("roots"))
    mixed = by_root.where("roots > 1").select("t", F.col("major.root").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("major.c")) / BLOCK).cast("int").alias("parts"))
    met = s(keyed.join(mixed, "t"))
    mine = lambda n: F.pmod(F.xxhash64("h", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # those outside the token's largest component ask, all members answer
    asks = met.where(F.col("root") != F.col("major")).select("t", "h", mine("parts").alias("part"), every("blocks").alias("block"), "root", F.lit(True).alias("asks"))
    answers = met.select("t", "h", every("parts").alias("part"), mine("blocks").alias("block"), "root", F.lit(False).alias("asks"))
    # what differs at most, of the set and of the largest one that may be like it: told by size alone, so that one part of the sketches rules most pairs out at once
    apart = (1 - threshold) / (1 + threshold)
    room = F.floor(F.lit(apart) * (F.size("sh") + F.size("sh") / threshold) + 1e-3).cast("int").alias("room")
    row = F.struct("root", "sh", F.size("sh").alias("n"), room, *[f"q{k}" for k in range(SKETCH)])
    tasks = asks.unionByName(answers).join(sets, "h").groupBy("t", "part", "block").agg(F.collect_list(F.when(F.col("asks"), row)).alias("x"), F.collect_list(F.when(~F.col("asks"), row)).alias("y"))

    def like(x: Column, y: Column) -> Column:
        p, q = x["n"], y["n"]
        part = [F.bit_count(x[f"q{k}"].bitwiseXOR(y[f"q{k}"])) for k in range(SKETCH)]
        near = (part[0] <= x["room"]) & (x["root"] != y["root"]) & _near(p, q, threshold)
        near = near & (sum(part[1:], part[0]) <= F.lit(apart) * (p + q) + 1e-6)
        return near & bind(F.size(F.array_intersect(x["sh"], y["sh"])), lambda both: both >= F.lit(threshold) * (p + q - both))

    def least(x: Column) -> Column:
        # once a link is known, only what has a lesser root is compared
        return F.aggregate("y", F.lit(None).cast("long"), lambda known, y: F.when(known <= y["root"], known).when(like(x, y), y["root"]).otherwise(known))

    # one link an asking member and row, to the least root it is linked to: every component outside a token's largest that has a link keeps one
    links = F.transform("x", lambda x: F.struct(x["root"].alias("a"), least(x).alias("b")))
    found = tasks.select(F.explode(F.filter(links, lambda e: e["b"].isNotNull())).alias("e"))
    return found.select("e.a", "e.b").distinct()


def linked(member: DataFrame, sets: DataFrame, threshold: float, s: Scratch) -> DataFrame:
    """(node, root): components of the lines that share a bucket and are alike, all pairs of a bucket taken into account.

    member (band, h, size, n, lo, lo_size): buckets with their size and least member; sets (h, sh). 1. Every member meets its buckets' least
    member: one pair a member, whatever the bucket's size. 2. Union-find over what is alike joins most of what belongs together. 3. Only
    buckets whose members are still in several components are looked at again, and only pairs across components: pair by pair in
    small buckets, by prefixes in large ones. A pair within one component could change nothing.
    """
    star = member.where((F.col("h") != F.col("lo")) & _near(F.col("size"), F.col("lo_size"), threshold)).select(F.col("lo").alias("x"), F.col("h").alias("y")).distinct()
    edges = s(_verified(star, sets, threshold))
    roots = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), s)
    rooted = member.where("n > 2").join(roots.withColumnRenamed("node", "h"), "h", "left").select("band", "h", "size", "n", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("ra"), F.max("root").alias("rb")).where("ra < rb").select("band")
    rooted = s(rooted.join(mixed, "band"))
    more = s(_verified(_apart(rooted.where(F.col("n") <= SMALL), threshold), sets, threshold).select("a", "b").distinct())
    roots = _wider(roots, more, s)
    large = s(rooted.where(F.col("n") > SMALL).select("h").distinct().join(sets, "h").select("h", "sh", *[c.alias(f"q{k}") for k, c in enumerate(_parities(F.col("sh")))]))
    if large.isEmpty():
        return roots
    prefixes = s(_prefixes(large, threshold))
    while True:
        more = s(_across(prefixes, large, roots, threshold, s))
        if more.isEmpty():
            return roots
        roots = _wider(roots, more, s)


def _wider(roots: DataFrame, links: DataFrame, s: Scratch) -> DataFrame:
    """(node, root) after links (a, b) between roots; a root that had no node is one."""
    if links.isEmpty():
        return roots
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = roots.unionByName(ends.select("node", F.col("node").alias("root"))).distinct()
    wider = components(links, s).select(F.col("node").alias("root"), F.col("root").alias("wide"))
    return s(known.join(wider, "root", "left").select("node", F.coalesce("wide", "root").alias("root")))


def similar_lines(docs: DataFrame, s: Scratch, threshold: float = 0.8, min_chars: int = 40, short: bool = False) -> DataFrame:
    """(h, g, kd, kh, kg): for every line that has an equal or similar one, the document and the line that are kept."""
    occ = _occurrences(docs, min_chars, short)
    cut = min_chars if short else 0
    keys = [f"b{i}" for i in range(BANDS)]
    lines = s(
        with_bands(occ.select("h", "g", "d", "pos", "line"), cut)
        .groupBy("h", "g").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min_by("pos", "d").alias("pos"), F.min("size").alias("size"), *[F.min(b).alias(b) for b in keys])
    )
    keyed = lines.select("h", "size", F.explode(F.array_distinct(F.array(*keys))).alias("band"))
    buckets = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.min_by("size", "h").alias("lo_size")).where("n > 1")
    buckets = s(buckets)
    shared, _ = thinned(keyed, "band", buckets)
    member = s(shared.join(buckets, "band").select("band", "h", "size", "n", "lo", "lo_size"))
    s.drop(buckets)
    # one place of each line: lines of one h but different g are told apart by it too, the lesser g stands for both
    places = lines.groupBy("h").agg(F.min("g").alias("g"), F.min_by("d", "g").alias("d"), F.min_by("pos", "g").alias("pos"))
    wanted = s(member.select("h").distinct().join(places, "h"))
    some, _ = thinned(occ, "h", wanted)
    sets = s(some.join(wanted, ["h", "g", "d", "pos"]).select("h", shingles(F.col("line"), cut).alias("sh")))
    roots = linked(member, sets, threshold, s)
    named = s(lines.select("h", "g", "n", "d").join(roots.withColumnRenamed("node", "h"), "h", "left").where("root IS NOT NULL OR n > 1"))
    first = F.min(F.struct("d", "h", "g")).alias("k")
    groups = named.where("root IS NOT NULL").groupBy("root").agg(first)
    alone = named.where("root IS NULL").select("h", "g", F.col("d").alias("kd"), F.col("h").alias("kh"), F.col("g").alias("kg"))
    return s(named.join(groups, "root").select("h", "g", F.col("k.d").alias("kd"), F.col("k.h").alias("kh"), F.col("k.g").alias("kg")).unionByName(alone))


def _gone(docs: DataFrame, keep: DataFrame, min_chars: int, short: bool) -> DataFrame:
    """(d, gone): by document the positions of lines that go: all but the first place of the kept line in the kept document."""
    places, _ = thinned(_occurrences(docs, min_chars, short).select("d", "pos", "h", "g"), "h", keep)
    own = (F.col("d") == F.col("kd")) & (F.col("h") == F.col("kh")) & (F.col("g") == F.col("kg"))
    met = places.join(keep, ["h", "g"]).select("d", "pos", "h", "g", own.alias("own")).groupBy("d").agg(
        F.collect_list(F.when(~F.col("own"), F.col("pos"))).alias("gone"), F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("h", "g", "pos")))).alias("mine")
    )
    again = F.filter("mine", lambda x, i: (i > 0) & (F.get("mine", i - 1)["h"] == x["h"]) & (F.get("mine", i - 1)["g"] == x["g"]) & (F.get("mine", i - 1)["pos"] != x["pos"]))
    both = F.array_distinct(F.concat("gone", F.transform(again, lambda x: x["pos"])))
    return met.select("d", both.alias("gone")).where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, threshold: float = 0.8, min_chars: int = 40, short: bool = False) -> DataFrame:
    """Keep one line of each group of equal or similar lines, over the whole corpus.

    Lines (split at \\n) of `min_chars` code points or more take part. With `short` so does every other line with a word, by
    shingles of 4 characters (lines under and over `min_chars` are not alike then); without it shorter ones stay as they are.
    1. Equal lines are counted under a 128-bit key. 2. A distinct line's set of character shingles gives six bands of two MinHash
    values. 3. Candidates of a bucket are verified by exact Jaccard similarity: first each with its bucket's least member, then, where a bucket still has several
    components, all pairs across these. 4. Union-find over the links; of each component the line in the document of least hash (of several there the one of
    least hash), at its first place, is kept and all others go.

    Returns the columns of docs with `text` without the removed lines, and n_lines and n_dropped (columns of
    these names in docs are replaced; any other name may occur). One row for each input row. Null text stays null with n_lines 0, an empty
    one has one line, without a word, that stays. Of rows that repeat another one wholly (doc_id and text) one keeps its lines and the others lose all that take part. A null
    doc_id is an id like any other. Lines of any length are read whole. An empty table gives an empty table. Texts of documents that
    lose no line are not shuffled as long as a filter of fixed size can tell them.
    """
    d = doc_key(docs)
    with Scratch(docs.sparkSession) as s:
        gone = materialise(_gone(docs, similar_lines(docs, s, threshold, min_chars, short), min_chars, short))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row travels as one struct: no column of it can clash with one of ours
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), d.alias("d"))
    twice = materialise(rows.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"))
    split = F.split(F.col("row.text"), "\n")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).cast("long")
    takes = lambda x: x.rlike(r"\S") if short else F.length(x) >= min_chars

    def out(df: DataFrame, lost: Column | None) -> DataFrame:
        if lost is None:
            return df.select("row.*", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
        left = bind(split, lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i)), "\n"))
        text = F.when(F.coalesce(F.size(lost), F.lit(0)) > 0, left).otherwise(F.col("row.text")).alias("text")
        return df.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in names], n_lines.alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"))

    single, copies = rows, None
    if not twice.isEmpty():
        some, rest = thinned(rows, "d", twice)
        single = rest.unionByName(some.join(twice, "d", "left_anti").select("row", "d"))
        copies = materialise(some.join(twice, "d", "left_semi").select("row", "d", F.monotonically_increasing_id().alias("id")))
    hit, clean = thinned(single, "d", gone)
    result = out(hit.join(gone, "d", "left"), F.coalesce("gone", F.array().cast("array<int>"))).unionByName(out(clean, None))
    if copies is not None:
        first = copies.groupBy("d").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
        every = F.filter(F.transform(split, lambda x, i: F.when(takes(x), i)), lambda i: i.isNotNull())
        lost = F.when(F.coalesce("first", F.lit(False)), F.coalesce("gone", F.array().cast("array<int>"))).otherwise(F.coalesce(every, F.array().cast("array<int>")))
        result = result.unionByName(out(copies.join(first, ["d", "id"], "left").join(gone, "d", "left"), lost))
    return result
