import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuegrid.llm import decontamination, jaccard, lines, packing, pii, quality, secrets, sharding, substrings, toxicity
from cuegrid.llm.common import Scratch
from cuegrid.llm.suffixes import kasai, suffix_order

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_sharding_moves_only_into_the_new_shard(spark, docs):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(docs.select("doc_id", "text"))
    a = sharding.shard_documents(many, 5).collect()
    assert all(r.grown_shard in (r.shard, 5) for r in a) and len(a) == 3008
    for s in range(5):
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sum(r.shard == s for r in a)))
    b = {r.doc_id: r.shard for r in sharding.shard_documents(many, 6).collect()}
    assert all(b[r.doc_id] == r.grown_shard for r in a)
    assert {r.text_crc32 for r in a if r.doc_id == 2999} == {zlib.crc32(b"x")}


def test_packing_round_trip(spark, docs):
    got = packing.pack_documents(docs, PATH, 64, open_windows=2, keep_ids=True).collect()
    model = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id or -1, tuple([*model.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0) and r.offset + r.length <= 64
        by[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert sum(by.values()) == sum(len(w) for _, w in want)
    ids = {}
    for r in got:
        if r.doc_id == 6:
            ids[r.start] = r.ids
    assert tuple(x for s in sorted(ids) for x in ids[s]) == next(w for d, w in want if d == 6)


def test_suffixes_against_sorting():
    rng = random.Random(1)
    seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    flat = np.array([x for s in seqs for x in s], np.int64)
    lens = np.array([len(s) for s in seqs])
    stops = np.cumsum(lens)
    order, _ = suffix_order(flat, np.repeat(stops, lens), 64)
    end = np.repeat(stops, lens)
    tails = [tuple(flat[i : end[i]]) for i in order]
    assert tails == sorted(tails)
    common = kasai(flat, stops - lens, stops, lens, order, 99)
    for k in range(1, len(order)):
        a, b = tails[k - 1], tails[k]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repetition_rules_against_windows(spark):
    rng = random.Random(2)
    vocab = words(rng, 6).split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) + ("\nsame line\nsame line" if i % 3 == 0 else "") for i in range(40)] + [None, ""]
    texts[1] = "## a b\nx | y\n## a b\n\n## a b " + (texts[1] or "")
    got = {r.doc_id: r for r in quality.repetition_rules(spark.createDataFrame(list(enumerate(texts)), DOC), max_longest=12).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {x for at in seen.values() if len(at) > 1 for k in at for x in range(k, k + 5)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        longest = max([k for a in range(len(w)) for b in range(a + 1, len(w)) for k in range(5, 14) if b + k <= len(w) and w[a : a + k] == w[b : b + k]], default=0)
        lines_ = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i].longest_repeat, got[i].n_symbols, got[i].n_dup_lines) == (longest, len(re.findall(r"[#*$%&|<>]", t or "")), len(lines_) - len(set(lines_)))
        assert got[i].kept == (not got[i].base_failed and longest <= 12)


def test_longest_repeat_of_three_unequal_copies():
    rng = random.Random(15)
    fill = lambda n: [f"f{rng.getrandbits(40)}".encode() for _ in range(n)]
    passage = fill(450)
    changed = passage[:232] + [b"other"] + passage[233:]
    short = fill(120)
    docs = [passage + fill(3000) + changed + fill(3000) + passage + fill(4000), short + fill(50) + short[:40] + fill(50) + short[:90] + fill(20)]

    def brute(w):
        best, row = 0, [0] * (len(w) + 1)
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for x in range(len(w) - 1, -1, -1):  # common prefixes of x and each later place of its word
            new = {y: row[y + 1] + 1 for y in at[w[x]] if y > x}
            row = [0] * (len(w) + 1)
            for y, n in new.items():
                row[y] = n
                best = max(best, n)
        return best

    for most in (401, 60):
        assert quality.repeats(docs, 5, most)[1].tolist() == [min(brute(w), most) for w in docs]
    assert brute(docs[0]) == 450 and brute(docs[1]) == 90


@pytest.mark.parametrize("hot", [3000, 2])
def test_substrings_against_all_windows(spark, hot):
    rng = random.Random(3)
    parts = [words(rng, 120) for _ in range(4)]
    texts = [words(rng, rng.randint(0, 200)) + parts[i % 4] + words(rng, 20) for i in range(16)] + [parts[0], parts[0], "ab" * 600, None, "", "é" * 300]
    n, size = 400, {}
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for k in range(len(r) - n + 1):
            size[r[k : k + n]] = size.get(r[k : k + n], 0) + 1
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOC), n, hot=hot, shard_bytes=4000).collect()}
    for i, r in enumerate(raws):
        gone = {x for k in range(len(r) - n + 1) if size[r[k : k + n]] > 1 for x in range(k, k + n)}
        assert got[i].n_removed == len(gone)
        assert got[i].kept_sha256 == hashlib.sha256(bytes(b for k, b in enumerate(r) if k not in gone)).hexdigest()


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(4)
    base = words(rng, 150).split()
    texts = [words(rng, 80) for _ in range(30)]
    for i in range(150):  # one dense group, beyond the bucket size
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[0], None, "", "two words", "two words"]
    key = [t or "" for t in texts]
    sets = {t: ({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set()) for t in key}
    links = {t: 0 for t in sets}
    for a, b in combinations(sets, 2):
        x = len(sets[a] & sets[b])
        if x and x >= 0.8 * (len(sets[a]) + len(sets[b]) - x):
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r for r in jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert [got[i].n_links for i in range(len(key))] == [links[t] for t in key]
    assert got[180].class_id == 0 and got[180].n_copies == 1 and got[183].class_id == got[184].class_id == 183


def test_lines_keep_one_of_each_group(spark):
    rng = random.Random(5)
    line = words(rng, 40)
    near = line.split()
    near[20] = "changed"
    other = [words(rng, 30) for _ in range(12)]
    texts = [f"{other[i]}\n{line if i % 2 else ' '.join(near)}\nshort" for i in range(12)] + [None, "", "short"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], DOC + ", n_lines int")
    got = lines.dedup_lines(df)
    rows = got.collect()
    assert set(got.columns) == {"doc_id", "text", "n_lines", "n_dropped"} and len(rows) == 15
    left = [x for r in rows for x in (r.text or "").split("\n")]
    assert sum(x in (line, " ".join(near)) for x in left) == 1 and all(left.count(o) == 1 for o in other) and left.count("short") == 13


def test_line_bands_are_different_keys(spark):
    line = words(random.Random(7), 60)
    got = lines.with_bands(spark.createDataFrame([(line,)], "line string")).first()
    assert len({got[f"b{i}"] for i in range(lines.BANDS)}) == lines.BANDS == 6 and got.size > 50


def joined(sets, like):
    """The least index of each set's component."""
    up = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if up[a] != up[b] and like(sets[a], sets[b]):
            lo, hi = sorted((up[a], up[b]))
            up = [lo if x == hi else x for x in up]
    return up


def alike(x, y):
    both = len(x & y)
    return both >= 0.8 * (len(x) + len(y) - both)


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    every = []
    for i in range(60):
        w = words(rng, rng.randint(15, 60)).split()
        every.append(" ".join(w))
        for _ in range(i % 3):  # edits that leave some pairs above and some below the threshold
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            every.append(" ".join(w))
    shingle = re.compile(lines.SHINGLE)
    up = joined([set(shingle.findall(x)) for x in every], alike)
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(every)), DOC))
    assert got.agg(F.sum("n_dropped")).first()[0] == len(every) - len(set(up)) > 5


def test_lines_of_large_buckets_against_all_pairs(spark):
    """A star of 200 variants, each like the original only, and a chain of 60, all in one bucket; and in buckets of 20."""
    rng = random.Random(12)
    base = [rng.getrandbits(62) for _ in range(130)]
    star = [base] + [[x if x not in gone else rng.getrandbits(62) for x in base] for gone in (set(rng.sample(base, 14)) for _ in range(200))]
    chain = [[rng.getrandbits(62) for _ in range(100)]]
    while len(chain) < 60:
        chain.append(chain[-1][10:] + [rng.getrandbits(62) for _ in range(10)])
    sets = [set(x) for x in star + chain]
    assert not any(alike(a, b) for a, b in combinations(sets[1:40], 2)) and all(alike(sets[0], x) for x in sets[:201])
    up = joined(sets, alike)
    assert len(set(up)) == 2
    table = spark.createDataFrame([(1000 - i, list(s)) for i, s in enumerate(sets)], "h long, sh array<long>")
    every = [(1, i) for i in range(len(sets))]
    some = [(10 + i // 19, j) for i in range(1, 201, 19) for j in [0, *range(i, min(201, i + 19))]] + [(100 + i // 10, j) for i in range(201, 261, 9) for j in range(i, min(261, i + 10))]
    for place in (every, some):
        members = spark.createDataFrame([(b, 1000 - i, len(sets[i])) for b, i in place], "band long, h long, size int")
        buckets = members.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.min_by("size", "h").alias("lo_size"))
        with Scratch(spark) as s:
            roots = {r.node: r.root for r in lines.linked(members.join(buckets, "band"), table, 0.8, s).collect()}
        assert len(roots) == len(sets) and len(set(roots.values())) == 2 and len({roots[1000 - i] for i in range(201)}) == 1


def test_edits_of_one_line_against_all_pairs(spark):
    rng = random.Random(21)
    base = words(rng, 45).split()
    every = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        every.append(" ".join(w))
    shingle = re.compile(lines.SHINGLE)
    sets = [set(shingle.findall(x)) for x in every]
    left = len(set(joined(sets, alike)))
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(every)), DOC), short=True)
    assert got.agg(F.sum("n_dropped")).first()[0] == 300 - left > 50


def test_repeated_rows_and_lines_keep_one_line(spark):
    line = words(random.Random(22), 30)
    rows = [(1, f"{line}\n{line}\nown line of the first", "x")] * 3 + [(2, line, None), (None, line, "y"), (None, None, None), (3, "", "z")]
    df = spark.createDataFrame(rows, DOC + ", d string").withColumns({"row": F.lit(1), "gone": F.lit(2), "h": F.lit(3)})
    got = lines.dedup_lines(df, short=True).collect()
    left = [x for r in got for x in (r.text or "").split("\n")]
    assert len(got) == 7 and left.count(line) == 1 and left.count("own line of the first") == 1
    assert sorted(r.n_lines for r in got) == [0, 1, 1, 1, 3, 3, 3] and {r.d for r in got} == {"x", "y", "z", None} and {(r.row, r.gone, r.h) for r in got} == {(1, 2, 3)}


def test_short_lines_and_lines_without_spaces(spark):
    rng = random.Random(13)
    solid = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(300))
    a, b = "share this page with your friends", "share this page with your friends!"
    texts = [f"{a}\n{solid}", f"{b}\n{solid[:3]}x{solid[3:]}", f"{a}\nok\n\n ", "ok\n\nanother short line here"]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = [x for r in lines.dedup_lines(df, short=True).collect() for x in r.text.split("\n")]
    assert sum(x in (a, b) for x in got) == 1 and got.count("ok") == 1 and sum(len(x) > 200 for x in got) == 1
    assert "another short line here" in got and got.count(" ") == 1 and got.count("") >= 2
    assert lines.dedup_lines(df).agg(F.sum("n_dropped")).first()[0] == 1  # the line without spaces


def test_decontamination_finds_other_parameters(spark):
    item = "A train leaves the old station at 40 km and reaches the small harbour after 12 minutes with 7 people aboard"
    docs = [(0, "before it " + item), (1, item.replace("40", "55").replace("12", "31")), (2, "a train leaves the old house"), (3, None), (4, item.replace("40", "12")), (None, item), (6, ""), (0, "before it " + item), (7, "so where does Ann live with 3 cats they asked")]
    bench = spark.createDataFrame([(9, item), (10, None), (11, "Where does Bob live with 12 cats"), (12, "yes 12"), (None, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, DOC).withColumns({"h": F.lit(1), "row": F.lit(2), "item_id": F.lit(3)})
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(df, bench).collect()}
    assert set(got) == {(0, 9), (1, 9), (4, 9), (7, 11)} and got[1, 9].reworded and got[4, 9].reworded and not got[0, 9].reworded and got[7, 11].share == 1
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, docs[2][1]), (3, None), (6, "")]


def test_decontamination_by_runs(spark):
    item = "A train leaves the old station at 40 km and reaches the small harbour after 12 minutes with 7 people aboard"
    rng = random.Random(14)
    far = " ".join(words(rng, 30).split())
    other = item.replace("40", "55").replace("12", "31")
    long = " ".join(f"{w}{i}x" for i, w in enumerate(words(rng, 200).split()))
    docs = [
        (0, f"{item} {far} {other}"),  # verbatim, and elsewhere with other numbers
        (1, item.replace("40", "12")), (2, item.replace("40", "4").replace("12", "4")),  # two values that become one
        (3, f"{far} {' '.join(long.split()[50:65])} {far}"), (4, f"{far} {' '.join(long.split()[50:61])} {far}"),
        (5, f"{far} a train leaves the old house"),
    ]
    bench = spark.createDataFrame([(9, item), (10, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(spark.createDataFrame(docs, DOC), bench).collect()}
    assert set(got) == {(0, 9), (1, 9), (2, 9), (3, 10)}
    assert not got[0, 9].reworded and got[0, 9].share == 1 and got[1, 9].reworded and got[2, 9].reworded and got[3, 10].share < 0.3


def test_pii_and_secrets_on_edges(spark, docs):
    got = [r for r in pii.find_pii(docs, pii.fit_pii(docs)).collect() if r.doc_id == 4]
    assert len(got) == 2 and (got[0].n_email, got[0].n_ip, got[0].n_phone) == (1, 1, 1)
    spans = "email:9:18,phone:22:39,ip:45:55"
    assert got[0].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    s = [r for r in secrets.scan_secrets(docs, owner="shard").collect() if r.doc_id is None][0]
    assert (s.n_assign, s.n_access, s.n_hex, s.spans) == (1, 1, 0, "assign:0:16,access:17:37")


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """The base rule in plain Python: spans by start, then kind."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = (lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(zip((EMAIL, IP, CARD, PHONE), good)) for m in re.finditer(p, text) if ok(m))


def said(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(31)
    parts = ["a.b@c.org", "x@y", "@", "é", "😀", "10.0.0.255", "1.2.3.4.5.6", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+12", "+", "-", " ", "\n", "00012", ".", "9.9", "()"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), DOC), pii.PiiModel(-9.0, [], (float("inf"),) * 4)).collect()}
    for i, t in enumerate(texts):
        want = personal(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4))
        assert got[i].spans == said(want, pii.KINDS) and got[i].base_sha256 == hashlib.sha256(said(want, pii.KINDS).encode()).hexdigest()


def test_runs_of_a_million_characters(spark):
    long = ["1" * 1_000_000, "1 " * 500_000, "a." * 300_000, "a@" + "b." * 300_000 + "c", "+" * 300_000, "f" * 1_000_000, "aB1" * 300_000, "AKIA" * 200_000, "secret=" * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), DOC)
    assert pii.find_pii(df, pii.PiiModel(-9.0, [], (0.0,) * 4)).select("doc_id", "n_email").count() == 9
    assert {r.doc_id: r.n_email for r in pii.find_pii(df, pii.PiiModel(-9.0, [], (float("inf"),) * 4)).collect()}[3] == 1
    found = {r.doc_id: r for r in secrets.scan_secrets(df, owner="none").collect()}
    assert found[5].n_hex == 1 and found[6].spans == "access:0:900000"


def test_trees_find_what_the_base_rules_miss(spark):
    """Fitted on documents with base data only; then addresses, phones and cards that people have written in other ways, and numbers that are none."""
    rng = random.Random(32)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep):
        while not luhn(x := "4" + d(15)):
            pass
        return sep.join(x[k : k + 4] for k in range(0, 16, 4))

    base = [f"{words(rng, 20)} {v} {words(rng, 20)}" for _ in range(300) for v in (f"mail {name()}@{name()}.org", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"card {card(' ')}", f"host {rng.randint(1, 255)}.{rng.randint(0, 255)}.0.{rng.randint(0, 255)}")]
    base += [f"{words(rng, 15)} {d(2)} {d(3)} {d(4)} {words(rng, 9)} {d(4)}/{d(2)}/{d(2)}/{d(4)}" for _ in range(300)]
    model = pii.fit_pii(spark.createDataFrame(list(enumerate(base)), DOC))
    yes = [(f"mail {name()} (at) {name()}.org", "email") for _ in range(100)] + [(f"card {card('/')}", "card") for _ in range(100)] + [(f"tel 1.({d(3)})" + f".{d(3)}.{d(4)}", "phone") for _ in range(100)]
    no = [f"{words(rng, 5)} {d(2)} {d(3)} {d(4)} {words(rng, 5)}" for _ in range(300)]
    texts = [f"{words(rng, 5)} {t} {words(rng, 5)}" for t, _ in yes] + no
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), DOC), model).collect()}
    caught = sum(got[i].n_added > 0 and yes[i][1] in got[i].spans for i in range(len(yes)))
    wrong = sum(got[len(yes) + i].n_added > 0 for i in range(len(no)))
    assert caught >= 0.6 * len(yes) and wrong <= 0.02 * caught, (caught, wrong, model.least)


ASSIGN, HEX = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"[0-9a-f]+"


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(33)
    parts = ["password", "Token", "api_key", "=", ": ", '"', "'", "abc123xyz", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "😀", "\n", " ", "secret", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = sorted([(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(HEX, t) if len(m[0]) >= 24])
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert got[i].base_sha256 == hashlib.sha256(said(want, secrets.KINDS).encode()).hexdigest()


def test_copied_secrets_are_examples(spark):
    rng = random.Random(34)
    mixed = lambda n: "".join(rng.choice("abcXYZ0189") for _ in range(n)) + "aB1"
    shown, own = mixed(60), [mixed(249) for _ in range(20)]
    rows = [(i, f"use {shown} or {own[i % 20]} {'token=' + shown if i == 0 else ''}", f"owner{i % 5}", i) for i in range(100)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, DOC + ", source string, h int")
    got = [r for r in secrets.scan_secrets(df).collect() if r.doc_id is not None]
    # the one that all owners have is an example; each of the others has one owner and five documents
    assert all((r.n_live, r.n_example) == (1, 1) and r.spans.count("access") == 1 for r in got)
    assert all(r.spans.split(",")[-1 if r.doc_id else 0].startswith("access" if r.doc_id else "access") for r in got) and len(got) == 100


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(35)
    y = rng.random(4000) < 0.3
    vote = lambda hit, miss: np.where(rng.random(4000) < np.where(y, hit, miss), 1, -1)
    good, fair, other, poor = vote(0.9, 0.05), vote(0.8, 0.1), vote(0.75, 0.1), vote(0.7, 0.2)
    p, hit, miss, cor = toxicity.label_model(np.column_stack([good, fair, other, poor, poor]))
    assert ((p > 0.5) == y).mean() > 0.93 and abs(hit[0] - 0.9) < 0.06 and abs(miss[0] - 0.05) < 0.04
    assert cor[3, 4] > 0.5 and np.abs(cor[:3, :3] - np.eye(3)).max() < 0.15


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    texts = [words(rng, 40) + (" you are a pathetic moron" if i % 4 == 0 else "") for i in range(400)] + [None, ""]
    big = (1 << 53) + 1
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (big, "you are a pathetic moron " + words(rng, 30))], DOC).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert {r.doc_id for r in rows} == {*range(402), None, big} and all(0 <= r.score <= 1 for r in rows) and model.correlations


def test_ids_are_kept_beside_null_ones(spark):
    """An id beyond 2^53 in one batch with a null one."""
    big = (1 << 53) + 1
    rng = random.Random(36)
    texts = [words(rng, 30), words(rng, 40), None, ""]
    df = spark.createDataFrame([(big, texts[0]), (None, texts[1]), (big + 2, texts[2]), (None, texts[3])], DOC).withColumns({"h": F.lit(1), "d": F.lit(None).cast("long"), "row": F.lit("r")}).coalesce(1)
    bench = spark.createDataFrame([(1, words(rng, 20))], "item_id long, text string")
    want = [big, big + 2, None, None]
    ids = lambda out: sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))
    for out in (
        sharding.shard_documents(df, 3), packing.pack_documents(df, PATH), quality.repetition_rules(df), lines.dedup_lines(df, short=True), jaccard.jaccard_classes(df),
        substrings.remove_repeats(df), secrets.scan_secrets(df), pii.find_pii(df, pii.PiiModel(-9.0, [], (float("inf"),) * 4)), decontamination.decontaminate(df, bench),
    ):
        assert ids(out) == want
    assert ids(quality.drop_repetitive(df)) == [big, None]
    near = jaccard.drop_near_duplicates(df)
    assert near.columns == df.columns and ids(near) == [big, big + 2, None] and {r.row for r in near.collect()} == {"r"}


def test_near_duplicates_leave_one_of_each_class(spark):
    rng = random.Random(37)
    base = words(rng, 120)
    near = base.split()
    near[50] = "edit"
    rows = [(3, base, 1), (1, " ".join(near), 2), (None, base, 3), (1, " ".join(near), 2), (5, words(rng, 50), 4), (None, None, 5), (6, "", 6)]
    got = jaccard.drop_near_duplicates(spark.createDataFrame(rows, DOC + ", lost int")).collect()
    assert sorted((r.doc_id, r.lost) for r in got) == [(1, 2), (5, 4), (6, 6)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        sharding.shard_documents(none, 3), packing.pack_documents(none, PATH), quality.repetition_rules(none), lines.dedup_lines(none),
        jaccard.jaccard_classes(none), substrings.remove_repeats(none), secrets.scan_secrets(none.withColumn("source", F.lit("s"))),
        pii.find_pii(none, pii.fit_pii(none)), toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)),
        decontamination.find_leaks(none, spark.createDataFrame([], "item_id long, text string")),
    ):
        assert out.count() == 0
