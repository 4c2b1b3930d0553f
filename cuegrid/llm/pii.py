"""Personal data by candidate gradient boosting: generators, boosted trees as SQL, calibrated thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of
from .spans import SPAN, bind, joined, matches, of_kind, running

KINDS = ("email", "ip", "card", "phone")
# A match never starts inside a run of its first class unless the last match ended there (\G), which is
# where the plain pattern would find it too; without that a long run would be tried from each character. Possessive loops
# take what the plain ones take (what follows can't start with what they took), and need no stack on runs of any length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# High-recall generators of further candidates, one for each kind; their spans may overlap.
MORE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63})++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9]{4}[\x20./_-]{1,2}[0-9]{4}[\x20./_-]{1,2}[0-9]{4}[\x20./_-]{1,2}[0-9]{2,7}(?![0-9])",
    r"(?<![0-9A-Za-z+])\(?0?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])",
)
# What a text must hold for a pattern to match at all: most texts hold no digit and no @, and are not searched.
DIGIT, COLON, AT = "[0-9]", "[0-9A-Fa-f]:[0-9A-Fa-f]", r"@|[(\[{]at[)\]}]|\x20dot\x20"
GUARDS, MORE_GUARDS = ("@", DIGIT, DIGIT, r"\+[0-9]"), (AT, COLON, DIGIT, DIGIT)
CONTEXT = (r"(?i)mail|contact|write|@", r"(?i)\bip\b|host|server|addr|ping", r"(?i)card|visa|master|amex|credit|carte|karte|tarjeta", r"(?i)tel|phone|call|fax|mobil|whatsapp|sms")
#: (feature, largest value): small integers, so that a sample has few distinct rows.
FEATURES = (("kind", 3), ("digits", 20), ("groups", 6), ("odd_marks", 3), ("context", 1), ("other_context", 1), ("glued", 2), ("spread", 5), ("check", 1))


@dataclass
class PiiModel:
    """trees: (feature, cut, feature under it, cut, four leaf values); least: the score a kind's candidate needs."""

    bias: float
    trees: list[tuple]
    least: tuple[float, ...]


def _luhn(v: Column) -> Column:
    return F.call_function("luhn_check", v)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _where(text: Column, guard: str, found: Column) -> Column:
    return F.when(text.contains(guard) if guard == "@" else text.rlike(guard), found).otherwise(F.array().cast(SPAN))


def _base(text: Column) -> Column:
    email, ip, card, phone = (_where(text, g, matches(text, p, no)) for no, (p, g) in enumerate(zip((EMAIL, IP, CARD, PHONE), GUARDS, strict=True)))
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
    ip = F.filter(ip, lambda s: F.forall(F.split(s["value"], r"\."), small))
    card = F.filter(card, lambda s: F.length(_digits(s["value"])).between(14, 19) & _luhn(_digits(s["value"])))
    phone = F.filter(phone, lambda s: F.length(_digits(s["value"])).between(10, 15))
    return F.concat(email, ip, card, phone)


def _features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """A candidate's format and context as a struct of small integers."""
    cap = lambda c, most: F.least(c, F.lit(most)).cast("int")
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")
    widths = F.transform(groups, F.length)
    own = F.lit(False)
    other = F.lit(False)
    for no, words in enumerate(CONTEXT):
        said = F.coalesce(before.rlike(words), F.lit(False))
        own = own | ((kind == no) & said)
        other = other | ((kind != no) & said)
    return F.struct(
        kind.cast("int").alias("kind"),
        cap(F.length(_digits(value)), 20).alias("digits"),
        cap(F.size(groups), 6).alias("groups"),
        cap(F.length(F.regexp_replace(value, r"[0-9A-Za-z@\x20.-]", "")), 3).alias("odd_marks"),
        yes(own).alias("context"),
        yes(other).alias("other_context"),
        (yes(F.right(before, F.lit(1)).rlike("[0-9A-Za-z]")) + yes(F.left(after, F.lit(1)).rlike("[0-9A-Za-z]"))).cast("int").alias("glued"),
        cap(F.coalesce(F.array_max(widths) - F.array_min(widths), F.lit(0)), 5).alias("spread"),
        yes(F.when(kind == 2, _luhn(_digits(value))).when(kind == 0, value.rlike(r"[A-Za-z]$"))).alias("check"),
    )


def _candidates(text: Column) -> Column:
    """All candidates of the generators with their surroundings."""
    found = F.concat(*[_where(text, g, matches(text, p, no)) for no, (p, g) in enumerate(zip(MORE, MORE_GUARDS, strict=True))])
    return F.transform(
        found,
        lambda s: F.struct(
            s["no"].alias("no"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(8)).alias("after"),
        ),
    )


def _boost(rows: list[tuple[tuple[int, ...], float, float]], rounds: int, rate: float) -> tuple[float, list[tuple]]:
    """Gradient boosting of logistic loss by trees of depth 2 over (feature values, positives, negatives)."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    bias = math.log((pos + 1) / (neg + 1))
    score = [bias] * len(rows)
    trees = []

    def split(members: list[int], g: list[float], h: list[float]) -> tuple[float, int, int]:
        best = (0.0, 0, -1)
        sg, sh = sum(g[i] for i in members), sum(h[i] for i in members)
        for f, (_, most) in enumerate(FEATURES):
            bins = [[0.0, 0.0] for _ in range(most + 1)]
            for i in members:
                b = bins[rows[i][0][f]]
                b[0] += g[i]
                b[1] += h[i]
            a = c = 0.0
            for cut in range(most):
                a, c = a + bins[cut][0], c + bins[cut][1]
                gain = a * a / (c + 1) + (sg - a) ** 2 / (sh - c + 1) - sg * sg / (sh + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r[1] * (1 - q) - r[2] * q for r, q in zip(rows, p, strict=True)]
        h = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        everyone = range(len(rows))
        gain, f, cut = split(list(everyone), g, h)
        if cut < 0:
            break
        sides, tree = [[i for i in everyone if rows[i][0][f] <= cut], [i for i in everyone if rows[i][0][f] > cut]], [f, cut]
        for side in sides:
            _, f2, cut2 = split(side, g, h)
            leaves = []
            for part in ([i for i in side if rows[i][0][f2] <= cut2], [i for i in side if rows[i][0][f2] > cut2]):
                leaf = rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + 1)
                leaves.append(leaf)
                for i in part:
                    score[i] += leaf
            tree += [f2, cut2, *leaves]
        trees.append(tuple(tree))
    return bias, trees


def _raw(model_bias: float, trees: list[tuple], value) -> float:
    s = model_bias
    for f, cut, fl, cl, l0, l1, fr, cr, r0, r1 in trees:
        s += (l0 if value[fl] <= cl else l1) if value[f] <= cut else (r0 if value[fr] <= cr else r1)
    return s


def fit_pii(df: DataFrame, max_rows: int = 20_000, rounds: int = 24, rate: float = 0.3, precision: float = 0.98) -> PiiModel:
    """Fit trees on a bounded sample, about half the documents or `max_rows` / 2 of them, chosen by hash; thresholds on all others.

    There are no labels of personal data, so the base rules teach. Positives: values that pass them, each
    also rewritten as people write them (an address with (at), a phone without its plus, a card with other
    separators) after a word that announces its kind. Negatives: candidates that no base rule accepts and
    nothing announces, and the positives' digits after a word of another kind. The trees are fitted on the sample, reduced in
    Spark to counts of distinct feature rows. The thresholds are calibrated on all documents outside the sample, counted in the same way (on the
    sample itself where nothing is outside): each kind's threshold is the least score from which on at least `precision` of the candidates are positive. A kind without such a score
    adds nothing. A few hundred rows of counts come to the driver, whatever the input. Null ids are outside the sample.
    """
    n = df.count()
    text = text_of()
    sampled = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("pii")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, max_rows / max(n, 1) / 2, 0.5)), F.lit(False))
    seen = df.select((~sampled).cast("int").alias("half"), _base(text).alias("base"), _candidates(text).alias("more"))
    seen = materialise(seen.where((F.size("base") > 0) | (F.size("more") > 0)))
    near = lambda c, b: (c["start"] < b["end"]) & (b["start"] < c["end"])
    told = seen.select("half", "base", F.explode("more").alias("c")).select(
        "half",
        F.exists("base", lambda b: near(F.col("c"), b) & (b["no"] == F.col("c.no"))).alias("y"),
        _features(F.col("c.no"), F.col("c.value"), F.col("c.before"), F.col("c.after")).alias("x"),
    ).where(F.col("y") | (F.col("x.context") == 0))
    base = seen.select("half", F.explode("base").alias("b")).select("half", "b.no", "b.value")
    spoken = (
        (F.regexp_replace("value", "@", " (at) "), "mail "),
        (F.col("value"), "host "),
        (F.regexp_replace(_digits(F.col("value")), "(.{4})", "$1/"), "card "),
        (F.regexp_replace(F.regexp_replace("value", r"^\+", ""), r"[\x20-]", "."), "tel "),
    )
    made = []
    for no, (value, word) in enumerate(spoken):
        for says, y in ((word, True), (spoken[(no + 1) % 4][1], False)):
            if y or no in (2, 3):
                made.append(base.where(F.col("no") == no).select("half", F.lit(y).alias("y"), _features(F.lit(no), value, F.lit(says), F.lit(" ")).alias("x")))
    rows = told
    for m in made:
        rows = rows.unionByName(m)
    got = rows.groupBy("half", "x").agg(F.sum(F.col("y").cast("int")).alias("pos"), F.sum((~F.col("y")).cast("int")).alias("neg")).collect()
    table = [(r["half"], tuple(r["x"]), float(r["pos"]), float(r["neg"])) for r in got]
    table.sort()
    fit = [r[1:] for r in table if r[0] == 0] or [r[1:] for r in table]
    bias, trees = _boost(fit, rounds, rate) if table else (-9.0, [])
    held = {r[0] for r in table} >= {1}
    least = []
    for no in range(len(KINDS)):
        ranked = sorted(((_raw(bias, trees, x), p, q) for half, x, p, q in table if (half == 1 or not held) and x[0] == no), reverse=True)
        at, p_sum, q_sum = float("inf"), 0.0, 0.0
        for i, (s, p, q) in enumerate(ranked):
            p_sum, q_sum = p_sum + p, q_sum + q
            last = i + 1 == len(ranked) or ranked[i + 1][0] < s
            if last and s > 0 and p_sum >= 5 and p_sum >= precision * (p_sum + q_sum):
                at = s
        least.append(at)
    return PiiModel(bias, trees, tuple(least))


def _score(model: PiiModel, x: Column) -> Column:
    names = [f for f, _ in FEATURES]
    s = F.lit(model.bias)
    for f, cut, fl, cl, l0, l1, fr, cr, r0, r1 in model.trees:
        left = F.when(x[names[fl]] <= cl, F.lit(l0)).otherwise(F.lit(l1))
        right = F.when(x[names[fr]] <= cr, F.lit(r0)).otherwise(F.lit(r1))
        s = s + F.when(x[names[f]] <= cut, left).otherwise(right)
    return s


def _disjoint(base: Column, chosen: Column) -> Column:
    """Chosen candidates that overlap no base span and start in no other candidate: the earlier one wins.

    One sorted array, with the greatest end before and the least start after each place: linear in the spans, as far as sorting is."""
    row = lambda s, added: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["no"].alias("no"), s["end"].alias("end"))
    every = F.array_sort(F.concat(F.transform(base, lambda s: row(s, 0)), F.transform(chosen, lambda s: row(s, 1))))
    far = (1 << 31) - 1
    later, sooner = (lambda a, x: F.greatest(a, x)), (lambda a, x: F.least(a, x))

    def free(xs: Column) -> Column:
        before = running(F.transform(xs, lambda s: F.when(s["added"] == 0, s["end"]).otherwise(0)), later, 0)
        after = F.reverse(running(F.transform(F.reverse(xs), lambda s: F.when(s["added"] == 0, s["start"]).otherwise(far)), sooner, far))
        kept = F.filter(F.zip_with(xs, F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda s, at: F.struct(s.alias("s"), at.alias("at"))),
                        lambda x: (x["s"]["added"] == 1) & (x["at"]["b"] <= x["s"]["start"]) & (x["at"]["a"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: x["s"])

    def alone(xs: Column) -> Column:
        before = running(F.transform(xs, lambda s: s["end"]), later, 0)
        return F.filter(xs, lambda s, i: before[i] <= s["start"])

    none = F.array().cast("array<struct<start:int,added:int,no:int,end:int>>")
    some = lambda xs, f: bind(xs, lambda x: F.when(F.size(x) > 0, f(x)).otherwise(none))
    spans = F.transform(some(some(every, free), alone), lambda s: F.struct(s["no"].alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value")))
    return F.when(F.size(chosen) > 0, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, model: PiiModel) -> DataFrame:
    """Redaction spans of every whole text.

    Base spans (addresses, IPv4 addresses, card numbers, phone numbers that pass their checks) are kept
    always. Other candidates are scored by the boosted trees and selected by their kind's calibrated
    threshold; one that overlaps a base span, or starts in an earlier candidate, adds nothing. Returns doc_id, n_email, n_ip, n_card, n_phone
    (base spans), base_sha256, spans and n_added. One row for each input row, repeated rows and null doc_ids included; null and empty texts have no
    spans. Other columns are not read, whatever their names. An empty table gives an empty table. One pass without a shuffle, all in built-in functions; runs of
    digits, dots or letters of any length need no stack.
    """
    text = text_of()
    read = df.select("doc_id", _base(text).alias("base"), _candidates(text).alias("more"))
    if all(x == float("inf") for x in model.least):
        read = read.select("doc_id", "base", F.array().cast(SPAN).alias("added"))
    else:
        least = F.array(*[F.lit(x) for x in model.least])
        chosen = F.filter(F.col("more"), lambda c: bind(_features(c["no"], c["value"], c["before"], c["after"]), lambda x: _score(model, x) >= least[c["no"]]))
        read = read.select("doc_id", "base", chosen.alias("chosen")).select("doc_id", "base", _disjoint(F.col("base"), F.col("chosen")).alias("added"))
    return read.select(
        "doc_id",
        *[of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
