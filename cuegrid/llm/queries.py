"""One query for each numbered operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, jaccard, lines, packing, periodic, phrases, pii, quality, secrets, sharding, substrings, toxicity
from .common import documents, text_of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_pii(docs, pii.fit_pii(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 24)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir), 5, 0.8)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir), short=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(documents(spark, sf_dir)).drop("longest_repeat")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), 400)


def _planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where the text of each tenth id, by CRC, repeats a stretch of its words from some word on. A null id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("w"), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), n - a)
    words = docs.select("doc_id", text_of().alias("text")).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0B\f\r]+)"), F.lit(1))))
    return words.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = periodic.periodic_runs(_planted(documents(spark, sf_dir)), 6)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_check(documents(spark, sf_dir))


def base_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op13_fingerprints' rows: the lengths and the edited texts."""
    return op13_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op4_sharding's rows."""
    return op4_sharding(spark, sf_dir).select("doc_id", "size", "law")


def base_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3_pii's rows: the base spans of each kind, counted."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8_quality's rows: the base measures and their verdict."""
    return op8_quality(spark, sf_dir).drop("kept")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9_secrets' rows: the base spans of each kind, counted."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_toxicity, op2_decontamination, op3_pii, op4_sharding, op5_jaccard_join, op6_packing, op7_line_dedup, op8_quality, op9_secrets, op10_substrings, op11_periodic_runs, op12_collocations, op13_fingerprints)
    return {f.__name__: f for f in (*numbered, base_sizes, base_personal, base_quality, base_secrets, base_edits)}


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
SQL = {
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3)) t(m) WHERE i + m - 1 <= len(w)), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c), s AS (SELECT k.lang, k.phrase, k.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
 FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s), o AS (SELECT lang, a, array_to_string(w[j:j + 1], ' ') AS phrase FROM c, (VALUES (1), (2)) t(j) WHERE m = 3), x AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
v AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE cut = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
SELECT v.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM v JOIN n ON n.lang = v.lang WHERE rank <= 2000""",
    "base_edits": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS a FROM d WINDOW o AS (ORDER BY doc_id DESC))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(t, 1, n - n // 3) || substr(a, 1, n // 3)) AS edited_sha256 FROM e""",
    "base_sizes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, 'key' AS law FROM documents",
    "base_personal": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
 [{_DIGITS} for x in regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS c, [{_DIGITS} for x in regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')] AS p FROM d)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len([x for x in i if len([q for q in string_split(x, '.') if len(ltrim(q, '0')) > 3 OR CAST(right(q, 3) AS INT) > 255]) = 0]) AS BIGINT) AS n_ip,
 CAST(len([x for x in c if len(x) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (len(x) - k) % 2 = 1 THEN (2 * CAST(x[k] AS INT)) // 10 + (2 * CAST(x[k] AS INT)) % 10 ELSE CAST(x[k] AS INT) END for k in range(1, len(x) + 1)]) % 10 = 0]) AS BIGINT) AS n_card,
 CAST(len([x for x in p if len(x) BETWEEN 10 AND 15]) AS BIGINT) AS n_phone FROM m""",
    "base_quality": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^ 	-
]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^ 	-
]+'), 1) AS i FROM d),
f AS (SELECT doc_id, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM f WHERE five IS NOT NULL) WHERE n > 1), r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS i FROM g) GROUP BY doc_id),
l AS (SELECT doc_id, t, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ 	-
]')] AS lines FROM d), m AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
v AS (SELECT l.doc_id, coalesce(m.n, 0) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM l LEFT JOIN m ON m.doc_id = l.doc_id LEFT JOIN r ON r.doc_id = l.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v""",
    "base_secrets": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id,
 CAST(len([x for x in regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1) if length(x) >= 6]) AS BIGINT) AS n_assign,
 CAST(len([x for x in regexp_extract_all(t, 'AKIA[A-Z0-9]+') if length(x) >= 20]) AS BIGINT) AS n_access, CAST(len([x for x in regexp_extract_all(t, '[0-9a-f]+') if length(x) >= 24]) AS BIGINT) AS n_hex FROM d""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the numbered ones are held to brute force in tests."""
    return dict(SQL)
