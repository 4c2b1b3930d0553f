"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, thinned
from .spans import SPAN, joined, matches, of_kind

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run is matched from its start to its end, so asking for the length in the pattern finds the same spans
# as matching runs of any length and dropping the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the method adds where one owner alone has it: prefixed tokens, web tokens, long mixed runs. A run is tried from its start only, and
#: each look ahead stops at the first character of its kind or goes once to the run's end, whatever its length.
ADDED = (
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+)"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{40,}+={0,2}"
)


def _base(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    return F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))


def _secret_part(span: Column) -> Column:
    return F.when(span["no"] == 0, F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])


def scan_secrets(
    df: DataFrame,
    repository: str = "doc_id",
    owner: str = "source",
    max_owners: int = 2,
    max_repositories: int = 20,
) -> DataFrame:
    """Find secrets in every whole text and tell owner-specific ones from widely copied examples.

    Base spans: assignments to a password-like name with a value of 6 characters or more, access key ids of
    20 or more, hex runs of 24 or more. Further candidates (prefixed tokens, web tokens, long runs that mix
    cases and digits) become spans of kind `access` only if they are live-looking. A candidate's value is
    hashed, and over the whole corpus its distinct repositories and owners are counted; one with at most
    `max_owners` owners and `max_repositories` repositories is live-looking, others are copied examples.

    Returns doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (base and added), n_live and
    n_example (distinct values of either kind in the document). One row for each input row; null and empty
    texts have no spans. A null owner or repository counts as one of its own; so does a column that df lacks. Rows that repeat another one wholly are rows like any other, of one
    repository. Names of further columns may clash with ours; they are not read. An empty table gives an empty table. Texts are read once and whole; only
    spans are written and shuffled. Values are counted by (value, owner, repository), summed in two steps,
    so a value that a third of the rows share is a partial count per task. Only values that are live-looking, which few rows have, are then looked for
    in the documents; a document's other values are examples.
    """
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    key = lambda c: F.coalesce(df[c].cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit("\u0000null"))
    read = df.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        key(repository).alias("repository"),
        key(owner).alias("owner"),
        _base(text).alias("base"),
        matches(text, ADDED, 1).alias("more"),
    )
    tag = lambda s, added: F.struct(
        s["no"].alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(added).alias("added"), F.xxhash64(_secret_part(s), F.lit(1)).alias("h")
    )
    found = materialise(
        read.select(
            "doc_id", "row", "repository", "owner", "base",
            F.concat(F.transform("base", lambda s: tag(s, False)), F.transform("more", lambda s: tag(s, True))).alias("all"),
        )
    )
    some = found.where(F.size("all") > 0).select("row", "repository", "owner", F.explode("all").alias("s")).select("row", "repository", "owner", "s.*")
    live = materialise(
        some.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("h", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        .where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("h")
    )
    maybe, _ = thinned(some, "h", live)
    judged = (
        maybe.join(live, "h")
        .groupBy("row")
        .agg(
            F.collect_list(F.when(F.col("added"), F.struct("no", "start", "end", F.lit("").alias("value")))).alias("added"),
            F.count_distinct("h").alias("n_live"),
        )
    )
    spans = lambda more: F.concat(F.col("base"), more)
    out = lambda d, more, live, example: d.select(
        "doc_id",
        *[of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(spans(more), KINDS).alias("spans"),
        live.alias("n_live"),
        example.alias("n_example"),
    )
    hit = found.where(F.size("all") > 0).join(judged, "row", "left")
    # an added span that lies within a base one tells nothing new
    added = F.coalesce("added", F.array()).cast(SPAN)
    new = F.filter(added, lambda a: ~F.exists(F.col("base"), lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])))
    n_live = F.coalesce("n_live", F.lit(0)).cast("long")
    n_all = F.size(F.array_distinct(F.transform("all", lambda s: s["h"]))).cast("long")
    none = found.where(F.size("all") == 0)
    return out(hit, new, n_live, n_all - n_live).unionByName(
        out(none, F.array().cast(SPAN), F.lit(0).cast("long"), F.lit(0).cast("long"))
    )
