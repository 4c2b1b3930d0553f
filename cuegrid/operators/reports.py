"""Reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The texts of a section report.
HEADING, LINE, MORE = "Sections analyzed and processed:", "      - %s: %d/%d beats (%.1f%%)", "      - ... plus %d more sections"


def section_text(rows: DataFrame, most: int = 12) -> DataFrame:
    """(track_id, said): a heading, a line for each of the first sections with its share of chosen beats, and the number of others.

    rows: track_id, section_idx, type, selected, beats, density. A type without a name is called Section, a density that is null follows
    from the counts, counts that are null are 0. Only the first `most` rows of a track and a count are gathered."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("track_id").orderBy("section_idx"))
    name = F.initcap(F.trim(F.regexp_replace(F.coalesce("type", F.lit("")), "_", " ")))
    n, of = F.coalesce("selected", F.lit(0)).cast("long"), F.coalesce("beats", F.lit(0)).cast("long")
    share = F.coalesce("density", F.try_divide(n, of), F.lit(0.0))
    # half-even on a rounded share: a tie is then the same everywhere
    line = F.format_string(LINE, F.when(name == "", "Section").otherwise(name), n, of, F.bround(F.round(share, 9) * 100, 1))
    lines = rows.withColumn("rn", at).groupBy("track_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", line.alias("line"))))), lambda x: x["line"]), "\n").alias("lines"),
        F.count("*").alias("m"),
    )
    more = F.when(F.col("m") > most, F.concat(F.lit("\n"), F.format_string(MORE, F.col("m") - most))).otherwise("")
    return lines.select("track_id", F.concat(F.lit(f"{HEADING}\n"), "lines", more).alias("said"))
