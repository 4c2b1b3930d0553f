"""Spans of pattern matches as native columns: array<struct<no,start,end,value>>, in code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<no:int,start:int,end:int,value:string>>"
#: Prefix sums are made in blocks of so many, since appending to an array copies it.
BLOCK = 128


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine=lambda a, x: a + x, zero: int = 0) -> Column:
    """Of a non-empty array<int>: for each element all elements before it, combined (summed, unless told otherwise)."""

    def within(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

    def with_starts(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(zero), combine))
        starts = within(totals, F.lit(zero))
        return F.flatten(F.zip_with(bs, F.slice(starts, 1, F.size(bs)), lambda b, s: F.slice(within(b, s), 1, F.size(b))))

    return bind(blocks, with_starts)


def matches(text: Column, pattern: str, no: int) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string.

    split() with the pattern gives the text between the matches and regexp_extract_all the matches, so a
    match starts after all that stands before it. Linear in the text; texts without a match make an empty
    array.
    """
    empty = F.array().cast(SPAN)

    def place(x: Column) -> Column:
        lens = F.zip_with(x["gaps"], x["hits"], lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0)))

        def build(before: Column) -> Column:
            ends = F.transform(x["hits"], lambda h, i: F.struct(
                F.lit(no).alias("no"),
                (before[i] + F.length(x["gaps"][i])).alias("start"),
                (before[i] + F.length(x["gaps"][i]) + F.length(h)).alias("end"),
                h.alias("value"),
            ))
            return ends.cast(SPAN)

        return bind(running(lens), build)

    both = lambda hits: F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(found, lambda hits: F.when(F.size(hits) > 0, bind(both(hits), place)).otherwise(empty))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined; repeats once."""
    names = F.array(*[F.lit(k) for k in kinds])
    order = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end")))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", names[s["no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")
