"""Ordered passes over keys of any size: rows are dealt by ranges of (key, order), and what the other ranges of a key hold is carried to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Rows that the bounds of a range are read from, about.
DRAWN = 200
#: How the values of a running column are put together, and how those of a key's earlier (or later) ranges join a range's own.
_MERGE = {"sum": lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least, "last": F.coalesce, "first": F.coalesce}


class Ranges:
    """Ranges of (key, order) over a table, about equal in rows. A range is one partition, rows equal in key and order are in one range, and a key has as many ranges as it needs.

    The bounds are one row a range, from an ordering of the keys and order of DRAWN rows a range; they are all that reaches the driver. Any bounds give the same
    results, so larger tables need not be exchanged whole for them. Null keys are one key, and come first."""

    def __init__(self, key: str, order: str | tuple[str, ...], table: DataFrame, parts: int | None = None):
        self.key, self.order = key, (order,) if isinstance(order, str) else order
        rows = table.select(F.struct(key, *self.order).alias("at"))
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        count = rows.count()
        drawn = rows.sample(n * DRAWN / count, 1) if count > n * DRAWN else rows
        got = drawn.repartitionByRange(n, "at").groupBy(F.spark_partition_id().alias("no")).agg(F.min("at").alias("at")).collect()
        self.kinds = rows.schema["at"].dataType
        self.starts: list[Row] = [r.at for r in sorted(got, key=lambda r: r.no)]

    def of(self) -> Column:
        """The last range that starts at the row's (key, order) or before it, found by halving."""
        at = F.struct(self.key, *self.order)
        bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(s, self.kinds)]) for s in self.starts])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(self.starts).bit_length())))])
        here = lambda pos, s: F.when((pos + s < len(self.starts)) & (F.get(bounds, pos + s) <= at), pos + s).otherwise(pos)
        return F.greatest(F.aggregate(steps, F.lit(-1), here), F.lit(0)) if self.starts else F.lit(0)

    def marked(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__range", self.of())

    def dealt(self, df: DataFrame) -> DataFrame:
        """df with `__range`, each range in a partition of its own."""
        return self.marked(df).repartitionById(max(1, len(self.starts)), "__range")

    def of_several(self, df: DataFrame) -> DataFrame:
        """The rows of df whose key may have several ranges: a range's start bears such a key. So at most two keys a range are left."""
        at = [s[0] for s in self.starts[1:]]
        kind = self.kinds[self.key].dataType
        known = F.array(*[F.lit(v).cast(kind) for v in {x for x in at if x is not None}])
        hit = F.array_contains(known.cast(f"array<{kind.simpleString()}>"), F.col(self.key))
        return df.where(F.coalesce(hit, F.lit(None in at)))

    def running(self, df: DataFrame, before: dict[str, tuple[str, Column]], after: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
        """df with a column for each of `before`, over the key's rows up to this one and its equals, and of `after`, from this one and its equals on.

        A column is how (sum, max, min; before also last, after also first, not null) and of what. One pass over the rows of keys with several ranges gives each range's own values, at most
        two rows a range, which are carried on by a window over these alone; a second pass deals the rows by range. No exchange is by the key alone."""
        w = Window.partitionBy("__range", self.key)
        # what follows is what came before in the opposite order: a frame that only grows takes each row once, one that only shrinks takes all that is left again for each row
        upto, since = (w.orderBy(*[by(c) for c in self.order]).rangeBetween(Window.unboundedPreceding, 0) for by in (F.asc, F.desc))
        sides = [(before, upto, (Window.unboundedPreceding, -1)), (after or {}, since, (1, Window.unboundedFollowing))]
        call = {"sum": F.sum, "max": F.max, "min": F.min}
        totals, carried, local = [], [], {}
        ranged = Window.partitionBy(self.key).orderBy("__range")
        for which, frame, others in sides:
            for name, (how, what) in which.items():
                if how in call:
                    totals.append(call[how](what).alias(f"__{name}"))
                    carried.append(call[how](f"__{name}").over(ranged.rowsBetween(*others)).alias(f"__{name}"))
                    local[name] = call[how](what).over(frame)
                else:
                    pick = {"last": (F.max_by, F.last), "first": (F.min_by, F.first)}[how]
                    totals.append(pick[0](what, F.when(what.isNotNull(), F.struct(*self.order))).alias(f"__{name}"))
                    carried.append(pick[1](f"__{name}", True).over(ranged.rowsBetween(*others)).alias(f"__{name}"))
                    local[name] = F.last(what, True).over(frame)
        share = self.marked(self.of_several(df)).groupBy("__range", self.key).agg(*totals)
        carry = share.select(F.col("__range").alias("__r"), F.col(self.key).alias("__k"), *carried)
        rows = self.dealt(df).withColumns({f"__own_{n}": c for n, c in local.items()})
        # at most two rows a range
        met = rows.join(F.broadcast(carry), (F.col("__range") == F.col("__r")) & F.col(self.key).eqNullSafe(F.col("__k")), "left")
        how = {n: h for which, *_ in sides for n, (h, _) in which.items()}
        return met.select(*df.columns, *[_MERGE[how[n]](F.col(f"__own_{n}"), F.col(f"__{n}")).alias(n) for n in local])
