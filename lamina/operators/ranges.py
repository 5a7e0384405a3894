"""Order over a whole table without sorting it in one task.

Bounds from a fixed-size sample deal the rows into key ranges.  Running counts are made
within ranges, and a row for each range carries the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sample rows a range; with as many ranges as shuffle partitions the sample is bounded.
PER_RANGE = 40


class Ranges:
    """Key ranges of about equal size.  The sample is of the keys of smallest hash, so it is
    the same however the rows are dealt; its size depends on the number of ranges alone."""

    def __init__(self, df: DataFrame, keys: list[str], ranges: int | None = None):
        self.keys, self.types = list(keys), [df.schema[k].dataType for k in keys]
        n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        #: Ascending keys that begin the second and later ranges.
        self.cuts: list[tuple] = []
        if n > 1:
            sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(n * PER_RANGE).distinct().orderBy(*keys).collect()
            step = max(1, len(sample) // n)
            self.cuts = [tuple(r) for r in sample[step::step]][: n - 1]

    @classmethod
    def of(cls, keys: list[str], types: list, cuts: list[tuple]) -> Ranges:
        self = cls.__new__(cls)
        self.keys, self.types, self.cuts = keys, types, cuts
        return self

    def number(self, columns: list[str] | None = None, after: bool = False) -> Column:
        """How many bounds are at or below (``after``: below) the key in ``columns``: found by
        halving, in as many steps as the number of bounds has bits."""
        if not self.cuts:
            return F.lit(0)
        columns = columns or self.keys
        if len(columns) == 1:
            table = F.array(*(F.lit(c[0]).cast(self.types[0]) for c in self.cuts))
            key = F.col(columns[0])
        else:
            table = F.array(*(F.struct(*(F.lit(v).cast(t).alias(k) for v, t, k in zip(c, self.types, self.keys))) for c in self.cuts))
            key = F.struct(*(F.col(c).alias(k) for c, k in zip(columns, self.keys)))
        n = len(self.cuts)
        steps = F.array(*(F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)))

        def halve(at: Column, step: Column) -> Column:
            bound = F.get(table, at + step - 1)
            return F.when((at + step <= n) & (bound < key if after else bound <= key), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), halve)


def running(df: DataFrame, keys: list[str], ranges: int | None = None, ties: Sequence[Column] = (), **amounts: Column) -> DataFrame:
    """df with a column for each amount: its sum over all rows before, in key order; rows of
    one key in the order of ``ties``."""
    dealt = df.withColumn("__b", Ranges(df, keys, ranges).number())
    for name, amount in amounts.items():
        dealt = dealt.withColumn(f"__a_{name}", amount.cast("long"))
    sizes = dealt.groupBy("__b").agg(*(F.sum(f"__a_{n}").alias(f"__s_{n}") for n in amounts))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__b", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in amounts))
    within = Window.partitionBy("__b").orderBy(*keys, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", *(F.coalesce(F.sum(f"__a_{n}").over(within), F.lit(0)).alias(f"__i_{n}") for n in amounts))
    out = inner.join(F.broadcast(starts), "__b")
    return out.select(*(f"`{c}`" for c in df.columns), *((F.col(f"__i_{n}") + F.col(f"__s_{n}")).alias(n) for n in amounts))


def numbered(df: DataFrame, keys: list[str], name: str = "ordinal", ranges: int | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """df with each row's place in key order, from 0."""
    return running(df, keys, ranges, ties, **{name: F.lit(1)})


def beside(df: DataFrame, keys: list[str], **wanted: tuple[Column, int]) -> DataFrame:
    """df with values of the row one before (-1) or one after (1) in key order, under the
    given names: within ranges by a window, at their ends from one carried row a range."""
    dealt = df.withColumn("__b", Ranges(df, keys).number())
    for name, (value, _) in wanted.items():
        dealt = dealt.withColumn(f"__v_{name}", value)
    order = Window.partitionBy("__b").orderBy(*keys)
    key = F.struct(*keys)
    edge = dealt.groupBy("__b").agg(
        *((F.max_by if way < 0 else F.min_by)(F.struct(F.col(f"__v_{n}").alias("v")), key).alias(f"__e_{n}") for n, (_, way) in wanted.items())
    )
    ranges = Window.orderBy("__b")  # a row for each range
    edge = edge.select("__b", *((F.lag if way < 0 else F.lead)(f"__e_{n}").over(ranges).alias(f"__e_{n}") for n, (_, way) in wanted.items()))
    n, at = F.count(F.lit(1)).over(Window.partitionBy("__b")), F.row_number().over(order)
    inner = dealt.select("*", n.alias("__n"), at.alias("__at"), *((F.lag if way < 0 else F.lead)(f"__v_{x}").over(order).alias(f"__w_{x}") for x, (_, way) in wanted.items()))
    out = inner.join(F.broadcast(edge), "__b")

    def pick(name: str, way: int) -> Column:
        return F.when(F.col("__at") == (F.lit(1) if way < 0 else F.col("__n")), F.col(f"__e_{name}.v")).otherwise(F.col(f"__w_{name}")).alias(name)

    return out.select(*(f"`{c}`" for c in df.columns), *(pick(x, way) for x, (_, way) in wanted.items()))
