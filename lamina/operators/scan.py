"""Point, range, prefix and ordinal access to a snapshot in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.encoding import increment
from lamina.model import TableSpec
from lamina.operators.ranges import Ranges, beside


def _literal(spec: TableSpec, key) -> Column:
    key = key if isinstance(key, tuple) else (key,)
    return F.struct(*(F.lit(k).alias(n) for k, n in zip(key, spec.keys)))


def at_least(spec: TableSpec, key) -> Column:
    """key >= the given one.  A single key compares as a column, so it is pushed to the scan;
    a composite one also, by its first field."""
    if len(spec.keys) == 1:
        return F.col(spec.keys[0]) >= F.lit(key[0] if isinstance(key, tuple) else key)
    return (F.col(spec.keys[0]) >= F.lit(key[0])) & (spec.key() >= _literal(spec, key))


def get(df: DataFrame, spec: TableSpec, key) -> DataFrame:
    key = key if isinstance(key, tuple) else (key,)
    for n, k in zip(spec.keys, key):
        df = df.where(F.col(n).eqNullSafe(F.lit(k)) if k is None else F.col(n) == F.lit(k))
    return df


def ordered(df: DataFrame, spec: TableSpec, reverse: bool = False) -> DataFrame:
    return df.orderBy(*(F.col(k).desc() if reverse else F.col(k).asc() for k in spec.keys))


def range_from(df: DataFrame, spec: TableSpec, start) -> DataFrame:
    """All entries at or after ``start``; there is no upper end."""
    return ordered(df.where(at_least(spec, start)), spec)


def between(df: DataFrame, spec: TableSpec, low, high) -> DataFrame:
    """Entries from low to high, both included."""
    k = spec.key() if len(spec.keys) > 1 else F.col(spec.keys[0])
    top = _literal(spec, high) if len(spec.keys) > 1 else F.lit(high)
    return df.where(at_least(spec, low) & (k <= top))


def scan(df: DataFrame, spec: TableSpec, low, high, limit: int) -> DataFrame:
    """The first ``limit`` keys of the range and ``truncated``, whether there are more."""
    most = between(df, spec, low, high).select(*spec.keys).orderBy(*spec.keys).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*spec.keys))  # of limit + 1 rows at most
    out = most.withColumn("__n", n).withColumn("truncated", F.max("__n").over(Window.partitionBy()) > limit)
    return out.where(F.col("__n") <= limit).drop("__n")


def prefix(df: DataFrame, spec: TableSpec, start: str) -> DataFrame:
    """Entries whose first key field begins with ``start``; StartsWith is pushed to the scan."""
    return ordered(df.where(F.col(spec.keys[0]).startswith(start)), spec)


def prefix_bytes(df: DataFrame, column: str, start: bytes) -> DataFrame:
    """The same on a binary key, as a range up to the prefix's increment."""
    end = increment(start)
    df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) < F.lit(end))


def first_last(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: the smallest and the greatest key, by aggregation."""
    return df.agg(F.min(spec.key()).alias("lo"), F.max(spec.key()).alias("hi")).select(
        *(F.col(f"lo.{k}").alias(f"first_{k}") for k in spec.keys), *(F.col(f"hi.{k}").alias(f"last_{k}") for k in spec.keys)
    )


def lower_bound(df: DataFrame, spec: TableSpec, key) -> DataFrame:
    """The smallest entry at or after ``key``."""
    return df.where(at_least(spec, key)).orderBy(*spec.keys).limit(1)


def raw_lower_bound(df: DataFrame, encoded: Column, key: bytes) -> DataFrame:
    """The same in the unsigned byte order of an encoded key."""
    return df.withColumn("__raw", encoded).where(F.col("__raw") >= F.lit(key)).orderBy("__raw").limit(1).drop("__raw")


def lower_bounds(df: DataFrame, keys: list[str], wanted: DataFrame, value: Column, name: str = "found") -> DataFrame:
    """The columns of ``wanted``, which has the key columns too, and ``name``: ``value`` of the
    first row of df at or after the key (null: none).

    Rows and probes are dealt into the same key ranges.  Within a range the last row seen
    from its end is the answer; where a range ends first, the first row of the ranges after
    it is, carried by a row for each range.
    """
    held = df.select(*keys, F.struct(value.alias("v")).alias("__v"))
    asked = wanted.select(*keys, F.struct(*wanted.columns).alias("__w"))
    both = held.withColumn("__w", F.lit(None).cast(asked.schema["__w"].dataType)).unionByName(asked.withColumn("__v", F.lit(None).cast(held.schema["__v"].dataType)))
    both = both.withColumn("__b", Ranges(df, keys).number())
    back = [F.col(k).desc_nulls_last() for k in keys]
    later = Window.partitionBy("__b").orderBy(*back, F.col("__v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__hit", F.last("__v", ignorenulls=True).over(later)).where("__w is not null")
    lows = both.groupBy("__b").agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*keys))).alias("__low"))
    after = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    spare = lows.select("__b", F.last("__low", ignorenulls=True).over(after).alias("__next"))
    joined = found.join(F.broadcast(spare), "__b")
    return joined.select(*(F.col(f"__w.`{c}`").alias(c) for c in wanted.columns), F.coalesce("__hit", "__next")["v"].alias(name))


def seek_many(df: DataFrame, key: str, wanted: DataFrame, probe: str) -> DataFrame:
    """Lower bounds of many probes at once: ``probe, key`` (null: none at or after it)."""
    asked = wanted.select(F.col(probe).alias(key)).distinct()
    return lower_bounds(df.select(key), [key], asked, F.col(key)).select(F.col(key).alias(probe), F.col("found").alias(key))


def neighbours(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Each key with the one ``before`` and the one ``after``, as a cursor steps; composite
    keys as structs."""
    keys = list(spec.keys)
    step = spec.key() if len(keys) > 1 else F.col(keys[0])
    return beside(df.select(*keys), keys, before=(step, -1), after=(step, 1))


def rank_nth(df: DataFrame, spec: TableSpec, n: int, few: int = 10_000) -> DataFrame:
    """The n-th key, from 0; no row out of range.  Counts of key ranges find the range that
    holds it, which is cut into ranges again until ``few`` keys are left to order."""
    keys = list(spec.keys)
    rows, left, held = df.select(*keys), n, None
    while True:
        ranges = Ranges(rows, keys)
        dealt = rows.withColumn("__b", ranges.number())
        counts = sorted((r["__b"], r["count"]) for r in dealt.groupBy("__b").count().collect())
        whole = held
        for b, size in counts:
            if left < size:
                rows, held = dealt.where(F.col("__b") == b).select(*keys), size
                break
            left -= size
        else:
            return rows.where(F.lit(False))
        if held <= few or held == whole:
            return rows.orderBy(*keys).limit(left + 1).orderBy(*(F.col(k).desc() for k in keys)).limit(1)


def ordinal_of(df: DataFrame, spec: TableSpec, key) -> DataFrame:
    """One row: how many keys are smaller.  A filtered count."""
    k = spec.key() if len(spec.keys) > 1 else F.col(spec.keys[0])
    return df.where(k < (_literal(spec, key) if len(spec.keys) > 1 else F.lit(key))).agg(F.count(F.lit(1)).alias("ordinal"))


def cardinality(df: DataFrame, spec: TableSpec, low, high) -> DataFrame:
    return between(df, spec, low, high).agg(F.count(F.lit(1)).alias("n"))
