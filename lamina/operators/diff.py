"""Row-level difference of two versions of a table, and its use as a patch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import TableSpec

ADD, MOD, DEL = "ADD", "MOD", "DEL"


def diff(a: DataFrame, b: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys that differ: ``keys, diff_type, a_<value>, b_<value>``.

    One full outer join on the key: each row is shuffled once, and not at all where both
    versions are stored bucketed by key.  Values compare null-safely; a null key equals a
    null key.
    """
    left = a.select(*(F.col(k).alias(f"__a_{k}") for k in spec.keys), *(F.col(v).alias(f"a_{v}") for v in spec.values), F.lit(True).alias("__a"))
    right = b.select(*(F.col(k).alias(f"__b_{k}") for k in spec.keys), *(F.col(v).alias(f"b_{v}") for v in spec.values), F.lit(True).alias("__b"))
    on = [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in spec.keys]
    both = left.join(right, on, "full_outer")
    equal = F.lit(True)
    for v in spec.values:
        equal = equal & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    kind = F.when(F.col("__a").isNull(), ADD).when(F.col("__b").isNull(), DEL).otherwise(MOD)
    changed = both.where(F.col("__a").isNull() | F.col("__b").isNull() | ~equal)
    keys = [F.coalesce(f"__a_{k}", f"__b_{k}").alias(k) for k in spec.keys]
    return changed.select(*keys, kind.alias("diff_type"), *(f"a_{v}" for v in spec.values), *(f"b_{v}" for v in spec.values))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("diff_type").agg(F.count(F.lit(1)).alias("n"))


def first_changes(changes: DataFrame, spec: TableSpec, n: int) -> DataFrame:
    """The first n changes in key order; a top-n, not a full sort."""
    return changes.orderBy(*spec.keys).limit(n)


def invert(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """The change that undoes it."""
    kind = F.when(F.col("diff_type") == ADD, DEL).when(F.col("diff_type") == DEL, ADD).otherwise(MOD)
    return changes.select(
        *spec.keys,
        kind.alias("diff_type"),
        *(F.col(f"b_{v}").alias(f"a_{v}") for v in spec.values),
        *(F.col(f"a_{v}").alias(f"b_{v}") for v in spec.values),
    )


def as_edits(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """``keys, values, is_delete``: what the change sets, whatever stood there."""
    return changes.select(*spec.keys, *(F.col(f"b_{v}").alias(v) for v in spec.values), (F.col("diff_type") == DEL).alias("is_delete"))


def bags(a: DataFrame, b: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys whose rows differ, with all of them: ``keys, old, new``, sorted arrays of values.

    What ``diff`` is for unique keys, complete also where a key has several rows: there the
    pairs of ``diff`` leave out the rows that both versions have.  One grouping: each row is
    shuffled once.
    """
    sides = [df.select(*spec.keys, F.lit(i).alias("__side"), spec.value().alias("__v")) for i, df in enumerate((a, b))]
    held = [F.sort_array(F.collect_list(F.when(F.col("__side") == i, F.col("__v")))).alias(n) for i, n in enumerate(("old", "new"))]
    return sides[0].unionByName(sides[1]).groupBy(*spec.keys).agg(*held).where(F.col("old") != F.col("new"))


def bag_pairs(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """The same as ``diff`` gives it: the pairs of a key's old and new rows that differ."""
    both = changes.withColumn("old", F.explode_outer("old")).withColumn("new", F.explode_outer("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), ADD).when(F.col("new").isNull(), DEL).otherwise(MOD)
    return both.select(*spec.keys, kind.alias("diff_type"), *(F.col(f"{s}.{v}").alias(f"{n}_{v}") for s, n in (("old", "a"), ("new", "b")) for v in spec.values))


def invert_bags(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """The change that undoes it."""
    return changes.select(*spec.keys, F.col("new").alias("old"), F.col("old").alias("new"))


def bag_edits(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """``keys, values, is_delete``: all rows that each changed key then has."""
    rows = changes.select(*spec.keys, F.explode_outer("new").alias("__v"))
    return rows.select(*spec.keys, *(F.col(f"__v.{v}").alias(v) for v in spec.values), F.col("__v").isNull().alias("is_delete"))


def apply_bags(base: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    from lamina.operators.edits import apply_edits

    return apply_edits(base, bag_edits(changes, spec), spec)


def apply_diff(base: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    from lamina.operators.edits import apply_edits

    return apply_edits(base, as_edits(changes, spec), spec)
