"""Edit logs: compaction, overlay on a snapshot, replay on another base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import TableSpec


def compact(edits: DataFrame, spec: TableSpec, order: str = "seq") -> DataFrame:
    """The last edit of each key: ``keys, values, is_delete``.

    An aggregation, so each map task sends one row a key however often the key was
    edited.  Ties in ``order`` go to the greater value, a delete before a put.
    """
    last = F.max_by(F.struct(*spec.values, "is_delete"), F.struct(F.col(order), ~F.col("is_delete"), *spec.values)).alias("e")
    return edits.groupBy(*spec.keys).agg(last).select(*spec.keys, "e.*")


def apply_edits(base: DataFrame, edits: DataFrame, spec: TableSpec) -> DataFrame:
    """base with compacted edits laid over it: an edited key has the rows that are put, be
    they several.  Deleting what is not there does nothing."""
    a, e = spec.select(base).alias("a"), edits
    kept = a.join(e.select(*spec.keys).alias("e"), [F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}")) for k in spec.keys], "left_anti")
    return kept.unionByName(e.where(~F.col("is_delete")).select(*spec.columns))


def overlay_get(base: DataFrame, edits: DataFrame, spec: TableSpec, keys: DataFrame) -> DataFrame:
    """For each asked key what a reader of base under the edits sees: ``keys, found, values``."""
    e = edits.select(*(F.col(k).alias(f"e_{k}") for k in spec.keys), *(F.col(v).alias(f"e_{v}") for v in spec.values), F.col("is_delete").alias("e_gone"))
    b = base.select(*(F.col(k).alias(f"b_{k}") for k in spec.keys), *(F.col(v).alias(f"b_{v}") for v in spec.values), F.lit(True).alias("b_there"))
    asked = keys.select(*spec.keys)
    out = asked.join(b, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in spec.keys], "left")
    out = out.join(e, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in spec.keys], "left")
    edited = F.col("e_gone").isNotNull()
    found = F.when(edited, ~F.col("e_gone")).otherwise(F.col("b_there").isNotNull())
    pick = [F.when(edited, F.when(~F.col("e_gone"), F.col(f"e_{v}"))).otherwise(F.col(f"b_{v}")).alias(v) for v in spec.values]
    return out.select(*spec.keys, found.alias("found"), *pick)


def rebase(edits: DataFrame, new_base: DataFrame, spec: TableSpec, order: str = "seq") -> DataFrame:
    """The pending edits replayed on a newer base."""
    return apply_edits(new_base, compact(edits, spec, order), spec)


def as_of(edits: DataFrame, spec: TableSpec, at, order: str = "seq", version: str | None = None) -> DataFrame:
    """The table after all edits up to and with version ``at``: last write wins, then
    deletes go.  No snapshot between is built."""
    log = edits.where(F.col(version or order) <= F.lit(at))
    return compact(log, spec, order).where(~F.col("is_delete")).select(*spec.columns)


def mutate(base: DataFrame, puts: DataFrame, deletes: DataFrame, spec: TableSpec) -> DataFrame:
    """base with rows put and keys deleted; a key in both is put."""
    gone = deletes.select(*spec.keys).distinct().join(puts.select(*spec.keys), list(spec.keys), "left_anti")
    nothing = [F.lit(None).cast(puts.schema[v].dataType).alias(v) for v in spec.values]
    edits = puts.select(*spec.columns, F.lit(False).alias("is_delete")).unionByName(gone.select(*spec.keys, *nothing, F.lit(True).alias("is_delete")))
    return apply_edits(base, edits, spec)
