"""Shared plumbing of the corpus operators: shared-folder tables, row keys, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.shared import discard, drop_path, materialize, new_path, scratch

#: Rows without an id sort after every row that has one.
NO_ID = 2**63 - 1


def order_key(doc_id: Column | str) -> Column:
    """Documents without an id come last in every order by id."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(NO_ID))


def remainder(doc_id: str, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


__all__ = ["NO_ID", "check_columns", "discard", "documents", "drop_path", "materialize", "new_path", "order_key", "remainder", "scratch"]
