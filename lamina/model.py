"""What a versioned table is: key columns, unique unless said otherwise, and value columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """Key and value columns of a snapshot.  A snapshot is a plain DataFrame."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    #: Whether a key may have several rows; stored versions refuse them otherwise.
    repeats: bool = False

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.values]

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)

    def value(self, prefix: str = "") -> Column:
        return F.struct(*(F.col(f"{prefix}{v}").alias(v) for v in self.values))

    def key(self) -> Column:
        """The whole key as one ordered value; nulls come first, as in the model."""
        return F.struct(*self.keys)

    def duplicates(self, df: DataFrame) -> DataFrame:
        """Keys that break uniqueness, with their number of rows."""
        return df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
