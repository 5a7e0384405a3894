"""Summaries of measurements, and stores or versions held side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def latency_summary(df: DataFrame, value: str, by: list[str], per_second: int = 1_000_000) -> DataFrame:
    """``by, n, mean, p50, p90, p95, p99, slowest, rate``: exact nearest-rank percentiles of
    whole numbers, and how many there would be in a second one after another, where
    ``per_second`` units make a second."""
    ps = [F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}) AS BIGINT)").alias(f"p{int(p * 100)}") for p in PERCENTILES]
    rate = F.when(F.sum(value) > 0, F.count(value) * F.lit(float(per_second)) / F.sum(value)).alias("rate")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *ps, F.max(value).alias("slowest"), rate)


def compare_stores(stores: dict[str, DataFrame], timings: DataFrame | None = None) -> DataFrame:
    """``store, chunks, bytes, same`` of chunk tables: ``same`` says whether a store holds just
    the chunks that the first does, by number, and by the sum of their hashes.  With
    ``timings`` (``store, took``) also their summary."""
    out = None
    for name, df in stores.items():
        each = df.groupBy("hash").agg(F.max(F.octet_length("data")).alias("size"))
        part = each.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("mark"))
        part = part.select(F.lit(name).alias("store"), "*")
        out = part if out is None else out.unionByName(part)
    first = out.where(F.col("store") == next(iter(stores))).select(F.col("chunks").alias("c"), F.col("mark").alias("m"))
    both = out.crossJoin(F.broadcast(first))  # one row
    both = both.select("store", "chunks", "bytes", ((F.col("chunks") == F.col("c")) & F.col("mark").eqNullSafe(F.col("m"))).alias("same"))
    return both if timings is None else both.join(latency_summary(timings, "took", ["store"]), "store", "left")
