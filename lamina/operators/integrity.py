"""Reachability, garbage collection and checks over chunk tables.

A chunk table is ``hash string, level int, data string``; the chunk graph is ``parent,
child``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.sources.shared import discard, materialize, new_path


def dedup(chunks: DataFrame) -> DataFrame:
    """One row for each content address."""
    return chunks.dropDuplicates(["hash"])


def missing(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks that the store lacks: what a write or a pull has to add."""
    return dedup(chunks).join(store.select("hash"), "hash", "left_anti")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``hash`` of the roots and of all below them, however deep.  A step a level: the new
    ones are appended to a table in the shared folder.  A hash without edges, missing
    ones too, is kept and not expanded; cycles end."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "reach")
    below = edges.select(F.col("parent").alias("hash"), "child")
    front = materialize(roots.select("hash").distinct(), "front")
    while True:
        front.write.mode("append").parquet(path)
        seen = spark.read.schema(front.schema).parquet(path)
        if front.isEmpty():
            return seen
        found = front.join(below, "hash").select(F.col("child").alias("hash")).distinct().join(seen, "hash", "left_anti")
        old, front = front, materialize(found, "front")
        discard(old)


def unknown_below(edges: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """``hash`` of what has to be copied so that all below the root is there: from the root
    down, a known chunk is not expanded.  Whoever stores a chunk stores its subtree first,
    so a known one's is there."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], "hash string").join(known.select("hash"), "hash", "left_anti")
    fresh = edges.join(known.select(F.col("hash").alias("parent")), "parent", "left_anti").join(known.select(F.col("hash").alias("child")), "child", "left_anti")
    return reachable(fresh.select("parent", "child"), start)


def keep_set(edges: DataFrame, *claims: DataFrame) -> DataFrame:
    """What several claimants reach together."""
    roots = claims[0].select("hash")
    for c in claims[1:]:
        roots = roots.unionByName(c.select("hash"))
    return reachable(edges, roots)


def sweep(store: DataFrame, keep: DataFrame) -> DataFrame:
    """The store without what is not kept."""
    return store.join(keep.select("hash"), "hash", "left_semi")


def gc_result(store: DataFrame, keep: DataFrame) -> DataFrame:
    """One row ``reachable, swept``."""
    marked = store.join(keep.select("hash").distinct().withColumn("k", F.lit(1)), "hash", "left")
    return marked.agg(F.count("k").alias("reachable"), F.count(F.when(F.col("k").isNull(), 1)).alias("swept"))


def verify(store: DataFrame, edges: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``hash, problem``: contents that do not hash to their address, children that are
    missing, children whose level is not one below their parent's."""
    wrong = store.where(E.address("data", algorithm) != F.col("hash")).select("hash", F.lit("mismatch").alias("problem"))
    lost = edges.select(F.col("child").alias("hash")).distinct().join(store.select("hash"), "hash", "left_anti").select("hash", F.lit("missing").alias("problem"))
    p, c = store.select(F.col("hash").alias("parent"), F.col("level").alias("p")), store.select(F.col("hash").alias("child"), F.col("level").alias("c"))
    skewed = edges.join(p, "parent").join(c, "child").where(F.col("p") != F.col("c") + 1).select(F.col("child").alias("hash"), F.lit("level").alias("problem"))
    return wrong.unionByName(lost).unionByName(skewed).distinct()


def checked(store: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """The store, failing on the first row whose content is not that of its address."""
    good = F.assert_true(E.address("data", algorithm) == F.col("hash"), F.concat(F.lit("corrupt chunk "), F.col("hash")))
    return store.where(good.isNull())
