"""Connected components of an undirected graph, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) rows -> (u, m): the smallest of u and its neighbours, pre-aggregated before the
    shuffle.  Written before it is joined: a join straight to an aggregate on its own key
    could not have a hub's rows split, as the aggregate needs them together."""
    return materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def _large_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    made.append(_least(both))
    joined = both.join(made[-1], "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    made.append(_least(down))
    rest = down.join(made[-1], "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(made[-1].where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node with an edge; root is the smallest node reachable.

    Alternating large-star and small-star rounds.  Every step is a table in the shared
    folder, deleted when the next is there; both sides of each join are such tables, so a
    hub's rows can be split.  The driver sees only a count and a checksum.  Self loops and
    repeated edges are harmless; null ends are dropped; an empty graph gives no rows.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        made = [now]
        made.append(materialize(_large_star(now, made), "stars"))
        now = materialize(_small_star(made[-1], made), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for df in made:
            discard(df)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
