"""Questions about the commit graph and about changes over a history.

A commit table is ``commit_id, parents array<string>, ts long`` (more columns may
follow).  It is metadata: up to ``DRIVER_COMMITS`` rows, checked by a count, are walked
on the driver; beyond that the walk is a frontier join, a table a step.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.shared import materialize

DRIVER_COMMITS = 200_000


def _small(commits: DataFrame) -> bool:
    return commits.limit(DRIVER_COMMITS + 1).count() <= DRIVER_COMMITS


def _parents(commits: DataFrame) -> dict[str, list[str]]:
    return {r.commit_id: list(r.parents or []) for r in commits.select("commit_id", "parents").collect()}


def _ids(commits: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return commits.sparkSession.createDataFrame(rows, schema)


def _walk(parents: dict[str, list[str]], start: str) -> dict[str, int]:
    """Distance of each ancestor, the start included, by breadth first."""
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for p in parents.get(at, []):
            if p not in seen:
                seen[p] = seen[at] + 1
                queue.append(p)
    return seen


def ancestors(commits: DataFrame, start: str) -> DataFrame:
    """``commit_id, depth`` of the commit and everything behind it, over all parents."""
    if _small(commits):
        return _ids(commits, list(_walk(_parents(commits), start).items()), "commit_id string, depth int")
    edges = materialize(commits.select("commit_id", F.explode("parents").alias("parent")), "edges")
    seen = materialize(commits.where(F.col("commit_id") == start).select("commit_id", F.lit(0).alias("depth")), "walk")
    depth = 0
    while True:
        front = seen.where(F.col("depth") == depth).join(edges, "commit_id").select(F.col("parent").alias("commit_id"), F.lit(depth + 1).alias("depth")).distinct()
        seen_new = materialize(seen.unionByName(front.join(seen, "commit_id", "left_anti")), "walk")
        depth += 1
        if seen_new.where(F.col("depth") == depth).isEmpty():
            return seen_new
        seen = seen_new


def minimal_common_ancestors(commits: DataFrame, a: str, b: str) -> DataFrame:
    """Common ancestors that are no ancestor of another one.  The set is closed under
    parents, so it is enough to take off the parents of its members."""
    common = ancestors(commits, a).select("commit_id").join(ancestors(commits, b).select("commit_id"), "commit_id", "left_semi")
    behind = commits.join(common, "commit_id", "left_semi").select(F.explode("parents").alias("commit_id"))
    return common.join(behind, "commit_id", "left_anti")


def merge_base(commits: DataFrame, a: str, b: str) -> DataFrame:
    """One minimal common ancestor: the latest, ties to the greater id; no row if none."""
    found = commits.join(minimal_common_ancestors(commits, a, b), "commit_id", "left_semi")
    return found.agg(F.max_by("commit_id", F.struct("ts", "commit_id")).alias("commit_id")).where("commit_id is not null")


def sync_merge_base(commits: DataFrame, a: str, b: str) -> DataFrame:
    """The base that replication uses: of b's ancestors that are also a's, the nearest to b
    (ties to the smaller id)."""
    mine = ancestors(commits, a).select("commit_id")
    near = ancestors(commits, b).join(mine, "commit_id", "left_semi")
    return near.agg(F.min_by("commit_id", F.struct("depth", "commit_id")).alias("commit_id")).where("commit_id is not null")


def is_ancestor(commits: DataFrame, of: str, target: str) -> DataFrame:
    """One row ``reaches``: whether ``target`` is behind (or is) ``of``."""
    return ancestors(commits, of).agg(F.coalesce(F.max(F.col("commit_id") == target), F.lit(False)).alias("reaches"))


def first_parent_log(commits: DataFrame, start: str) -> DataFrame:
    """``commit_id, depth`` along first parents, the start first."""
    firsts = commits.select("commit_id", F.expr("CASE WHEN size(parents) > 0 THEN array(parents[0]) ELSE array() END").alias("parents"))
    return ancestors(firsts, start)


def changes_of_keys(log: DataFrame, keys: list[str], values: list[str], version: str, order: str, gone: str = "is_delete") -> DataFrame:
    """Versions in which a key's state changed: ``keys, version, values, is_delete``.

    A version's state of a key is its last edit there.  Writing the same value again, or
    deleting what is not there, is no change."""
    state = F.struct(F.col(gone).alias("gone"), *(F.when(~F.col(gone), F.col(v)).alias(v) for v in values))
    last = log.groupBy(*keys, version).agg(F.max_by(state, F.col(order)).alias("s"))
    before = F.lag("s").over(Window.partitionBy(*keys).orderBy(version))
    changed = last.withColumn("p", before).where(
        F.when(F.col("p").isNull(), ~F.col("s.gone")).otherwise(~F.col("s").eqNullSafe(F.col("p")))
    )
    return changed.select(*keys, version, *(F.col(f"s.{v}").alias(v) for v in values), F.col("s.gone").alias("is_delete"))


def blame(log: DataFrame, keys: list[str], values: list[str], version: str, order: str) -> DataFrame:
    """For every key that lives at the end: the version that gave it its present value,
    that is the start of the last run of it.  All keys at once, by one window."""
    changed = changes_of_keys(log, keys, values, version, order)
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(version, *values, "is_delete"), version).alias("s"))
    return last.where("not s.is_delete").select(*keys, F.col(f"s.{version}").alias("blame"), *(F.col(f"s.{v}").alias(v) for v in values))


def first_bad(versions: DataFrame, version: str, is_bad: Column) -> DataFrame:
    """The first version for which the predicate holds, given that it stays so after."""
    return versions.where(is_bad).agg(F.min(version).alias("first_bad")).where("first_bad is not null")


def bisect(path: list[str], is_bad: Callable[[str], bool]) -> str:
    """The first bad commit of a path from good to bad, by halving: the predicate, which may
    run a query, is asked a logarithmic number of times.  The good end is not asked; if
    no commit is bad the last is returned."""
    low, high = 1, len(path) - 1
    while low < high:
        mid = (low + high) // 2
        if is_bad(path[mid]):
            high = mid
        else:
            low = mid + 1
    return path[high]
