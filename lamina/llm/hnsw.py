"""Nearest neighbours by a hierarchical navigable small-world graph for each shard.

Equal vectors are one node.  A shard's graph is stored as flat neighbour arrays beside
its vectors.  Every query is searched in every shard and the shards' results merged;
queries go out in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import check_columns, materialize


class Graph:
    """A graph over the rows of ``vectors``.  ``links[l]`` holds ``width`` neighbours (-1:
    none) of each row on layer l; upper layers are mostly -1 and have half the width."""

    def __init__(self, vectors: np.ndarray, m: int = 12, width: int = 80, seed: int = 7):
        self._hold(vectors)
        self.m, self.width = m, width
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(1 - draw) / math.log(m)).astype(int), 8)
        top = int(self.level.max(initial=0))
        self.links = [np.full((n, 2 * m if lay == 0 else m), -1, np.int32) for lay in range(top + 1)]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    @classmethod
    def stored(cls, vectors: np.ndarray, links: list[np.ndarray], entry: int) -> Graph:
        self = cls.__new__(cls)
        self._hold(vectors)
        self.links, self.entry = links, entry
        return self

    def _hold(self, vectors: np.ndarray) -> None:
        """Vectors in double precision over a power of two, so that squares do not overflow."""
        x = np.asarray(vectors, np.float64)
        self.power = int(np.frexp(np.abs(x).max(initial=0.0))[1])
        self.x = np.ldexp(x, -self.power)

    def _near(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances, of differences: they do not cancel far from the origin."""
        apart = self.x[rows] - q
        return np.einsum("ij,ij->i", apart, apart)

    def _layer(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found from the starts, nearest first."""
        links = self.links[layer]
        seen = np.zeros(len(self.x), bool)
        seen[[i for _, i in starts]] = True
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, i) for d, i in starts]
        heapq.heapify(best)
        push, pop, swap = heapq.heappush, heapq.heappop, heapq.heapreplace
        while open_:
            d, i = pop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            rows = links[i]
            rows = rows[rows >= 0]
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            seen[rows] = True
            for e, j in zip(self._near(q, rows).tolist(), rows.tolist()):
                if len(best) < width:
                    push(best, (-e, j))
                    push(open_, (e, j))
                elif e < -best[0][0]:
                    swap(best, (-e, j))
                    push(open_, (e, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, q: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to any chosen before; the nearest
        of the rest fill up."""
        if len(found) <= most:
            return [i for _, i in found]
        rows = np.array([i for _, i in found])
        x = self.x[rows] - q
        own = np.einsum("ij,ij->i", x, x)
        apart = own[:, None] + own - 2 * (x @ x.T)
        kept: list[int] = []
        closest = np.full(len(rows), np.inf)
        for k in range(len(rows)):
            if own[k] < closest[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                closest = np.minimum(closest, apart[k])
        chosen = set(kept)
        for k in range(len(rows)):
            if len(kept) == most:
                break
            if k not in chosen:
                kept.append(k)
        return rows[kept].tolist()

    def _insert(self, i: int) -> None:
        q, level = self.x[i], int(self.level[i])
        now = [(float(self._near(q, np.array([self.entry]))[0]), self.entry)]
        top = int(self.level[self.entry])
        for lay in range(top, level, -1):
            now = self._layer(q, now, 1, lay)
        for lay in range(min(top, level), -1, -1):
            now = self._layer(q, now, self.width, lay)
            links = self.links[lay]
            chosen = self._choose(q, now, self.m)
            links[i, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    around = np.append(row, np.int32(i))
                    d = self._near(self.x[j], around)
                    order = np.argsort(d, kind="stable")
                    keep = self._choose(self.x[j], list(zip(d[order].tolist(), around[order].tolist())), len(row))
                    row[:] = -1
                    row[: len(keep)] = keep
        if level > top:
            self.entry = i

    def found(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that are found and their distances."""
        if not len(self.x):
            return np.zeros(0, np.int64), np.zeros(0)
        q = np.ldexp(np.asarray(q, np.float64), -self.power)
        now = [(float(self._near(q, np.array([self.entry]))[0]), self.entry)]
        for lay in range(len(self.links) - 1, 0, -1):
            now = self._layer(q, now, 1, lay)
        rows = np.array([i for _, i in self._layer(q, now, width, 0)], np.int64)
        return rows, np.ldexp(np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1)), self.power)

    def search(self, q: np.ndarray, k: int, width: int) -> list[int]:
        rows, far = self.found(q, max(width, k))
        return rows[np.argsort(far, kind="stable")[:k]].tolist()


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v array<double>`` of rows with an id and a vector that is not null, empty or
    zero and holds no null and no non-finite component."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )


INDEX = "n int, dim int, entry int, vectors binary, ids array<array<long>>, layers int, links binary"


def build_index(nodes: DataFrame, shard_rows: int, m: int, width: int, count: int) -> DataFrame:
    """A row for each shard of ``nodes`` (v, ids): one graph over at most ``shard_rows``
    vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            vs, ids = held.pop(dim)
            x = np.array(vs, np.float64)
            order = np.random.default_rng(11).permutation(np.lexsort(x.T[::-1]))  # the same whatever order rows came in
            x, ids = x[order], [ids[i] for i in order]
            g = Graph(x, m, width)
            links = b"".join(a.tobytes() for a in g.links)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int32()), pa.array([dim], pa.int32()), pa.array([g.entry], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([len(g.links)], pa.int32()), pa.array([links], pa.binary())],
                ["n", "dim", "entry", "vectors", "ids", "layers", "links"],
            )

        for batch in batches:
            for v, ids in zip(batch.column(0), batch.column(1).to_pylist()):
                v = v.values.to_numpy()
                vs, all_ids = held.setdefault(len(v), ([], []))
                vs.append(v)
                all_ids.append(ids)
                if len(vs) >= shard_rows:
                    yield close(len(v))
        for dim in sorted(held):
            yield close(dim)

    parts = max(1, -(-count * 5 // (shard_rows * 4)))
    return nodes.repartition(parts, F.xxhash64("v")).mapInArrow(run, INDEX)


def _search(index: DataFrame, queries: pa.Table, m: int, k: int, width: int) -> DataFrame:
    """``q, ids, score``: each shard's k nearest nodes to each query (q, v) of a block, which
    is broadcast as a matrix for each dimension."""
    lists = queries.column("v").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, flat, at = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    number, by_dim = queries.column("q").to_numpy(), {}
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        by_dim[dim] = (number[own], flat[at[own][:, None] + np.arange(dim)])
    shared = index.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                n, dim = row["n"], row["dim"]
                x = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
                flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
                for lay in range(row["layers"]):
                    w = 2 * m if lay == 0 else m
                    links.append(flat[at : at + n * w].reshape(n, w))
                    at += n * w
                g = Graph.stored(x, links, row["entry"])
                out: list[tuple[int, list[int], float]] = []
                for q, v in zip(*by_dim_of(shared.value, dim)):
                    found, far = g.found(v, max(width, k))
                    best = sorted((d, row["ids"][i]) for i, d in zip(found.tolist(), far.tolist()))
                    out += [(q, ids, d) for d, ids in best[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.float64())],
                    ["q", "ids", "score"],
                )

    def by_dim_of(value: dict, dim: int) -> tuple[list[int], np.ndarray]:
        ids, matrix = value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        return ids.tolist(), matrix

    return index.mapInArrow(run, "q long, ids array<long>, score double")


def nearest(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, shard_rows: int = 8192, m: int = 12, width: int = 80, search_width: int = 128, block: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, the ``k``
    nearest of all other rows that the graphs find; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part.  Vectors of another dimension are no candidates.  Rows
    equal in id and vector count once.  Of equal vectors only the k + 1 smallest ids are
    kept, all that any answer can name.  Every usable row is indexed.  Queries go out in
    blocks of ``block``, and the index is read once a block.  Other columns are not looked
    at.  An empty table gives no rows.
    """
    check_columns(rows, vec_id, vector)
    good = usable(rows, vec_id, vector)
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = good.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    index = materialize(build_index(nodes, shard_rows, m, width, nodes.count()), "index")
    asked = good.where(F.col("vec_id") % every == 0).distinct()
    distinct = asked.select("v").distinct()
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("q"), "v"), "queries")
    blocks = max(1, -(-distinct.count() // block))
    found = None
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else distinct
        got = _search(index, part.toArrow(), m, k + 1, search_width)
        best = F.row_number().over(Window.partitionBy("q").orderBy("score", F.element_at("ids", 1)))
        got = got.withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
        if blocks > 1:
            got = materialize(got, "answers")
        found = got if found is None else found.unionByName(got)
    answers = found.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("a"))
    joined = asked.withColumnRenamed("vec_id", "query_id").join(distinct.join(answers, "q").select("v", "a"), "v")
    flat = joined.select("query_id", "v", F.explode("a").alias("a")).select("query_id", "v", "a.score", F.explode("a.ids").alias("vec_id"))
    flat = flat.where("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id", "v").orderBy("score", "vec_id"))
    return flat.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
