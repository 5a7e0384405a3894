"""A content-addressed dictionary of byte keys: its compressed trie and its pages.

The dictionary is a table ``key binary, id long``; lookups, ordered reads and differences
are filters, sorts and joins on it.  The trie exists for its addresses.  It is cut into
parts of bounded size, whose subtrees are built in parallel; the driver then joins at
most 256 edges a cut.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.chunks import clamped
from lamina.operators.ranges import Ranges
from lamina.sources.shared import materialize

Node = tuple[bytes, bytes, bytes]  # path, address, serialized


def _sized(b: bytes) -> bytes:
    return len(b).to_bytes(4, "big") + b


def leaf_bytes(suffix: bytes, ident: int) -> bytes:
    return b"L" + _sized(suffix) + ident.to_bytes(8, "big")


def inner_bytes(prefix: bytes, ident: int | None, edges: list[tuple[int, bytes]]) -> bytes:
    end = b"\0" if ident is None else b"\1" + ident.to_bytes(8, "big")
    return b"I" + _sized(prefix) + end + len(edges).to_bytes(2, "big") + b"".join(bytes([b]) + a for b, a in edges)


def node_address(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:20]


def _common(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def subtree(items: list[tuple[bytes, int]], at: int, out: list[Node]) -> bytes:
    """The address of the trie of sorted items, of whose keys ``at`` bytes are used up; its
    nodes are added to ``out``.  Works with a stack, so key length does not bound it."""
    done: dict[tuple[int, int], bytes] = {}
    stack: list[tuple[int, int, int, bool]] = [(0, len(items), at, False)]
    while stack:
        lo, hi, start, ready = stack.pop()
        if hi - lo == 1:
            key, ident = items[lo]
            data = leaf_bytes(key[start:], ident)
            kids: list[tuple[int, bytes]] = []
        else:
            end = start + _common(items[lo][0][start:], items[hi - 1][0][start:])
            own = items[lo][1] if len(items[lo][0]) == end else None
            first = lo + (own is not None)
            groups = []
            i = first
            while i < hi:
                b, j = items[i][0][end], i
                while j < hi and items[j][0][end] == b:
                    j += 1
                groups.append((b, i, j))
                i = j
            if not ready:
                stack.append((lo, hi, start, True))
                stack += [(i, j, end + 1, False) for _, i, j in groups]
                continue
            kids = [(b, done[i, j]) for b, i, j in groups]
            data = inner_bytes(items[lo][0][start:end], own, kids)
        done[lo, hi] = node_address(data)
        out.append((items[lo][0][:start], done[lo, hi], data))
    return done[0, len(items)]


def _under(prefixes: list[bytes]) -> Column:
    """The number of the prefix that the key begins with (none begins with another); null
    if there is none."""
    at = Ranges.of(["key"], [T.BinaryType()], [(p,) for p in prefixes[1:]]).number()
    return F.when(F.startswith("key", F.get(F.array(*(F.lit(p) for p in prefixes)), at)), at)


def _plan(rows: DataFrame, total: int, part_rows: int) -> tuple[list[bytes], list[tuple[bytes, bytes, int | None, list[bytes]]]]:
    """Prefixes of parts of at most ``part_rows`` keys, in order, and the nodes above them:
    used-up bytes, further common bytes, own id, children's prefixes.  Two jobs for each
    level of groups that are too large, however many these are."""
    parts: list[bytes] = []
    upper: list[tuple[bytes, bytes, int | None, list[bytes]]] = []
    large = [b""] if total > part_rows else []
    if not large:
        return [b""], []
    while large:
        inside = rows.withColumn("g", _under(large)).where("g is not null")
        span = {r.g: (bytes(r.low), bytes(r.high)) for r in inside.groupBy("g").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        ends = [_common(*span[g]) for g in range(len(large))]
        end = F.get(F.array(*(F.lit(e) for e in ends)), F.col("g"))
        counts = inside.groupBy("g", F.substring(F.col("key"), end + 1, F.lit(1)).alias("b"))
        found = counts.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).collect()
        new: list[bytes] = []
        for g, used in enumerate(large):
            shared, own, children = span[g][0][: ends[g]], None, []
            for r in sorted((r for r in found if r.g == g), key=lambda r: bytes(r.b)):
                if not len(r.b):
                    own = r.id
                    continue
                children.append(shared + bytes(r.b))
                (new if r.n > part_rows else parts).append(children[-1])
            upper.append((used, shared[len(used) :], own, children))
        large = sorted(new)
    return sorted(parts), upper


def build(entries: DataFrame, key: str = "key", ident: str = "id", part_rows: int = 50_000) -> tuple[DataFrame, bytes]:
    """``path, address, data`` of every node, and the root's address.

    Keys are unique and not null; ids are not negative.  An empty dictionary is one
    inner node without edges.
    """
    spark, schema = entries.sparkSession, "path binary, address binary, data binary"
    rows = entries.select(F.col(key).cast("binary").alias("key"), F.col(ident).cast("long").alias("id")).where("key is not null")
    total = rows.count()
    if not total:
        data = inner_bytes(b"", None, [])
        return spark.createDataFrame([(b"", node_address(data), data)], schema), node_address(data)
    starts, upper = _plan(rows, total, part_rows)

    def run(key_: tuple, table: pa.Table) -> pa.Table:
        items = sorted(zip(table.column("key").to_pylist(), table.column("id").to_pylist()))
        out: list[Node] = []
        subtree(items, len(starts[key_[0].as_py()]), out)
        return pa.table({n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("path", "address", "data"))})

    nodes = materialize(rows.withColumn("part", _under(starts)).where("part is not null").groupBy("part").applyInArrow(run, schema), "radix") if starts else spark.createDataFrame([], schema)
    tops = {bytes(r.path): bytes(r.address) for r in nodes.where(F.col("path").isin([bytearray(s) for s in starts])).select("path", "address").collect()}
    above: list[Node] = []
    for used, prefix, own, children in reversed(upper):
        data = inner_bytes(prefix, own, [(c[-1], tops[c]) for c in children])
        tops[used] = node_address(data)
        above.append((used, tops[used], data))
    if above:
        nodes = nodes.unionByName(spark.createDataFrame(above, schema))
    return nodes, tops[b""]


def entries_of(nodes: DataFrame) -> DataFrame:
    """``key, id`` of the dictionary whose nodes these are, read from the nodes' bytes."""

    def number(at: Column | int, width: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("data"), at if isinstance(at, Column) else F.lit(at), F.lit(width))), 16, 10).cast("long")

    n = number(2, 4).cast("int")
    leaf = F.substring("data", 1, 1) == F.lit(b"L")
    has = leaf | (F.substring(F.col("data"), n + 6, F.lit(1)) == F.lit(b"\1"))
    ident = F.when(leaf, number(n + 6, 8)).otherwise(number(n + 7, 8))
    return nodes.where(has).select(F.concat("path", F.substring(F.col("data"), F.lit(6), n)).alias("key"), ident.alias("id"))


def insert(entries: DataFrame, more: DataFrame, key: str = "key", ident: str = "id") -> DataFrame:
    """The dictionary with further entries; of a key in both, the new id.  The trie of the
    result is the same whatever order entries came in, so only new nodes need be stored."""
    return entries.join(more.select(key), key, "left_anti").select(key, ident).unionByName(more.select(key, ident))


def changed_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``address, side`` of nodes that only one of two dictionaries has: ``a`` or ``b``."""
    x, y = a.select("address").distinct(), b.select("address").distinct()
    return x.join(y, "address", "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, "address", "left_anti").withColumn("side", F.lit("b")))


def stored_bytes(nodes: DataFrame) -> DataFrame:
    """One row ``nodes, bytes`` of what a store has to hold: each address once."""
    once = nodes.groupBy("address").agg(F.max(F.length("data")).alias("n"))
    return once.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("bytes"))


def lookup(entries: DataFrame, wanted: bytes, key: str = "key") -> DataFrame:
    return entries.where(F.col(key) == F.lit(wanted))


def page_boundary(address: Column | str, bits: int) -> Column:
    """A page closes after a node whose address begins with 8 bytes that end in zero bits."""
    digits = F.hex(address)
    return F.conv(F.substring(digits, 9, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1)) == 0


def pages(nodes: DataFrame, bits: int = 5, least: int = 8, most: int = 128) -> DataFrame:
    """``path, address, page``: nodes in depth-first order cut into pages of ``least`` to
    ``most``."""
    cut = clamped(nodes.select("path", "address"), ["path"], page_boundary("address", bits), least, most)
    return nodes.select("path", "address").join(cut.withColumnRenamed("chunk", "page"), "path")
