"""Content-defined chunks, their addresses and the tree above them.

Whether a chunk closes after an entry depends on the entry alone, so chunk numbers are
running counts of closing entries, and equal contents make equal chunks and an equal
root whatever the order of edits or the partitions.  Rules that count from the last cut
(clamps, the rolling hash, masks by size) run range by range, see ``sequential``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.functions import fnv
from lamina.model import TableSpec
from lamina.operators import sequential
from lamina.operators.ranges import running
from lamina.sources.shared import discard, materialize


def partition(df: DataFrame, keys: list[str], closes: Column, name: str = "chunk", ties: Sequence[Column] = ()) -> DataFrame:
    """df with the number of each row's chunk: the closing rows before it."""
    return running(df, keys, None, ties, **{name: closes.cast("int")})


def entries(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.select("*", E.entry(*spec.columns).alias("entry"))


def closing(spec: TableSpec, bits: int) -> Column:
    """The boundary test for keys of any types and number: on the address of the key."""
    return fnv.address_boundary(E.address(E.entry(*spec.keys)), bits)


def leaf_chunks(df: DataFrame, spec: TableSpec, bits: int, closes: Column | None = None) -> DataFrame:
    """``chunk, n, first_key, last_key, address``: a row for each leaf; keys are structs.  Rows
    of one key are in the order of their entries, so leaves depend on content alone."""
    rows = entries(partition(df, list(spec.keys), closes if closes is not None else closing(spec, bits), ties=[E.entry(*spec.columns)]), spec)
    whole = F.sort_array(F.collect_list(F.struct(spec.key().alias("k"), F.col("entry").alias("e"))))
    return (
        rows.groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.min(spec.key()).alias("first_key"), F.max(spec.key()).alias("last_key"), whole.alias("es"))
        .select("chunk", "n", "first_key", "last_key", E.address(F.array_join(F.transform("es", lambda x: x["e"]), "")).alias("address"))
    )


def parent_level(level: DataFrame, bits: int, ranges: int | None = None) -> DataFrame:
    """The level above ``(pos, n, address, last_key, first_key)``: ``pos`` numbers in order."""
    return _pack(running(level, ["pos"], ranges, chunk=fnv.address_boundary("address", bits).cast("long")))


def _pack(marked: DataFrame) -> DataFrame:
    row = F.struct("pos", F.concat_ws(":", "address", F.col("n").cast("string")).alias("e"), "address", "n")
    packed = marked.groupBy("chunk").agg(F.sort_array(F.collect_list(row)).alias("es"), F.sum("n").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    return packed.select(
        F.col("chunk").alias("pos"),
        "n",
        "first_key",
        "last_key",
        E.address(F.array_join(F.transform("es", lambda x: x["e"]), ";")).alias("address"),
        F.transform("es", lambda x: x["address"]).alias("children"),
        F.transform("es", lambda x: x["n"]).alias("child_n"),
    )


def tree(df: DataFrame, spec: TableSpec, bits: int, closes: Column | None = None) -> list[DataFrame]:
    """The levels, leaves first, until one node is left.  Each level is some 2**bits times
    smaller than the one below; a level whose entries all close would not shrink, and is
    packed into one node.  Empty tables have one leaf over nothing."""
    leaves = materialize(
        leaf_chunks(df, spec, bits, closes).select(
            F.col("chunk").alias("pos"), "n", "first_key", "last_key", "address", F.lit(None).cast("array<string>").alias("children"), F.lit(None).cast("array<long>").alias("child_n")
        ),
        "level",
    )
    return [leaves, *levels_above(leaves, bits)]


#: Nodes of a level that one task numbers.
PER_TASK = 100_000


def levels_above(level: DataFrame, bits: int, size: int | None = None) -> list[DataFrame]:
    """The written levels above a written one (of ``size`` nodes, if that is known), up to
    the root."""
    size, out = level.count() if size is None else size, []
    while size > 1:
        up = materialize(parent_level(level, bits, -(-size // PER_TASK)), "level")
        new = up.count()
        if new >= size:
            discard(up)
            up, new = materialize(_pack(level.withColumn("chunk", F.lit(0).cast("long"))), "level"), 1
        out.append(up)
        level, size = up, new
    return out


EMPTY_ROOT = hashlib.sha256(b"").hexdigest()[: E.ADDRESS_HEX]


def root_address(levels: list[DataFrame]) -> str:
    row = levels[-1].select("address").first()
    return row.address if row else EMPTY_ROOT


def all_addresses(levels: list[DataFrame]) -> DataFrame:
    """``level, address`` of every node."""
    out = None
    for i, lv in enumerate(levels):
        part = lv.select(F.lit(i).alias("level"), "address")
        out = part if out is None else out.unionByName(part)
    return out


def edges(levels: list[DataFrame]) -> DataFrame:
    """``parent, child`` of the tree."""
    out = None
    for lv in levels[1:]:
        part = lv.select(F.col("address").alias("parent"), F.explode("children").alias("child"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else levels[0].select(F.col("address").alias("parent"), F.col("address").alias("child")).where(F.lit(False))


def inspect(levels: list[DataFrame]) -> DataFrame:
    """Every node from the root down: ``depth, pos, address, entries, first_key, last_key,
    children``.  One row a node, in breadth-first order when sorted by depth and pos."""
    top, out = len(levels) - 1, None
    for i, lv in enumerate(levels):
        part = lv.select(F.lit(top - i).alias("depth"), "pos", "address", F.col("n").alias("entries"), "first_key", "last_key", F.coalesce(F.size("children"), F.lit(0)).alias("children"))
        out = part if out is None else out.unionByName(part)
    return out


def summary(levels: list[DataFrame]) -> DataFrame:
    """One row ``root, entries, height, nodes``."""
    return inspect(levels).agg(
        F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("address"))), F.lit(EMPTY_ROOT)).alias("root"),
        F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("entries"))), F.lit(0)).alias("entries"),
        F.lit(len(levels)).alias("height"),
        F.count(F.lit(1)).alias("nodes"),
    )


def find_path(levels: list[DataFrame], spec: TableSpec, key: tuple) -> DataFrame:
    """The nodes that a search for the key reads: of each level the first that ends at or
    after it.  Filters on chunk metadata; no data is read."""
    wanted = F.struct(*(F.lit(k).alias(n) for k, n in zip(key, spec.keys)))
    nodes = inspect(levels).where(F.col("last_key") >= wanted)
    return nodes.groupBy("depth").agg(F.min_by(F.struct("pos", "address"), "pos").alias("x")).select("depth", "x.pos", "x.address")


def nth_entry_chunk(level: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The leaf that holds the n-th entry (from 0) and the entry's place in it, by the
    counts of the leaves alone."""
    sized = subtree_counts(level, order)
    before = F.col("prefix_count") - F.col("n")
    return sized.where((before <= n) & (F.col("prefix_count") > n)).select(order, "address", (F.lit(n) - before).alias("offset"))


def changed_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Addresses that b's chunks have and a's have not."""
    return b.select("address").distinct().join(a.select("address"), "address", "left_anti")


def subtree_counts(level: DataFrame, order: str = "chunk") -> DataFrame:
    """Each chunk's entries and the prefix sum through it."""
    return running(level, [order], before=F.col("n")).withColumn("prefix_count", F.col("before") + F.col("n")).drop("before")


def size_stats(level: DataFrame, column: str = "n") -> DataFrame:
    """Distribution of chunk sizes: exact nearest-rank percentiles."""
    c = F.col(column)
    return level.agg(
        F.count(c).alias("chunks"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("sd"),
        *(F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {column}) AS BIGINT)").alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))),
        F.min(c).alias("smallest"),
        F.max(c).alias("largest"),
    )


def clamped(df: DataFrame, keys: list[str], closes: Column, least: int, most: int | None, weight: Column | None = None) -> DataFrame:
    """``keys, chunk`` of chunks of ``least`` to ``most`` rows: earlier boundaries do not count,
    and a full chunk closes anyhow.  With a ``weight`` it closes after its row of smallest
    weight (the first of equal ones), so the forced cut too depends on content."""
    marks = [closes.alias("closes")] + ([weight.cast("long").alias("weight")] if weight is not None else [])
    return sequential.chunk_by(df.select(*keys, *marks), keys, sequential.clamp(least, most, weight is not None))


def second_hash(key: Column | str) -> Column:
    """The hash that places forced cuts."""
    return fnv.key_hash(key, seed=b"h2:")  # fixed value: the seed


def rolling_table(seed: bytes = b"", bits: int = 32) -> list[int]:
    """256 words for a rolling hash, from a rule: the digests of seed and the byte's number in
    decimal digits.  Other tables can be given wherever one is used."""
    return fnv.word_table(seed, bits)


#: Fixed values of the production splitter: bytes hashed, least and greatest chunk size, bits that must be set at first.
WINDOW, LEAST, MOST, FIRST_BITS = 67, 512, 16384, 15


def level_salt(level: int) -> int:
    """The byte that is laid over every byte of a tree level, so that levels cut apart."""
    return hashlib.sha512(bytes([level & 255])).digest()[0]


def rolling_rule(level: int = 0, table: list[int] | None = None, window: int = WINDOW, least: int = LEAST, most: int = MOST, first_bits: int = FIRST_BITS) -> sequential.Rule:
    """Cuts by a cyclic-polynomial hash of the last ``window`` bytes.

    A byte cuts if the low bits of its hash are all set: ``first_bits`` of them in a chunk's
    first KiB and one less in each that follows, so a cut is certain where none are left.
    Bytes are salted by the tree level.  Entries are not split."""
    if least < window:
        raise ValueError("a chunk is at least a window")
    words = np.array(table or rolling_table(), np.uint32)[np.arange(256) ^ level_salt(level)]

    def test(bits: int) -> Callable[[np.ndarray], np.ndarray]:
        mask = np.uint32((1 << bits) - 1)
        return lambda h: h & mask == mask

    return sequential.by_size(least, most, lambda raw: sequential.cyclic_hashes(raw, words, window), [(k << 10, test(first_bits - k)) for k in range(first_bits + 1)])


def gear_rule(least: int, target: int, most: int, strict: int, loose: int, table: list[int] | None = None) -> sequential.Rule:
    """Cuts where the top bits of a gear hash are zero: ``strict`` of them below the
    ``target`` size, ``loose`` from there on."""
    if least < 64:
        raise ValueError("a chunk is at least 64 bytes")
    words = np.array(table or rolling_table(b"gear", 64), np.uint64)
    tests = [(size, lambda h, shift=np.uint64(64 - bits): h >> shift == 0) for size, bits in ((0, strict), (target, loose))]
    return sequential.by_size(least, most, lambda raw: sequential.gear_hashes(raw, words), tests)


def masked(df: DataFrame, keys: list[str], size: Column, mix: Column, least: int, target: int, most: int, strict: int, loose: int) -> DataFrame:
    """``keys, chunk`` by a mask on a number for each key (its first word, or its words'
    exclusive or): ``strict`` low bits zero below the ``target`` size in bytes, ``loose`` above."""

    def rule(rows) -> list[int]:
        upto = np.cumsum(rows.column("size").to_numpy())
        number = rows.column("mix").to_numpy()
        zero = {b: np.flatnonzero(number & ((1 << b) - 1) == 0) for b in (strict, loose)}
        ends: list[int] = []
        at = 0

        def first(bits: int, low: int, high: int) -> int | None:
            """The first row that ends between the sizes and meets the mask."""
            k = int(np.searchsorted(zero[bits], np.searchsorted(upto, at + low)))
            return int(zero[bits][k]) if k < len(zero[bits]) and upto[zero[bits][k]] < at + high else None

        while True:
            row = first(strict, least, target)
            if row is None:
                row = first(loose, max(least, target), most)
            if row is None:
                row = int(np.searchsorted(upto, at + most))
            if row >= len(upto):
                return ends
            ends.append(row + 1)
            at = int(upto[row])

    return sequential.chunk_by(df.select(*keys, size.cast("long").alias("size"), mix.cast("long").alias("mix")), keys, rule)


def rolling_chunks(df: DataFrame, spec: TableSpec, level: int = 0, table: list[int] | None = None, rule: sequential.Rule | None = None) -> DataFrame:
    """``keys, chunk`` by the rolling hash (or another rule on bytes) over canonical entries."""
    rows = df.select(*spec.keys, E.entry(*spec.columns).cast("binary").alias("entry"))
    return sequential.chunk_by(rows, list(spec.keys), rule or rolling_rule(level, table))


def stream_ends(data: bytes, rule: sequential.Rule, entry_size: int = 1) -> list[int]:
    """End offsets of closed chunks of a byte stream of equal entries."""
    import pyarrow as pa

    entries = [data[i : i + entry_size] for i in range(0, len(data), entry_size)]
    return [min(e * entry_size, len(data)) for e in rule(pa.table({"entry": pa.array(entries, pa.binary())}))]


def counter_stream(n: int) -> bytes:
    """n bytes that look random, the same everywhere: digests of a running 4-byte number."""
    return b"".join(hashlib.sha256(i.to_bytes(4, "little")).digest() for i in range(-(-n // 32)))[:n]


def plain_cuts(data: bytes, window: int = 48, bits: int = 6, table: list[int] | None = None) -> list[int]:
    """Places at which the hash of the bytes up to there ends in ``bits`` zeros, from the
    first whole window on: no sizes, no salt."""
    found = sequential.cyclic_hashes(np.frombuffer(data, np.uint8), np.array(table or rolling_table(), np.uint32), window)
    return (np.flatnonzero(found[window:] & np.uint32((1 << bits) - 1) == 0) + window).tolist()


def healing(data: bytes, at: int, rule: sequential.Rule) -> tuple[int | None, float]:
    """After a byte is inserted at ``at``: distance to where boundaries agree for good (None:
    never), and the share of later boundaries that came back."""
    was = [e for e in stream_ends(data, rule) if e > at]
    now = {e - 1 for e in stream_ends(data[:at] + b"Z" + data[at:], rule) if e - 1 > at}
    if not was:
        return None, 1.0
    good = len(was)
    while good and was[good - 1] in now:
        good -= 1
    return (was[good] - at if good < len(was) else None), len(now & set(was)) / len(was)
