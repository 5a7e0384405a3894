"""Cuts in an ordered table whose rule counts from the last cut, made in parallel.

A rule begins afresh after every cut, so the cuts behind a known cut depend on the rows
behind it only.  The table is dealt into key ranges.  A first pass runs the rule in every
range from its first row and keeps what stays open at the range's end, one open chunk a
range.  A second pass starts every range with what the range before left open.  What
it leaves open must be what the next range was started with; where it is not, that range
runs again.  The first range starts right, so when all agree all are right.  Rules
forget where they started after a few cuts, so one range in many runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.ranges import Ranges, running
from lamina.sources.shared import materialize

#: (columns of the rows since a cut) -> ends of the chunks that these rows close.
Rule = Callable[[pa.Table], list[int]]


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _pass(dealt: DataFrame, keys: list[str], rule: Rule, opened: dict[int, bytes], rows: bool) -> DataFrame:
    """``keys, cut int, extra boolean, range int, rest binary``: with ``rows`` a row for each
    row of the ranges, whether a chunk ends after it; an extra row for a cut after a row of
    an earlier range; and for each range a row with what it leaves open and, as ``cut``,
    whether it closed a chunk."""
    shared = dealt.sparkSession.sparkContext.broadcast(opened)
    fields = [dealt.schema[k] for k in keys]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("cut", T.IntegerType()), ("extra", T.BooleanType()), ("range", T.IntegerType()), ("rest", T.BinaryType())))])
    names = schema.names
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, foreign, closed = -1, None, 0, 0

        def emit(table: pa.Table, cuts: np.ndarray, extra: bool) -> Iterator[pa.RecordBatch]:
            n = len(table)
            if n:
                more = [pa.array(cuts.astype(np.int32)), pa.array(np.full(n, extra)), pa.array(np.full(n, now, np.int32)), pa.nulls(n, pa.binary())]
                yield from pa.table([*table.columns[:width], *more], names).combine_chunks().to_batches()

        def leave() -> Iterator[pa.RecordBatch]:
            if rows:
                own = held.slice(foreign)
                yield from emit(own, np.zeros(len(own)), False)
            none = [pa.nulls(1, held.schema.field(i).type) for i in range(width)]
            yield from pa.table([*none, pa.array([closed], pa.int32()), pa.array([False]), pa.array([now], pa.int32()), pa.array([_ipc(held)], pa.binary())], names).to_batches()

        for batch in batches:
            numbers = batch.column(batch.num_columns - 1).to_numpy()
            parts = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *parts.tolist()], [*parts.tolist(), len(numbers)]):
                if a == b:
                    continue
                part = pa.Table.from_batches([batch.slice(a, b - a)]).drop_columns(["__b"])
                if numbers[a] != now:
                    if now >= 0:
                        yield from leave()
                    now, closed = int(numbers[a]), 0
                    held = _table(shared.value[now]) if now in shared.value else part.slice(0, 0)
                    foreign = len(held)
                whole = pa.concat_tables([held.cast(part.schema), part]).combine_chunks()
                ends = rule(whole)
                if ends:
                    closed = 1
                    last = ends[-1]
                    if rows:
                        cuts = np.zeros(last)
                        cuts[np.array(ends) - 1] = 1
                        outside = np.flatnonzero(cuts[:foreign])
                        yield from emit(whole.take(pa.array(outside)), np.ones(len(outside)), True)
                        yield from emit(whole.slice(min(foreign, last), max(0, last - foreign)), cuts[foreign:], False)
                    foreign = max(0, foreign - last)
                    whole = whole.slice(last)
                held = whole
        if now >= 0:
            yield from leave()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "__b").sortWithinPartitions("__b", *keys).mapInArrow(run, schema)


def chunk_by(df: DataFrame, keys: list[str], rule: Rule, ranges: int | None = None) -> DataFrame:
    """``keys, chunk``: the chunks that ``rule`` cuts the table into, in key order.  The
    columns of df that are no keys are what the rule looks at."""
    others = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *others).withColumn("__b", Ranges(df, keys, ranges).number())
    dealt = materialize(dealt, "dealt")
    first = {r.range: (bytes(r.rest), r.cut) for r in _pass(dealt, keys, rule, {}, False).collect()}  # a row a range
    order = sorted(first)
    opened: dict[int, bytes] = {}
    for a, b in zip(order, order[1:]):
        rest, cut = first[a]
        if not cut and a in opened:
            rest = _ipc(pa.concat_tables([_table(opened[a]), _table(rest)]))
        opened[b] = rest
    todo, done, left = set(order), None, {}
    while todo:
        again = dealt if len(todo) == len(order) else dealt.where(F.col("__b").isin(sorted(todo)))
        made = materialize(_pass(again, keys, rule, {r: opened[r] for r in todo if r in opened}, True), "cuts")
        left |= {r.range: bytes(r.rest) for r in made.where("rest is not null").collect()}
        kept = done.where(~F.col("range").isin(sorted(todo))) if done is not None else None
        done = made if kept is None else kept.unionByName(made)
        wrong = {b for a, b in zip(order, order[1:]) if not _table(left[a]).equals(_table(opened[b]))}
        opened |= {b: left[a] for a, b in zip(order, order[1:]) if b in wrong}
        todo = wrong
    if done is None:
        return df.select(*keys, F.lit(0).cast("long").alias("chunk")).where(F.lit(False))
    rows = done.where("rest is null").select(*keys, "cut", "extra")
    return running(rows, [*keys, "extra"], chunk=F.col("cut")).where(~F.col("extra")).select(*keys, "chunk")


def clamp(least: int, most: int | None, weighted: bool = False) -> Rule:
    """Chunks of ``least`` to ``most`` rows.  Rows that close a chunk (column ``closes``) do so
    from the ``least``-th on.  A full chunk ends at its last row or, if ``weighted``, after
    the row of smallest ``weight``, so that the forced cut depends on content too."""

    def rule(rows: pa.Table) -> list[int]:
        n = len(rows)
        near = np.flatnonzero(rows.column("closes").to_numpy()) + 1
        weight = rows.column("weight").to_numpy() if weighted else None
        ends: list[int] = []
        at = 0
        while True:
            k = int(np.searchsorted(near, at + least))
            end = int(near[k]) if k < len(near) else None
            if most is not None and (end is None or end > at + most):
                if at + most > n:
                    return ends
                end = at + 1 + int(np.argmin(weight[at : at + most])) if weighted else at + most
            if end is None:
                return ends
            ends.append(end)
            at = end

    return rule


def by_size(least: int, most: int, hashes: Callable[[np.ndarray], np.ndarray], tests: list[tuple[int, Callable[[np.ndarray], np.ndarray]]]) -> Rule:
    """Chunks by bytes: a chunk ends with the entry (column ``entry``) in which its first hit
    falls, or its ``most``-th byte.  A byte hits if its hash, of the bytes before it and
    itself, meets the test for the chunk's size there; ``tests`` are by the size from
    which on each holds.  Bytes before the ``least``-th are not looked at, so the hash must
    not reach back further."""

    def rule(rows: pa.Table) -> list[int]:
        chunks = rows.column("entry").cast(pa.large_binary()).chunks
        if not len(rows):
            return []
        entries = pa.concat_arrays(chunks)
        _, offsets, data = entries.buffers()
        bounds = np.frombuffer(offsets, np.int64)[entries.offset : entries.offset + len(entries) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[0] < bounds[-1] else np.zeros(0, np.uint8)
        upto, marks = bounds[1:] - bounds[0], hashes(raw)
        stops = [size for size, _ in tests[1:]] + [most]
        ends: list[int] = []
        at = 0  # bytes before the open chunk
        while True:
            hit = at + most - 1
            for (size, test), stop in zip(tests, stops):
                low = at + max(size, least) - 1
                if low >= len(raw):
                    break
                met = np.flatnonzero(test(marks[low : at + stop - 1]))
                if len(met):
                    hit = low + int(met[0])
                    break
            row = int(np.searchsorted(upto, hit, side="right"))
            if row >= len(upto):
                return ends
            ends.append(row + 1)
            at = int(upto[row])

    return rule


def _turn(words: np.ndarray, by: int) -> np.ndarray:
    by %= 32
    return words << np.uint32(by) | words >> np.uint32(32 - by) if by else words


def _behind(words: np.ndarray, by: int) -> np.ndarray:
    """The words ``by`` places before, zeros first."""
    return np.concatenate((np.zeros(min(by, len(words)), words.dtype), words[: max(0, len(words) - by)]))


def cyclic_hashes(raw: np.ndarray, table: np.ndarray, window: int) -> np.ndarray:
    """At each byte the exclusive or of its window's words, each turned by its distance.
    Windows of doubling width are put together, the bits of ``window`` tell which."""
    words = table[raw]
    out, held, width = np.zeros(len(raw), np.uint32), 0, 1
    while width <= window:
        if window & width:
            out ^= _turn(_behind(words, held), held)
            held += width
        words = words ^ _turn(_behind(words, width), width)
        width *= 2
    return out


def gear_hashes(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte the sum of the words of 64 bytes, each shifted by its distance."""
    words = table[raw].astype(np.uint64)
    for width in (1, 2, 4, 8, 16, 32):
        words = words + (_behind(words, width) << np.uint64(width))
    return words
