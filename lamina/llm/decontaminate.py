"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items.  A block is a pair of
neighbouring words; the shift table gives for a block how far the search window may
move because no pattern has the block nearer to its end, so most positions are never
looked at.  Where the shift is zero, the block's bucket holds the patterns that end
in it, and direct comparison of all their words confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns, materialize

_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """A-Z lowered; runs of anything but ASCII non-alphanumerics.  Null has none."""
    return (text or "").encode().translate(_BYTES).split()


def windows(ws: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All ``size`` consecutive words; the whole of fewer words; none of none."""
    if not ws:
        return []
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]


class WuManber:
    """Search for sets of word tuples, a table set for each pattern length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], block: int = 2):
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in sorted(set(patterns)):
            by_length.setdefault(len(p), []).append(p)
        self.tables = []
        for length, ps in sorted(by_length.items()):
            b = min(block, length)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
            for p in ps:
                for end in range(b, length + 1):
                    key = p[end - b : end]
                    shift[key] = min(shift.get(key, length), length - end)
                bucket.setdefault(p[length - b :], []).append(p)
            self.tables.append((length, b, shift, bucket))

    def find(self, ws: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        n = len(ws)
        for length, b, shift, bucket in self.tables:
            skip = length - b + 1
            end = length
            if b == 2:
                while end <= n:
                    key = (ws[end - 2], ws[end - 1])
                    by = shift.get(key, skip)
                    if by:
                        end += by
                        continue
                    found = tuple(ws[end - length : end])
                    for p in bucket[key]:
                        if p == found:
                            yield end - length, p
                    end += 1
            else:
                while end <= n:
                    key = tuple(ws[end - b : end])
                    by = shift.get(key, skip)
                    if by:
                        end += by
                        continue
                    found = tuple(ws[end - length : end])
                    for p in bucket[key]:
                        if p == found:
                            yield end - length, p
                    end += 1


def _spans(ws: list[bytes], search: WuManber, owner: dict[tuple[bytes, ...], list[str]]) -> tuple[list[int], set[str]]:
    """Merged [start, end) word spans, flat, of all occurrences; the ids of their items."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for start, p in search.find(ws):
        found.append((start, start + len(p)))
        items.update(owner[p])
    return _merge(found), items


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for s, e in sorted(spans):
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [s, e]
    return flat


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``item string, w binary``: the windows of each item, their words parted by spaces, once
    each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [b" ".join(w) for w in dict.fromkeys(windows(words(t), size))]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "w"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, w binary").distinct()


_TABLES: list[tuple[dict, WuManber]] = []


def _tables(owner: dict[tuple[bytes, ...], list[str]]) -> WuManber:
    """The tables of a block, built once in a worker, where a broadcast value is one object as
    long as it is held; only the last block's are."""
    if not _TABLES or _TABLES[0][0] is not owner:
        _TABLES[:] = [(owner, WuManber(owner))]
    return _TABLES[0][1]


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...],
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    most_windows: int = 20_000,
) -> DataFrame:
    """The ``keep`` columns, then ``n_words long, spans array<int>, items array<string>``:
    flat [start, end) word spans that lie in occurrences of benchmark windows, and the
    sorted distinct ids of the items they come from.

    The benchmark is dealt into blocks of about ``most_windows`` windows, each broadcast in
    turn, so memory is that of one block however large the benchmark is.  Of several
    blocks each one's hits, by text, are a table, and these are put together and joined
    to the documents.
    """
    check_columns(docs, doc_text, *keep)
    check_columns(benchmark, item_id, item_text)
    spark = docs.sparkSession
    parts = materialize(benchmark_windows(benchmark, item_id, item_text, size), "windows")
    n = max(1, -(-parts.count() // most_windows))
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def search(rows: DataFrame, k: int, hits_only: bool) -> DataFrame:
        """The rows' columns but the last, their text, and what block k finds in it."""
        block = parts.where(F.pmod(F.xxhash64("item", "w"), F.lit(n)) == k) if n > 1 else parts
        owner: dict[tuple[bytes, ...], list[str]] = {}
        for r in block.collect():
            ids = owner.setdefault(tuple(bytes(r.w).split()), [])
            if r.item is not None:
                ids.append(r.item)
        shared = spark.sparkContext.broadcast(owner)
        at, schema = len(rows.columns) - 1, T.StructType([*rows.schema.fields[:-1], *found.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner = shared.value
            tables = _tables(owner)
            for batch in batches:
                count, spans, items = [], [], []
                for t in batch.column(at):
                    ws = words(t.as_py())
                    hit, ids = _spans(ws, tables, owner)
                    count.append(len(ws))
                    spans.append(hit)
                    items.append(sorted(ids))
                cells = [pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*batch.columns[:at], *cells], schema.names)
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

        return rows.mapInArrow(run, schema)

    if n == 1:
        return search(docs.select(*keep, F.col(doc_text).alias("__text")), 0, False)
    text = F.col(doc_text)
    keys = [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]
    hits = None
    for k in range(n):
        part = materialize(search(docs.select(*keys, text.alias("__text")), k, True).dropDuplicates(["__h1", "__h2"]), "hits")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("__h1", "__h2").agg(F.collect_list("spans").alias("__s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__i"))
    rows = docs.select(*keep, text.alias("__text"), *keys).join(materialize(hits, "hits"), ["__h1", "__h2"], "left").select(*keep, "__i", "__s", "__text")
    at, schema = len(keep), T.StructType([*(docs.schema[c] for c in keep), *found.fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = [len(words(t.as_py())) for t in batch.column(at + 2)]
            spans = [_merge([p for s in lists or () for p in zip(s[::2], s[1::2])]) for lists in batch.column(at + 1).to_pylist()]
            items = [i or [] for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], schema.names)

    return rows.mapInArrow(finish, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    Null and empty texts have no words.  Repeated rows give repeated results.  Items
    of equal id count as one; windows of an item without an id are hits, but no id is
    listed.  An empty benchmark hits nothing.
    """
    found = find_overlap(docs.select(doc_id, text), benchmark, (doc_id,), text, item_id, item_text, size)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x.cast("long") - a)
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs.  Null and empty
    texts stay, repeated rows stay or go together; an empty table gives no rows."""
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    found = find_overlap(docs.toDF(*inner), benchmark, tuple(inner), inner[names.index(text)], item_id, item_text, size)
    return found.where(F.size("spans") == 0).select(*inner).toDF(*names)
