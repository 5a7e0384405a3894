"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into few segments, so few that of two fingerprints that
differ in at most ``distance`` bits one segment differs in at most one.  Every
segment is indexed under its one-wildcard variants (the segment with one bit
deleted), so such a pair meets under an equal key and is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import NO_ID, check_columns, materialize, order_key
from lamina.llm.components import connected_components

BITS, SEGMENT = 64, 32  # two differing bits leave one of two segments with at most one
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text: A-Z lowered, words split at ASCII white
    space, ``width``-word shingles with repeats, a bit set if set in over half the
    shingles' XXH64.  Fewer words make one shingle; none (null too) make zero."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())],
            dtype="<u8",
        )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        block = hashes[k : k + 65536]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint's bits as a signed long."""
    schema = T.StructType([*(df.schema[n] for n in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), width) for t in batch.column(len(keep))], dtype=np.uint64).view(np.int64)  # a text at a time
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(bits)], [*keep, "fp"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _shift(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), by if isinstance(by, Column) else F.lit(by))


def _variants(fp: Column) -> Column:
    """The keys of every one-wildcard variant of every segment: segment and wildcard
    numbers stand above the segment's bits, in which the deleted bit is zero."""
    low = (1 << SEGMENT) - 1

    def keys(s: int) -> Column:
        part = F.shiftrightunsigned(fp, s * SEGMENT).bitwiseAND(F.lit(low))
        return F.transform(
            F.sequence(F.lit(0), F.lit(SEGMENT - 1)),
            lambda i: part.bitwiseAND(F.bitwise_not(_shift(F.lit(1), i))).bitwiseOR(_shift(i + s * SEGMENT, SEGMENT)),
        )

    return F.concat(*(keys(s) for s in range(BITS // SEGMENT)))


def fingerprint_links(fps: DataFrame, distance: int = 2, pair_bucket: int = 48, few: int = 1_000_000) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within ``distance`` (1 or 2) bits.

    A bucket of two is its smallest and its greatest member, so counting it yields the
    pair.  Members of larger buckets are looked up by their keys, which are broadcast where
    they are ``few`` at most, counted first, and else joined.  Buckets of up to
    ``pair_bucket`` fingerprints are verified pair by pair.
    Fingerprints of larger buckets take an exact linear way instead: each is put under
    all its ``distance``-wildcard patterns (2,016 at 2 bits), and those that share a
    pattern, at most four and exactly those within ``distance`` bits, are tied to its
    smallest.  So no large bucket's pairs are enumerated and no link is lost.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2 bits")
    rows = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    two = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()
    many = sizes.where("n > 2").select("key", "n")
    sized = materialize(rows.join(F.broadcast(many) if many.count() <= few else many, "key"), "buckets")

    def near(v: Column, x: Column, i: Column) -> Column:
        rest = F.filter(F.slice(v, i + 2, F.size(v)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= distance)
        return F.transform(rest, lambda y: F.struct(x.alias("a"), y.alias("b")))

    small = (
        sized.where(F.col("n") <= pair_bucket)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("fp")).alias("v"))
        .select(F.explode(F.flatten(F.transform("v", lambda x, i: near(F.col("v"), x, i)))).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )
    hot = sized.where(F.col("n") > pair_bucket).select("fp").distinct()
    hot = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    first = F.col("i") if distance == 1 else F.col("i") + 1
    if distance == 1:
        hot = hot.withColumn("j", first)
    else:
        hot = hot.where(F.col("i") < BITS - 1).select("fp", "i", F.explode(F.sequence(first, F.lit(BITS - 1))).alias("j"))
    mask = _shift(F.lit(1), F.col("i")).bitwiseOR(_shift(F.lit(1), F.col("j")))
    patterns = hot.select("fp", "i", "j", F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest"))
    shared = patterns.groupBy("i", "j", "rest").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("v"))
    large = shared.where(F.size("v") > 1).select("a", F.explode("v").alias("b")).where("a <> b").distinct()
    return two.unionByName(small).unionByName(large)


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int, distance: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the extra columns, ``fp``, ``root`` (the component's smallest
    fingerprint) and ``low`` (its smallest id, NO_ID without one).  All work on links
    is over distinct fingerprints, so exact copies cost one row each."""
    check_columns(docs, doc_id, text, *extra)
    base = materialize(with_fingerprint(docs, text, width, (doc_id, *extra)), "fingerprints")
    fps = materialize(base.groupBy("fp").agg(F.min(order_key(doc_id)).alias("low")), "distinct")
    roots = connected_components(fingerprint_links(fps.select("fp"), distance))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    named = materialize(named, "named")
    lows = materialize(named.groupBy("root").agg(F.min("low").alias("low")), "lows")
    named = materialize(named.select("fp", "root").join(lows, "root"), "named")
    return base.join(named, "fp")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows
    stay rows of their own in one component.  component_id is the smallest id of the
    component, null only where all its ids are null.  Other columns of ``docs`` are not
    looked at.  An empty table gives no rows.
    """
    return _labelled(docs, doc_id, text, width, distance).select(
        F.col(doc_id).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("low") != NO_ID, F.col("low")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one of the smallest
    id (rows without an id last), of the smaller text hash among equal ids; of rows equal
    in both one.  Null and empty texts are one component with all else of fingerprint
    zero.  An empty table gives no rows."""
    check_columns(docs, doc_id, text)
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    keyed = docs.toDF(*inner).select("*", order_key(inner[names.index(doc_id)]).alias("__k1"), F.xxhash64(inner[names.index(text)]).alias("__k2"))
    found = _labelled(keyed.select(F.col(inner[names.index(doc_id)]).alias("doc_id"), F.col(inner[names.index(text)]).alias("text"), "__k1", "__k2"), "doc_id", "text", width, distance, ("__k1", "__k2"))
    best = found.groupBy("root").agg(F.min(F.struct("__k1", "__k2")).alias("best")).select("best.*", F.lit(True).alias("__best"))
    rows = found.groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("__n")).join(best, ["__k1", "__k2"], "left")
    # Only rows that go, or that stand more than once, are looked up, so where these are few no text is shuffled.
    special = materialize(rows.where("__best is null or __n > 1"), "special")
    alone = keyed.join(special.select("__k1", "__k2"), ["__k1", "__k2"], "left_anti").select(*inner)
    again = keyed.join(special.where("__best").select("__k1", "__k2"), ["__k1", "__k2"]).groupBy("__k1", "__k2").agg(F.first(F.struct(*inner)).alias("r")).select("r.*")
    return alone.unionByName(again).toDF(*names)
