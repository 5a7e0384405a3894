"""Line dedup by pairwise alignment of overlapping documents.

Each pair of documents with a block of enough words in common is aligned by patience
diff over all their common lines, and the aligned common blocks are deleted from the
later document.  The result is that of aligning all pairs; pairs that cannot add to it
are not made:

A block that is long enough is covered by its shortest runs of neighbouring lines that
are long enough, from every first line and to every last line.  So only documents with
such a run in common are paired.  A later document is paired with the first holder of
each of its runs, and of its whole sequence of lines.  Where a run was not aligned with
its first holder (it crosses other lines) and is not deleted by another pair, its next
holders are tried, in growing numbers, until it is deleted or has no earlier holder.

The k-th occurrence of a line in a document is a line of its own.  So every line is
unique in both documents of a pair, as patience diff needs, and the longest increasing
run of positions is the whole alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns, materialize, order_key
from lamina.llm.segment import slices
from lamina.operators.ranges import numbered


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of the longest run of ``pairs`` (ascending by the first) that also
    ascends by the second."""
    tops, at, back = [], [], []
    for i, (_, p) in enumerate(pairs):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned_blocks(pairs: list[tuple[int, int, int]], least: int) -> list[int]:
    """Later positions to delete, of (later, first, words) of one pair of documents:
    those in blocks that run on in both and have ``least`` words at least."""
    pairs = sorted(pairs)
    run = [pairs[i] for i in patience([(a, b) for a, b, _ in pairs])]
    out: list[int] = []
    block: list[tuple[int, int, int]] = []
    for row in [*run, None]:
        if block and (row is None or row[0] != block[-1][0] + 1 or row[1] != block[-1][1] + 1):
            if sum(r[2] for r in block) >= least:
                out += [r[0] for r in block]
            block = []
        if row is not None:
            block.append(row)
    return out


def _sequences(docs: DataFrame) -> DataFrame:
    """``keys, words, k1, k2`` of each document of (text, k1, k2) with lines: the 64-bit
    keys of its non-blank lines, and their numbers of words as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (part for whole in batches for part in slices(whole, 0)):
            keys, words, doc = [], [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                seen: dict[str, int] = {}
                own, size = [], []
                for line in (t or "").split("\n"):
                    if line := line.strip():
                        seen[line] = c = seen.get(line, -1) + 1
                        own.append(xxhash.xxh64_intdigest(line.encode(), c))
                        size.append(len(line.split()))
                if own:
                    keys.append(np.array(own, np.uint64).tobytes())
                    words.append(np.array(size, np.int32).tobytes())
                    doc.append(i)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.binary()), batch.column(1).take(at), batch.column(2).take(at)], ["keys", "words", "k1", "k2"])

    return docs.mapInArrow(run, "keys binary, words binary, k1 long, k2 long")


def covering_runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """Bounds of the shortest runs of lines with ``least`` words, from every first and to
    every last line, and of all lines.  Those inside a run of ``least`` words cover it."""
    n, out = len(words), set()
    end = held = 0
    for start in range(n):
        while end < n and (held < least or end == start):
            held += words[end]
            end += 1
        if held < least:
            break
        out.add((start, end))
        held -= words[start]
    start = held = 0
    for end in range(1, n + 1):
        held += words[end - 1]
        while start < end - 1 and held - words[start] >= least:
            held -= words[start]
            start += 1
        if held >= least:
            out.add((start, end))
    if out:
        out.add((0, n))
    return out


def _runs(sequences: DataFrame, least: int) -> DataFrame:
    """``w, s, n, k1, k2``: key, first line and number of lines of each covering run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            w, s, n, doc = [], [], [], []
            for i, (raw, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for a, b in covering_runs(np.frombuffer(size, np.int32).tolist(), least):
                    w.append(int.from_bytes(raw[8 * a : 8 * b], "little") if b - a == 1 else xxhash.xxh64_intdigest(raw[8 * a : 8 * b], b - a))
                    s.append(a)
                    n.append(b - a)
                    doc.append(i)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(w, np.uint64).view(np.int64)), pa.array(s, pa.int32()), pa.array(n, pa.int32()), batch.column(2).take(at), batch.column(3).take(at)],
                ["w", "s", "n", "k1", "k2"],
            )

    return sequences.mapInArrow(run, "w long, s int, n int, k1 long, k2 long")


def _align(pairs: DataFrame, sequences: DataFrame, least: int) -> DataFrame:
    """``k1, k2, cut array<int>``: for later documents (k1, k2) of pairs with (f1, f2), the
    numbers of the lines to delete.  Each pair is aligned over all its common lines."""
    later = pairs.join(sequences, ["k1", "k2"])
    first = sequences.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("keys").alias("fkeys"))
    both = later.join(first, ["f1", "f2"]).select("k1", "k2", "keys", "words", "fkeys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, {}
        for batch in batches:
            cuts = []
            for raw, size, fraw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if fraw != last:
                    last, at = fraw, {key: p for p, key in enumerate(np.frombuffer(fraw, np.int64).tolist())}
                words = np.frombuffer(size, np.int32).tolist()
                common = [(p, at[key], words[p]) for p, key in enumerate(np.frombuffer(raw, np.int64).tolist()) if key in at]
                cuts.append(aligned_blocks(common, least))
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cuts, pa.list_(pa.int32()))], ["k1", "k2", "cut"])
            yield out.filter(pa.array([bool(c) for c in cuts], pa.bool_()))

    found = both.mapInArrow(run, "k1 long, k2 long, cut array<int>")
    return found.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_set("cut"))).alias("cut"))


def deletions(keyed: DataFrame, least: int, step: int = 8) -> DataFrame:
    """``k1, k2, cut array<int>``: for documents (text, k1, k2) with aligned blocks, the
    numbers of the non-blank lines to delete.  Runs that their first holder did not
    delete go to the next ``step`` holders, then to ``step`` times as many, and so on."""
    sequences = _sequences(keyed).groupBy("k1", "k2").agg(F.first("keys").alias("keys"), F.first("words").alias("words"))
    sequences = materialize(sequences, "lines")
    runs = materialize(_runs(sequences.select("keys", "words", "k1", "k2"), least), "runs")
    first = (
        runs.groupBy("w")
        .agg(F.min(F.struct("k1", "k2")).alias("f"), F.max(F.struct("k1", "k2")).alias("z"))
        .where((F.col("f.k1") != F.col("z.k1")) | (F.col("f.k2") != F.col("z.k2")))
        .select("w", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"))
    )
    first = materialize(first, "first")  # written, so that the join to it can split a common run's rows
    shared = materialize(runs.join(first, "w").where("k1 <> f1 or k2 <> f2"), "shared")
    cuts = materialize(_align(shared.select("k1", "k2", "f1", "f2").distinct(), sequences, least), "cuts")

    def uncut(rows: DataFrame, cut: DataFrame) -> DataFrame:
        """Those of ``rows`` (lines array<int>) with lines that no pair deleted, by these lines."""
        left = F.coalesce(F.array_except("lines", "cut"), F.col("lines"))
        return rows.join(cut, ["k1", "k2"], "left").withColumn("lines", left).drop("cut").where(F.size("lines") > 0)

    lines = F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)
    open_ = materialize(uncut(shared.select("w", "k1", "k2", lines.alias("lines")).distinct(), cuts), "open")
    if open_.isEmpty():
        return cuts
    wanted = materialize(open_.select("w").distinct(), "wanted")
    holders = materialize(shared.join(wanted, "w", "left_semi").select("w", "k1", "k2").distinct(), "holders")
    placed = materialize(numbered(holders, ["w", "k1", "k2"], "at"), "placed")  # in key ranges: no run's holders meet in one task
    starts = materialize(placed.groupBy("w").agg(F.min("at").alias("start")), "starts")
    holders = materialize(placed.join(starts, "w").select("w", "k1", "k2", (F.col("at") - F.col("start") + 1).alias("r")), "holders")
    open_ = open_.join(holders, ["w", "k1", "k2"])
    others = holders.select("w", F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("r").alias("fr"))
    low, high = 0, step
    while True:
        open_ = materialize(open_.where(F.col("r") > low + 1), "open")
        if open_.isEmpty():
            break
        pairs = open_.join(others.where((F.col("fr") > low) & (F.col("fr") <= high)), "w").where("fr < r")
        more = materialize(_align(pairs.select("k1", "k2", "f1", "f2").distinct(), sequences, least), "cuts")
        cuts = cuts.unionByName(more)
        open_ = uncut(open_, more)
        low, high = high, high * step
    return cuts.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def cut_lines(text: str | None, cut: list[int] | None) -> str | None:
    """The text without those of its non-blank lines."""
    if not cut or text is None:
        return text
    drop, kept, n = set(cut), [], 0
    for line in text.split("\n"):
        if line.strip():
            n += 1
            if n - 1 in drop:
                continue
        kept.append(line)
    return "\n".join(kept)


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """All columns of ``docs``, the text without its deleted lines, and
    ``__lines int, __cut int``: non-blank lines before and how many were deleted.

    Documents are ordered by id, those without one last, ties by text hash.  Rows equal
    in id and text are one document and keep the same lines.  Null and empty texts have
    no lines.  Blank lines are never deleted and part no block.  A very long document is
    one list of its lines' keys.  An empty table gives no rows.
    """
    check_columns(docs, doc_id, text)
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    at = names.index(text)
    renamed = docs.toDF(*inner)
    keyed = renamed.select("*", order_key(inner[names.index(doc_id)]).alias("__k1"), F.xxhash64(inner[at]).alias("__k2"))
    cut = deletions(keyed.select(F.col(inner[at]).alias("text"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2")), least_words)
    joined = keyed.join(cut, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left").select(*inner, "cut")
    schema = T.StructType([*(joined.schema[n] for n in inner), T.StructField("__lines", T.IntegerType()), T.StructField("__cut", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts, cuts = batch.column(at).to_pylist(), batch.column(len(inner)).to_pylist()
            columns = batch.columns[: len(inner)]
            columns[at] = pa.array([cut_lines(t, c) for t, c in zip(texts, cuts)], pa.string())
            lines = [sum(1 for x in (t or "").split("\n") if x.strip()) for t in texts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array([len(c or ()) for c in cuts], pa.int32())], schema.names)

    return joined.mapInArrow(run, schema).toDF(*names, "__lines", "__cut")


def line_dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """``doc_id, n_lines, n_deleted, n_chars_kept, kept_sha256`` for each row."""
    out = remove_repeated_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least_words=least_words)
    return out.select(
        "doc_id",
        F.col("__lines").cast("long").alias("n_lines"),
        F.col("__cut").cast("long").alias("n_deleted"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
