"""Token ids in a succinct binary form: one wavelet matrix per shard.

A shard file holds the ids of its documents, in ascending order of document id, as
bit-planes.  Ids are renumbered by falling frequency in the shard, so the upper
planes are almost all zero and their blocks compress.  Access, rank (counting) and
select (where an id occurs) work on the planes, a block at a time.

File: magic ``LWM1``, a little-endian u32 length, a JSON head, then the parts that the
head gives the sizes of: the alphabet (u32 ids), document ids (i64), document lengths
(u32), and for each plane the ones before each block (u64), the blocks' ends (u64) and
the blocks, each compressed with zstd.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import check_columns, materialize, new_path
from lamina.llm.segment import TokenStore, slices

MAGIC = b"LWM1"
BLOCK = 1 << 16  # bits of a block


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The shard file of ``ids`` (unsigned), the concatenated ids of the documents."""
    import zstandard

    count = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(count)
    alphabet = alphabet[np.argsort(-count[alphabet], kind="stable")].astype("<u4")
    code = np.zeros(len(count), np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    now = code[ids] if len(ids) else np.zeros(0, np.uint32)
    if len(alphabet) <= 1 << 16:
        now = now.astype(np.uint16)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, parts, sizes = [], [], []
    for p in range(planes - 1, -1, -1):
        bits = (now & now.dtype.type(1 << p)) != 0
        packed = np.packbits(bits, bitorder="little")
        blocks = [pack(packed[i : i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        ones = np.array([np.bitwise_count(packed[i : i + BLOCK // 8]).sum(dtype=np.int64) for i in range(0, len(packed), BLOCK // 8)], np.int64)
        zeros.append(len(bits) - int(ones.sum()))
        before = (np.cumsum(ones) - ones).astype("<u8").tobytes()
        ends = np.cumsum([len(b) for b in blocks]).astype("<u8").tobytes()
        body = b"".join(blocks)
        sizes.append([len(before), len(ends), len(body)])
        parts += [before, ends, body]
        now = np.concatenate((np.compress(~bits, now), np.compress(bits, now)))  # by places: bits are hard to guess
    known = [d is not None for d in doc_ids]
    head = {"n": len(ids), "docs": len(doc_ids), "sigma": len(alphabet), "zeros": zeros, "planes": sizes, "no_id": [i for i, k in enumerate(known) if not k]}
    text = json.dumps(head).encode()
    return b"".join(
        [MAGIC, len(text).to_bytes(4, "little"), text, alphabet.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(), *parts]
    )


class WaveletMatrix:
    """A shard file, opened: ``access``, ``rank``, ``count``, ``select`` and ``ids``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        size = int.from_bytes(data[4:8], "little")
        self.head = head = json.loads(data[8 : 8 + size])
        self.n, self.zeros, at = head["n"], head["zeros"], 8 + size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.alphabet = take(head["sigma"], "<u4")
        raw = take(head["docs"], "<i8")
        none = set(head["no_id"])
        self.doc_ids = [None if i in none else int(d) for i, d in enumerate(raw)]
        self.lengths = take(head["docs"], "<u4")
        self.planes = []
        for a, b, c in head["planes"]:
            self.planes.append((take(a // 8, "<u8"), take(b // 8, "<u8"), take(c, "u1")))
        self._code: dict[int, int] | None = None
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        """The bits of a block; the last few stay open."""
        import zstandard

        if (plane, k) not in self._open:
            if len(self._open) > 256:
                self._open.clear()
            _, ends, body = self.planes[plane]
            start = int(ends[k - 1]) if k else 0
            raw = zstandard.ZstdDecompressor().decompress(body[start : int(ends[k])].tobytes())
            self._open[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: min(BLOCK, self.n - k * BLOCK)]
        return self._open[plane, k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // BLOCK)[i % BLOCK])

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        k, r = divmod(i, BLOCK)
        before = self.planes[plane][0]
        if k == len(before):
            k, r = k - 1, BLOCK
        return int(before[k]) + int(np.count_nonzero(self._block(plane, k)[:r])) if len(before) else 0

    def access(self, i: int) -> int:
        """The id at position i of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p, zeros in enumerate(self.zeros):
            bit = self._bit(p, i)
            ones = self._ones(p, i)
            i = zeros + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _find(self, token: int) -> int:
        if self._code is None:
            self._code = {int(t): c for c, t in enumerate(self.alphabet)}
        return self._code.get(token, -1)

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before position ``end``."""
        code, start = self._find(token), 0
        if code < 0:
            return 0
        for p, zeros in enumerate(self.zeros):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (zeros + a, zeros + b) if code >> (len(self.zeros) - 1 - p) & 1 else (start - a, end - b)
        return end - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        before = self.planes[plane][0].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(plane, b) == bit)[k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        code, start = self._find(token), 0
        if code < 0 or k >= self.rank(token, self.n):
            raise IndexError(k)
        depth = len(self.zeros)
        for p, zeros in enumerate(self.zeros):
            ones = self._ones(p, start)
            start = zeros + ones if code >> (depth - 1 - p) & 1 else start - ones
        i = start + k
        for p in range(depth - 1, -1, -1):
            bit = code >> (depth - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        import zstandard

        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        depth = len(self.zeros)
        for p in range(depth - 1, -1, -1):
            _, ends, body = self.planes[p]
            starts = [0, *ends[:-1].tolist()]
            unpack = zstandard.ZstdDecompressor().decompress
            raw = b"".join(unpack(body[s:e].tobytes()) for s, e in zip(starts, ends.tolist()))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].view(bool)
            up, few = np.empty_like(code), self.zeros[p]
            even = self.n < 8 * min(few, self.n - few)  # then places are faster than flags
            up[np.flatnonzero(~bits) if even else ~bits] = code[:few]
            up[np.flatnonzero(bits) if even else bits] = code[few:] | (1 << (depth - 1 - p))
            code = up
        return self.alphabet[code] if self.n else np.zeros(0, "<u4")


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 ones
    stand for themselves, the others, in order, for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by the tokenizers library's byte-level BPE model, which is given one pre-token at
    a time; one that is held is not encoded again.  As in the library, texts are first cut
    at the vocabulary's added tokens, which have their own ids."""

    def __init__(self, data: bytes, end_id: int):
        import regex
        from tokenizers import Tokenizer

        whole = json.loads(data)
        if whole["normalizer"] or whole["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        added = [t for t in whole["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that are not plain strings")
        self.model, shown = Tokenizer.from_buffer(data).model, byte_alphabet()
        self.alphabet = np.array([ord(shown[b]) for b in range(256)], "<u4")
        self.end = np.array([end_id], np.uint32)
        self.added = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest))})")
        self.store = TokenStore(self._tokens)

    def _tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(tokens):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, data = tokens.buffers()
        at = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        shown = self.alphabet[np.frombuffer(data, np.uint8)[at[0] : at[-1]]].tobytes().decode("utf-32-le")  # a character a byte
        at = (at - at[0]).tolist()
        ids = [[x.id for x in self.model.tokenize(shown[a:b])] for a, b in zip(at, at[1:])]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id, as unsigned 32-bit numbers."""
        if not any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            ids, at = self.store.encode(texts)
            return [np.append(ids[a:b], self.end) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        parts, tokens = [], []
        for t in texts.to_pylist():
            cut = self.cut.split(t or "")
            parts += cut[::2]
            tokens.append([self.added[x] for x in cut[1::2]])
        ids, at = self.store.encode(pa.array(parts, pa.string()))
        plain = iter([ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        return [np.concatenate([next(plain), *chain.from_iterable((x, next(plain)) for x in own), self.end]) for own in tokens]


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def write_shards(docs: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shard_tokens: int = 4 << 20) -> None:
    """Encode ``docs`` and write shard files, in ascending order of document id (rows
    without an id first, ties by text), as a table ``part int, shard int, docs long,
    tokens long, file binary`` at ``path``.

    One range partition by id is sorted and cut into shards of about ``shard_tokens``
    ids, so a task holds one shard at a time; Spark's committer makes the files whole
    or absent if an executor is lost.
    """
    check_columns(docs, doc_id, text)
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = "part int, shard int, docs long, tokens long, file binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        data = shared.value
        key = (zlib.crc32(data), end_id)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(data, end_id)
        encoder = _ENCODERS[key]
        ids, raws, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, raws, held, shard
            file = build(np.concatenate(raws), ids, np.array([len(r) for r in raws], np.int64))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([file], pa.binary())],
                ["part", "shard", "docs", "tokens", "file"],
            )
            ids, raws, held, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            for block in slices(batch, 1):
                for d, raw in zip(block.column(0).to_pylist(), encoder.encode(block.column(1))):
                    ids.append(d)
                    raws.append(raw)
                    held += len(raw)
                    if held >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_shards(files: DataFrame) -> DataFrame:
    """``part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long`` of each
    document in shard files; ``at`` is its first position in the shard."""
    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = WaveletMatrix(batch.column("file")[i].as_py())
                raw = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                view = memoryview(raw)
                crcs = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("part")[i].as_py()] * n, pa.int32()),
                        pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, schema)


def shard_starts(files: DataFrame) -> DataFrame:
    """``part, shard, before``: ids in all shards before.  A prefix sum within each range
    partition, and one over the partitions' totals (a row for each partition)."""
    sizes = files.select("part", "shard", "tokens")
    totals = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inner"))
    return inner.join(totals, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("before"))


def token_table(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shard_tokens: int = 4 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from the files it writes.

    Every document ends with ``end_id``; null and empty texts are that id alone.
    Repeated rows follow each other.  Other columns are not looked at.  An empty table
    gives no files and no rows.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, vocabulary, path, doc_id, text, end_id, shard_tokens)
    files = spark.read.schema("part int, shard int, docs long, tokens long, file binary").parquet(path)
    starts = materialize(shard_starts(files), "starts")
    return read_shards(files.select("part", "shard", "file")).join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
