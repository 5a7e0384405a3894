"""Byte-level BPE by a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash
over the vocabulary's byte strings; any other is merged with a heap of neighbouring
pairs over a linked list of its bytes.  Ids equal those of a plain merge loop: the
lowest rank first, the leftmost of equal ranks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns
from lamina.llm.segment import TokenStore, slices


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: n keys in n slots.

    A key's bucket holds the seed with which all keys of the bucket fall on free slots;
    a bucket of one key holds the slot itself, as a negative number.
    """

    def __init__(self, ids: dict[bytes, int]):
        n = self.n = len(ids)
        self.keys: list[bytes] = [b""] * n
        self.ids = array("l", [-1]) * n
        self.m = max(1, n)  # so many buckets of one key that the last seeds are found fast
        self.seeds = array("l", [0]) * self.m
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        h = xxhash.xxh3_64_intdigest
        for k in ids:
            buckets[h(k) % self.m].append(k)
        order = sorted(range(self.m), key=lambda b: (-len(buckets[b]), b))
        free = [True] * n
        left = None
        for b in order:
            keys = buckets[b]
            if not keys:
                break
            if len(keys) == 1:
                left = left or iter([i for i in range(n) if free[i]])
                slots, seed = [next(left)], None
                self.seeds[b] = -slots[0] - 1
            else:
                seed = 1
                while True:
                    slots = [h(k, seed) % n for k in keys]
                    if len({*slots}) == len(slots) and all(free[s] for s in slots):
                        break
                    seed += 1
                self.seeds[b] = seed
            for k, s in zip(keys, slots):
                free[s] = False
                self.keys[s], self.ids[s] = k, ids[k]

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.m]
        if not seed:
            return -1
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.ids[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by its merges.

    A heap entry packs rank, start and end of a pair into one integer, so entries
    compare by rank, then by place; an entry whose pair is gone is passed over.
    """
    n = len(piece)
    width = n.bit_length()
    low = (1 << width) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap: list[int] = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append(((rank << width) | i) << width | (i + 2))
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        end = entry & low
        i = (entry >> width) & low
        mid = after[i]
        if mid >= n or mid < 0 or after[mid] != end:
            continue
        after[i], after[mid] = end, -1
        before[end] = i
        if end < n and (rank := get(piece[i : after[end]])) is not None:
            push(heap, ((rank << width) | i) << width | after[end])
        p = before[i]
        if p >= 0 and (rank := get(piece[p:end])) is not None:
            push(heap, ((rank << width) | p) << width | end)
    out, i = [], 0
    while i < n:
        if (rank := get(piece[i : after[i]])) is None:
            raise ValueError(f"the vocabulary has no byte {piece[i : after[i]]!r}")
        out.append(rank)
        i = after[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder over a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.whole, self.ranks = PerfectHash(ranks), ranks
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self._start()

    def _start(self) -> None:
        self.store = TokenStore(self._tokens)
        size = len(self.bytes_of)
        width = len(str(size)) + 1
        self.digits = np.array([f"{i} ".encode() for i in range(size)], dtype=f"S{width}").view(np.uint8).reshape(size, width)
        self.length = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def __getstate__(self):
        return self.whole, self.ranks, self.bytes_of

    def __setstate__(self, state):
        self.whole, self.ranks, self.bytes_of = state
        self._start()

    def _tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        get, ranks, flat, size = self.whole.get, self.ranks, array("I"), []
        for raw in tokens.cast(pa.binary()).to_pylist():
            one = get(raw)
            if one >= 0:
                flat.append(one)
                size.append(1)
            else:
                ids = merge(raw, ranks)
                flat.extend(ids)
                size.append(len(ids))
        return np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32), np.array(size, np.int64)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.store.encode(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the vocabulary's, laid end to end."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.start[ids] - (ends - length), length)].tobytes()

    def digest(self, ids: np.ndarray) -> str:
        """sha256 of the decimal ids, joined by one space."""
        signs = self.digits[ids].ravel()
        return hashlib.sha256(signs[signs != 0].tobytes()[:-1]).hexdigest()


def encode_table(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, then ``n_tokens long, ids_sha256 string,
    decoded_sha256 string`` and, if asked for, ``ids array<int>``.

    One pass without a shuffle.  ids_sha256 is of the decimal ids joined by one space,
    decoded_sha256 of the bytes that the ids decode to.  Null and empty texts have no
    ids.  Columns of docs that bear a result's name give way to it.  The vocabulary is
    of fixed size; it is read on the driver and broadcast.
    """
    check_columns(docs, text)
    spark = docs.sparkSession
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        made.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    keep = [n for n in docs.columns if n != text and n not in {f.name for f in made}]
    shared = spark.sparkContext.broadcast(ByteBPE(read_ranks(vocabulary)))
    schema = T.StructType([*(docs.schema[n] for n in keep), *made])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for whole in batches:
            for batch in slices(whole, len(keep)):
                encoded = bpe.encode_all(batch.column(len(keep)))
                shas = [bpe.digest(ids) for ids in encoded]
                backs = [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]
                out = [*batch.columns[: len(keep)], pa.array([len(ids) for ids in encoded], pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(encoded).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(*(F.col(f"`{n}`") for n in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
