"""A content-addressed chunk table in Parquet: append what is new, by hash.

Layout under one folder: ``parts/<id>/fan=<two digits>`` (Parquet, dealt by the first two
digits of the hash, so a lookup reads one of them), ``manifest/<n>.json`` (which parts
there are, by versions that are published once), ``format.json``.  A reader sees one
version of the manifest, whole; parts that no version names are not there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.operators import integrity
from lamina.sources.files import Files, Register
from lamina.sources.shared import materialize

SCHEMA = "hash string, level int, data string"
FORMAT = {"kind": "lamina chunk store", "version": 1}


class ChunkStore:
    """``hash, level, data`` under a folder.  Writes are idempotent; reads may be verified.
    ``read_hashes`` and ``written`` record what lookups asked for and writes added."""

    def __init__(self, spark: SparkSession, path: str, algorithm: str = "sha256", files: Files | None = None):
        self.spark, self.path, self.algorithm = spark, path.rstrip("/"), algorithm
        self.files = files or Files(spark, path)
        self._manifest = Register(self.files, "manifest")
        self._batch: list[str] | None = None
        self.read_hashes: set[str] = set()
        self.written = 0
        self._check_format()

    def _check_format(self) -> None:
        """An unknown kind or version of store is refused."""
        text = self.files.read("format.json")
        if text is None:
            self.files.publish("format.json", json.dumps(FORMAT | {"algorithm": self.algorithm}))
            text = self.files.read("format.json")
        found = json.loads(text)
        if {k: found.get(k) for k in FORMAT} != FORMAT or found.get("algorithm") != self.algorithm:
            raise ValueError(f"not a store of this format: {text}")

    def _parts(self) -> tuple[int, list[str]]:
        version, text = self._manifest.get("parts")
        return version, json.loads(text) if text else []

    def _frame(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA + ", fan string")
        paths = [f"{self.path}/parts/{p}" for p in parts]
        out = None
        for p in paths:
            part = self.spark.read.schema(SCHEMA + ", fan string").parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def all(self) -> DataFrame:
        return self._frame(self._parts()[1]).drop("fan")

    def _stage(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.select("hash", "level", "data", F.substring("hash", 1, 2).alias("fan")).write.partitionBy("fan").parquet(f"{self.path}/parts/{part}")
        return part

    def _change(self, change: Callable[[list[str]], list[str]]) -> None:
        """Publish the next list of parts; a lost race looks at the new one again."""
        while True:
            version, parts = self._parts()
            if self._manifest.put("parts", version, json.dumps(change(parts))):
                return

    def write(self, data: DataFrame) -> DataFrame:
        """Add ``level, data`` rows; returns their hashes."""
        rows = data.select(E.address("data", self.algorithm).alias("hash"), F.col("level").cast("int").alias("level"), "data")
        self.add(rows)
        return rows.select("hash").distinct()

    def add(self, chunks: DataFrame) -> int:
        """Add chunks that are not there; how many were new.  Two writers may both store a
        chunk; readers see it once through ``dedup``, and ``rewrite`` drops the double."""
        fresh = materialize(integrity.missing(chunks, self._frame([*self._parts()[1], *(self._batch or [])]).drop("fan")), "new")
        n = fresh.count()
        if n:
            part = self._stage(fresh)
            self.written += n
            if self._batch is None:
                self._change(lambda parts: [*parts, part])
            else:
                self._batch.append(part)
        return n

    @contextmanager
    def batch(self) -> Iterator[ChunkStore]:
        """Writes within become readable together at the end, or not at all."""
        if self._batch is not None:
            raise RuntimeError("a batch is open")
        self._batch = []
        try:
            yield self
            added = self._batch
            if added:
                self._change(lambda parts: [*parts, *added])
        except BaseException:
            for part in self._batch:
                self.files.delete(f"parts/{part}")
            raise
        finally:
            self._batch = None

    def read(self, hash_: str) -> DataFrame:
        """The chunk, or no row; only the folder of its first two digits is read."""
        if hash_ is None:
            raise ValueError("no hash")
        self.read_hashes.add(hash_)
        found = self._frame(self._parts()[1]).where((F.col("fan") == hash_[:2]) & (F.col("hash") == hash_))
        return found.drop("fan").limit(1)

    def verified(self) -> DataFrame:
        return integrity.checked(self.all(), self.algorithm)

    def observed(self, name: str) -> tuple[DataFrame, Observation]:
        """The chunks, and what is read of them, counted as they pass: ``chunks, bytes``."""
        seen = Observation(name)
        return self.all().observe(seen, F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("bytes")), seen

    def added(self, before: DataFrame) -> DataFrame:
        """Hashes that are stored now and were not among ``before``: what an operation wrote."""
        return self.hashes().join(before.select("hash"), "hash", "left_anti")

    def hashes(self) -> DataFrame:
        return self.all().select("hash").distinct()

    def rewrite(self, keep: DataFrame) -> None:
        """Garbage collection: what is not kept goes.  The survivors are written as a new part
        and the manifest then names that alone; old parts are deleted last, so a crash
        leaves either all of the old store or all of the new."""
        version, parts = self._parts()
        part = self._stage(integrity.dedup(integrity.sweep(self._frame(parts).drop("fan"), keep)))
        if not self._manifest.put("parts", version, json.dumps([part])):
            self.files.delete(f"parts/{part}")
            raise RuntimeError("the store was written to meanwhile")
        for p in parts:
            self.files.delete(f"parts/{p}")

    def delete(self, hash_: str) -> bool:
        """Take one chunk out; whether it was there."""
        if self.read(hash_).isEmpty():
            return False
        self.rewrite(self.hashes().where(F.col("hash") != hash_))
        return True

    def clear(self) -> None:
        """Take everything out."""
        self.rewrite(self.hashes().limit(0))

    def size(self) -> int:
        return self.hashes().count()

    def stats(self) -> DataFrame:
        """One row ``chunks, bytes``."""
        return integrity.dedup(self.all()).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"))

    def pull(self, remote: ChunkStore, edges: DataFrame | None = None, root: str | None = None) -> int:
        """Copy what is missing; the number of copied chunks.  Without edges all of the remote
        store; with them what the root reaches, level by level, where a chunk that is there
        is not expanded, as its subtree is there too (see ``integrity.unknown_below``)."""
        source = remote.verified()
        if edges is not None:
            wanted = integrity.unknown_below(edges, root, self.hashes())
            source = source.join(wanted, "hash", "left_semi")
        return self.add(source)


class MemoryStore:
    """The same by hash, held in the executors' memory; for tables that are small."""

    def __init__(self, spark: SparkSession, algorithm: str = "sha256"):
        self.spark, self.algorithm = spark, algorithm
        self._held = spark.createDataFrame([], SCHEMA)

    def write(self, data: DataFrame) -> DataFrame:
        rows = data.select(E.address("data", self.algorithm).alias("hash"), F.col("level").cast("int").alias("level"), "data")
        old = self._held
        self._held = old.unionByName(integrity.missing(rows, old)).persist()
        self._held.count()
        old.unpersist()
        return rows.select("hash").distinct()

    def read(self, hash_: str) -> DataFrame:
        if hash_ is None:
            raise ValueError("no hash")
        return self._held.where(F.col("hash") == hash_)

    def all(self) -> DataFrame:
        return self._held

    def size(self) -> int:
        return self._held.count()

    def clear(self) -> None:
        self._held.unpersist()
        self._held = self.spark.createDataFrame([], SCHEMA)


class SnapshotCache:
    """Tables kept in memory by name, the least recently used ones dropped beyond ``most``
    bytes (as Spark estimates a plan's size); ``hits`` and ``misses`` count."""

    def __init__(self, load: Callable[[str], DataFrame], most: int):
        self.load, self.most = load, most
        self._held: dict[str, tuple[DataFrame, int]] = {}
        self.hits = self.misses = 0

    @property
    def bytes(self) -> int:
        return sum(n for _, n in self._held.values())

    def get(self, name: str) -> DataFrame:
        if name in self._held:
            self.hits += 1
            self._held[name] = self._held.pop(name)
            return self._held[name][0]
        self.misses += 1
        df = self.load(name)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= self.most:
            self._held[name] = (df.persist(), size)
            while self.bytes > self.most:
                old = next(iter(self._held))
                self._held.pop(old)[0].unpersist()
        return df
