"""A repository of table versions: segments of rows, trees over them, commits, and refs.

Layout under one folder: ``data/<batch>/__seg=<n>`` (Parquet, a folder for neighbouring
segments of some ``FOLDER_ROWS`` rows together, named by its first; each row names its
segment), ``leaves/<batch>`` (the chunks of a batch's segments), ``trees/<id>`` (the levels
from segments up), ``roots/<root>.json``, ``commits/<id>.json`` and ``refs/<name>/<n>.json``.

A chunk is a run of entries in key order that closes after an entry whose key's hash
ends in ``bits`` zero bits; a segment closes where ``bits + file_bits`` are zero, so it is
a run of whole chunks.  Both depend on content alone, whatever the order of commits.  A
commit of edits reads and writes the segments that hold edited keys; the others are
named by the new tree as they were by the old one.  Two versions are compared by the
addresses of their segments, then of their chunks, and only rows of chunks that differ
are read on.

Where keys repeat (``TableSpec.repeats``) the rows of a key are in the order of their
entries' addresses, so a version is still named by its content alone; each of them closes
chunk and segment if the key does.

Data is written by Spark jobs; only the driver touches commits and refs, by files that
are published whole and once (see ``files``), so of two writers one loses.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import encoding as E
from lamina.model import TableSpec
from lamina.operators import chunks, history, merge
from lamina.operators.diff import as_edits, bag_pairs, bags, diff, invert
from lamina.operators.edits import apply_edits, compact
from lamina.operators.ranges import Ranges, numbered
from lamina.operators.scan import lower_bounds
from lamina.sources.files import Files, Register
from lamina.sources.shared import discard, materialize

UP_BITS = 4  # a node above the segments has some 2**UP_BITS children
#: Rows that a folder is to hold.  Small segments share one, so folders grow with rows, not segments; it stays while one of them is in use.
FOLDER_ROWS = 4096
#: Segments that a read names in its filter, which skips row groups; more are joined.
NAMED = 64
NAME = re.compile(r"[a-z][a-z0-9-]{0,62}")  # fixed value: the rule for repository names


def valid_name(name: str) -> bool:
    return bool(NAME.fullmatch(name))


@dataclass(frozen=True)
class Commit:
    commit_id: str
    root: str
    parents: tuple[str, ...]
    author: str
    message: str
    ts: int

    @staticmethod
    def make(root: str, parents: Iterable[str], author: str, message: str, ts: int) -> Commit:
        """The id leaves the time out, so equal histories have equal ids."""
        parents = tuple(parents)
        parts = [root, str(len(parents)), *parents, author, message]
        text = "".join(f"{len(p)}:{p};" for p in parts)
        return Commit(hashlib.sha256(text.encode()).hexdigest()[: E.ADDRESS_HEX], root, parents, author, message, ts)


class Conflict(Exception):
    """A merge that was not committed; ``rows`` are its conflicts, ``decided`` all changed keys."""

    def __init__(self, rows: DataFrame, decided: DataFrame):
        super().__init__("conflicting changes")
        self.rows, self.decided = rows, decided


class Repository:
    """Branches of one table.  ``read`` and ``written`` record the addresses of segments that
    operations have touched."""

    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, bits: int = 8, file_bits: int = 4, files: Files | None = None):
        self.spark, self.path, self.spec, self.bits, self.file_bits = spark, path.rstrip("/"), spec, bits, file_bits
        self.files = files or Files(spark, path)
        self._refs = Register(self.files, "refs")
        self._roots: dict[str, dict] = {}
        self.read: set[str] = set()
        self.written: set[str] = set()

    # refs ---------------------------------------------------------------

    @staticmethod
    def ref_name(name: str) -> str:
        return name if "/" in name else f"heads/{name}"

    def ref(self, name: str) -> str | None:
        """The commit a ref points to."""
        text = self._refs.get(self.ref_name(name))[1]
        return json.loads(text)["commit"] if text else None

    def update_ref(self, name: str, expected: str | None, new: str | None) -> bool:
        """Compare and set: a ref's next version can be published once."""
        version, text = self._refs.get(self.ref_name(name))
        if (json.loads(text)["commit"] if text else None) != expected:
            return False
        return self._refs.put(self.ref_name(name), version, json.dumps({"commit": new}))

    def delete_ref(self, name: str, expected: str | None) -> bool:
        return self.update_ref(name, expected, None)

    def refs(self, start: str = "") -> dict[str, str]:
        return {n: c for n in self._refs.names() if n.startswith(start) and (c := self.ref(n)) is not None}

    def branches(self) -> list[str]:
        return [n[6:] for n in self.refs("heads/")]

    def create_branch(self, name: str, source: str = "EMPTY") -> bool:
        """A new branch at another ref's commit; from EMPTY nothing is stored yet."""
        if source == "EMPTY":
            return True
        at = self.ref(source)
        return at is not None and self.ref(name) is None and self.update_ref(name, None, at)

    def tag(self, name: str, commit_id: str) -> bool:
        return self.update_ref(f"tags/{name}", None, commit_id)

    # commits ------------------------------------------------------------

    def commit_of(self, commit_id: str) -> Commit:
        text = self.files.read(f"commits/{commit_id}.json")
        if text is None:
            raise KeyError(commit_id)
        row = json.loads(text)
        return Commit(**{**row, "parents": tuple(row["parents"])})

    def commits(self) -> DataFrame:
        """The commit table."""
        schema = "commit_id string, root string, parents array<string>, author string, message string, ts long"
        if not self.files.exists("commits"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def add_commit(self, commit: Commit) -> None:
        """An equal one that is there already stays."""
        self.files.publish(f"commits/{commit.commit_id}.json", json.dumps(asdict(commit)))

    def at(self, commit_id: str) -> DataFrame:
        """Time travel."""
        return self.snapshot(self.commit_of(commit_id).root)

    def branch(self, name: str, empty: DataFrame | None = None) -> DataFrame:
        at = self.ref(name)
        if at is None:
            if empty is None:
                raise KeyError(f"branch {name} has no commit")
            return self.spec.select(empty).where(F.lit(False))
        return self.at(at)

    # trees ----------------------------------------------------------------

    def has_root(self, root: str) -> bool:
        return root in self._roots or self.files.exists(f"roots/{root}.json")

    def root_of(self, root: str) -> dict:
        """``tree`` (folder) and ``schema`` of a stored version."""
        if root not in self._roots:
            text = self.files.read(f"roots/{root}.json")
            if text is None:
                raise KeyError(f"no version {root}")
            self._roots[root] = json.loads(text)
        return self._roots[root]

    def schema(self, root: str) -> T.StructType:
        return T.StructType.fromJson(self.root_of(root)["schema"])

    def _key_type(self, schema: T.StructType) -> T.StructType:
        return T.StructType([schema[k] for k in self.spec.keys])

    def _tree_type(self, schema: T.StructType) -> T.StructType:
        key = self._key_type(schema)
        kinds = [("level", T.IntegerType()), ("pos", T.LongType()), ("address", T.StringType()), ("n", T.LongType()), ("first_key", key), ("last_key", key)]
        kinds += [("children", T.ArrayType(T.StringType())), ("child_n", T.ArrayType(T.LongType())), ("batch", T.StringType()), ("seg", T.StringType())]
        return T.StructType([T.StructField(n, t) for n, t in kinds])

    def tree(self, root: str) -> DataFrame:
        """``level, pos, address, n, first_key, last_key, children, child_n, batch, seg`` of the
        nodes from segments (level 1) up."""
        info = self.root_of(root)
        return self.spark.read.schema(self._tree_type(self.schema(root))).parquet(f"{self.path}/{info['tree']}")

    def segments(self, root: str) -> DataFrame:
        return self.tree(root).where("level = 1")

    def leaves(self, segments: DataFrame, schema: T.StructType) -> DataFrame:
        """``batch, seg, address, n, first_key, last_key`` of the chunks of some segments."""
        batches = [r.batch for r in segments.select("batch").distinct().collect()]
        key = self._key_type(schema)
        kind = T.StructType([T.StructField("seg", T.StringType()), T.StructField("address", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first_key", key), T.StructField("last_key", key)])
        out = self.spark.createDataFrame([], T.StructType([T.StructField("batch", T.StringType()), *kind.fields]))
        for b in batches:
            part = self.spark.read.schema(kind).parquet(f"{self.path}/leaves/{b}").select(F.lit(b).alias("batch"), *kind.names)
            out = out.unionByName(part)
        return out.join(segments.select("batch", "seg"), ["batch", "seg"])

    def nodes(self, root: str) -> DataFrame:
        """Every node of a version: the tree and, as level 0, its chunks."""
        tree = self.tree(root)
        low = self.leaves(tree.where("level = 1"), self.schema(root))
        low = low.select(F.lit(0).alias("level"), F.lit(None).cast("long").alias("pos"), "address", "n", "first_key", "last_key", F.lit(None).cast("array<string>").alias("children"), F.lit(None).cast("array<long>").alias("child_n"), "batch", "seg")
        return tree.unionByName(low)

    def edges(self, root: str) -> DataFrame:
        return self.tree(root).select(F.col("address").alias("parent"), F.explode("children").alias("child"))

    @staticmethod
    def folder(batch: str, seg: str) -> str:
        """Where a segment is: ``<range>-<first>`` names a folder and its first segment,
        ``<range>-<first>-<n>`` another one in there."""
        return f"data/{batch}/__seg={'-'.join(seg.split('-')[:2])}"

    def _rows(self, segments: DataFrame, schema: T.StructType, leaf: bool = False) -> DataFrame:
        """The rows of some segments, with their chunk's address as ``__leaf`` if asked for.
        The driver gets a row for each segment, which names its folder."""
        found = segments.select("address", "batch", "seg").collect()
        self.read |= {r.address for r in found}
        whole = T.StructType([*(schema[c] for c in self.spec.columns), T.StructField("__leaf", T.StringType()), T.StructField("__id", T.StringType())])
        columns = [*self.spec.columns, *(["__leaf"] if leaf else [])]
        if not found:
            return self.spark.createDataFrame([], whole).select(*columns)
        ids = [f"{r.batch}/{r.seg}" for r in found]
        rows = self.spark.read.schema(whole).parquet(*sorted({f"{self.path}/{self.folder(r.batch, r.seg)}" for r in found}))
        if len(ids) <= NAMED and len(set(ids)) == len(ids):
            return rows.where(F.col("__id").isin(ids)).select(*columns)
        named = self.spark.createDataFrame([(i,) for i in ids], "__id string")  # one more than once only where a key has equal rows
        return rows.join(F.broadcast(named), "__id").select(*columns)

    def snapshot(self, root: str) -> DataFrame:
        return self._rows(self.segments(root), self.schema(root))

    def _hash(self, of: str = "") -> Column:
        return F.conv(F.substring(E.address(E.entry(*(f"{of}{k}" for k in self.spec.keys))), 1, 8), 16, 10).cast("long")

    def _tie(self) -> Column:
        """What orders the rows of a key."""
        return E.address(E.entry(*self.spec.columns)) if self.spec.repeats else F.lit(None).cast("string")

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows as segments; ``batch, seg, address, n, first_key, last_key`` of their chunks.

        Ranges are cut after keys that close a segment, so every segment and chunk is whole
        in one task: rows are shuffled once.  A chunk's rows meet in memory, no more."""
        spec, keys, batch = self.spec, list(self.spec.keys), uuid.uuid4().hex
        few, many = (1 << self.bits) - 1, (1 << (self.bits + self.file_bits)) - 1
        marked = spec.select(rows).withColumn("__h", self._hash()).withColumn("__t", self._tie())
        cuts = Ranges(marked.where(F.col("__h").bitwiseAND(F.lit(many)) == 0), keys)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = marked.withColumn("__b", cuts.number(after=True)).repartition(n, "__b")
        order = Window.partitionBy("__b").orderBy(*keys, *(["__t"] if spec.repeats else []))
        before = order.rowsBetween(Window.unboundedPreceding, -1)

        def closed(mask: int) -> Column:
            return F.coalesce(F.sum((F.col("__h").bitwiseAND(F.lit(mask)) == 0).cast("long")).over(before), F.lit(0))

        key, last = spec.key(), F.lag(spec.key()).over(order)
        once = F.lit(None) if spec.repeats else F.assert_true(~key.eqNullSafe(last), F.lit("key occurs twice"))
        placed = dealt.select("__b", closed(many).alias("__s"), closed(few).alias("__l"), *spec.columns, "__t", once.alias("__once")).where("__once is null")
        entry = F.struct(spec.key().alias("k"), F.col("__t").alias("t"), E.entry(*spec.columns).alias("e"), spec.value().alias("v") if spec.values else F.lit(None).alias("v"))
        made = placed.groupBy("__b", "__s", "__l").agg(F.sort_array(F.collect_list(entry)).alias("x"))
        first = F.col("__s") - F.col("__s") % max(1, FOLDER_ROWS >> (self.bits + self.file_bits))
        seg = F.when(F.col("__s") == first, F.concat_ws("-", "__b", first)).otherwise(F.concat_ws("-", "__b", first, "__s"))
        made = made.select(F.concat_ws("-", "__b", first).alias("__seg"), F.concat(F.lit(f"{batch}/"), seg).alias("__id"), E.address(F.array_join(F.transform("x", lambda r: r["e"]), "")).alias("__leaf"), "x")
        made = made.select("__seg", "__id", "__leaf", F.explode("x").alias("r"))  # a step of its own, else each row would make its chunk's address
        flat = made.select("__seg", "__id", "__leaf", "r.k.*", *([f"r.v.{v}" for v in spec.values]))
        try:
            flat.sortWithinPartitions("__seg", *keys).write.partitionBy("__seg").parquet(f"{self.path}/data/{batch}")
        except Exception as e:
            self.files.delete(f"data/{batch}")
            if "key occurs twice" in str(e):
                raise ValueError("a key occurs twice") from None
            raise
        key_columns = [rows.schema[k] for k in keys]
        stored = T.StructType([*key_columns, *(T.StructField(n, T.StringType()) for n in ("__leaf", "__id", "__seg"))])
        kept = self.spark.read.schema(stored).parquet(f"{self.path}/data/{batch}")
        leaves = kept.groupBy(F.substring_index("__id", "/", -1).alias("seg"), F.col("__leaf").alias("address")).agg(
            F.count(F.lit(1)).alias("n"), F.min(spec.key()).alias("first_key"), F.max(spec.key()).alias("last_key")
        )
        if spec.repeats:  # equal rows of a key that closes are chunks of one row each
            alone = (F.col("first_key") == F.col("last_key")) & (self._hash("last_key.").bitwiseAND(F.lit(few)) == 0)
            times = F.when(alone, F.col("n").cast("int")).otherwise(1)
            leaves = leaves.withColumn("__i", F.explode(F.array_repeat(F.lit(1), times))).withColumn("n", F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n"))).drop("__i")
        leaves.write.parquet(f"{self.path}/leaves/{batch}")
        return self.spark.read.schema(leaves.schema).parquet(f"{self.path}/leaves/{batch}").select(F.lit(batch).alias("batch"), "*")

    @staticmethod
    def _over(leaves: DataFrame) -> DataFrame:
        """The segments' nodes from their chunks."""
        row = F.struct("first_key", "address", "n")
        grouped = leaves.groupBy("batch", "seg").agg(F.sort_array(F.collect_list(row)).alias("es"), F.sum("n").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
        text = F.array_join(F.transform("es", lambda x: F.concat_ws(":", x["address"], x["n"].cast("string"))), ";")
        return grouped.select("batch", "seg", E.address(text).alias("address"), "n", "first_key", "last_key", F.transform("es", lambda x: x["address"]).alias("children"), F.transform("es", lambda x: x["n"]).alias("child_n"))

    def _drop(self, gone: list[tuple[str, str]], kept: list[tuple[str, str]]) -> None:
        """Delete segments that no tree names; folders that hold others too are written anew."""
        goes, stays = ({self.folder(*x) for x in side} for side in (gone, kept))
        for batch in {b for b, _ in gone}:
            mixed = sorted(f for f in goes & stays if f.startswith(f"data/{batch}/"))
            if not mixed:
                continue
            ids = self.spark.createDataFrame([(f"{b}/{s}",) for b, s in kept if b == batch], "__id string")
            rows = self.spark.read.option("basePath", f"{self.path}/data/{batch}").parquet(*(f"{self.path}/{f}" for f in mixed))
            left = materialize(rows.withColumn("__seg", F.regexp_extract("__id", "/([^-]+-[^-]+)", 1)).join(F.broadcast(ids), "__id", "left_semi"), "left")
            for f in mixed:
                self.files.delete(f)
            left.repartition("__seg").sortWithinPartitions("__seg", *self.spec.keys).write.mode("append").partitionBy("__seg").parquet(f"{self.path}/data/{batch}")
            discard(left)
        for f in goes - stays:
            self.files.delete(f)

    def _publish_tree(self, segments: DataFrame, schema: T.StructType, size: int) -> str:
        """Number the segments, make the levels above, and publish their root.  All of it is
        metadata: a row for each of the ``size`` segments and less above."""
        keys, folder = list(self.spec.keys), f"trees/{uuid.uuid4().hex}"
        names = [f"__k{i}" for i in range(len(keys))]
        placed = segments.select("*", *(F.col(f"first_key.{k}").alias(n) for k, n in zip(keys, names)))
        kind = self._tree_type(schema)
        ties = [F.get("children", F.lit(0))] if self.spec.repeats else []  # segments that begin at one key have one row each
        level = materialize(numbered(placed, names, "pos", max(1, -(-size // chunks.PER_TASK)), ties).withColumn("level", F.lit(1)).select(*kind.names), "level")
        above = chunks.levels_above(level, UP_BITS, size)
        whole = level
        for i, up in enumerate(above):
            full = up.select(F.lit(i + 2).alias("level"), *kind.names[1:8], F.lit(None).cast("string").alias("batch"), F.lit(None).cast("string").alias("seg"))
            whole = whole.unionByName(full)
        whole.write.parquet(f"{self.path}/{folder}")
        top = (above[-1] if above else level).select("address", "n").first()
        root = top.address if top else chunks.EMPTY_ROOT
        self._add_root(root, folder, schema, top.n if top else 0, 1 + len(above), size)
        for df in (level, *above):
            discard(df)
        return root

    def _add_root(self, root: str, folder: str, schema: T.StructType, n: int, height: int, segments: int) -> None:
        """The first writer of a root names its tree; later ones wrote the same."""
        info = {"tree": folder, "schema": schema.jsonValue(), "n": n, "height": height, "segments": segments}
        if not self.files.publish(f"roots/{root}.json", json.dumps(info)):
            self.files.delete(folder)

    def _stored_schema(self, df: DataFrame) -> T.StructType:
        return T.StructType([T.StructField(c, df.schema[c].dataType) for c in self.spec.columns])

    def store(self, df: DataFrame, like: str | None = None) -> str:
        """Write a version under its content's root id; segments that version ``like`` has
        are not kept twice."""
        schema = self._stored_schema(df)
        made = materialize(self._over(self._write(df)), "segments")
        if like is not None and self.schema(like) == schema:
            old = self.segments(like).select("address", F.col("batch").alias("old_batch"), F.col("seg").alias("old_seg"))
            both = materialize(made.join(old.dropDuplicates(["address"]), "address", "left"), "segments")
            found = both.select("address", "batch", "seg", "old_batch").collect()
            self.written |= {r.address for r in found if r.old_batch is None}
            self._drop([(r.batch, r.seg) for r in found if r.old_batch is not None], [(r.batch, r.seg) for r in found if r.old_batch is None])
            made = both.withColumn("batch", F.coalesce("old_batch", "batch")).withColumn("seg", F.coalesce("old_seg", "seg")).drop("old_batch", "old_seg")
        else:
            found = made.select("address").collect()
            self.written |= {r.address for r in found}
        return self._publish_tree(made, schema, len(found))

    def store_edits(self, root: str, edits: DataFrame) -> str:
        """The version that compacted edits (``keys, values, is_delete``; where keys repeat, all
        rows that an edited key is to have) make of another: reads and writes the segments that hold edited keys, and the one after a segment
        whose closing key goes."""
        spec, keys, schema = self.spec, list(self.spec.keys), self.schema(root)
        live = materialize(edits.select(*spec.columns, "is_delete"), "edits")
        segs = self.segments(root).select("*", *(F.col(f"last_key.{k}").alias(k) for k in keys))
        size = self.root_of(root)["segments"]
        if not size:
            return self.store(live.where(~F.col("is_delete")).select(*spec.columns))
        last = size - 1
        lows = segs.groupBy(*keys).agg(F.min("pos").alias("pos")) if spec.repeats else segs  # of segments that end with one key the first has the keys before it
        hit = lower_bounds(lows, keys, live.select(*keys), F.col("pos"), "pos").select(F.coalesce("pos", F.lit(last)).alias("pos"))
        gone = live.where("is_delete").select(*(F.col(k).alias(f"__{k}") for k in keys))
        after = segs.join(gone, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select((F.col("pos") + 1).alias("pos"))
        hit = hit.unionByName(after.where(F.col("pos") <= last))
        if spec.repeats:  # more segments may end with the key, and one begin with it
            mine = live.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
            for end in ("first_key", "last_key"):
                hit = hit.unionByName(self.segments(root).join(mine, [F.col(f"{end}.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys]).select("pos"))
        touched = materialize(hit.distinct(), "touched")
        n = touched.count()
        if not n:
            return root
        segs = self.segments(root)
        old = self._rows(segs.join(touched, "pos", "left_semi"), schema)
        rows = materialize(apply_edits(old, live, spec), "rows")
        new = materialize(self._over(self._write(rows)), "segments")
        found = new.select("address").collect()
        self.written |= {r.address for r in found}
        kept = segs.join(touched, "pos", "left_anti").select(*new.columns)
        return self._publish_tree(kept.unionByName(new), schema, size - n + len(found))

    # committing -------------------------------------------------------------

    def commit_root(self, branch: str, root: str, expected: str | None, author: str, message: str, parents: list[str] | None = None, ts: int | None = None) -> Commit | None:
        """Publish a stored version; None if the branch has moved from ``expected`` meanwhile."""
        made = Commit.make(root, parents if parents is not None else [expected] if expected else [], author, message, int(time.time() * 1000) if ts is None else ts)
        self.add_commit(made)
        return made if self.update_ref(branch, expected, made.commit_id) else None

    def commit(self, branch: str, df: DataFrame, expected: str | None, author: str, message: str, parents: list[str] | None = None, ts: int | None = None) -> Commit | None:
        """Store a whole table and publish it; None if the branch has moved."""
        if self.ref(branch) != expected:
            return None
        like = self.commit_of(expected).root if expected else None
        return self.commit_root(branch, self.store(df, like), expected, author, message, parents, ts)

    def commit_edits(self, branch: str, edits: DataFrame, expected: str | None, author: str, message: str, ts: int | None = None, order: str | None = None) -> Commit | None:
        """Store what edits (``keys, values, is_delete``; with ``order``, the last of each key
        counts) make of the head and publish it; None if the branch has moved."""
        if self.ref(branch) != expected:
            return None
        if order is not None:
            edits = compact(edits, self.spec, order)
        if expected is None:
            root = self.store(edits.where(~F.col("is_delete")).select(*self.spec.columns))
        else:
            root = self.store_edits(self.commit_of(expected).root, edits)
        return self.commit_root(branch, root, expected, author, message, None, ts)

    def update(self, branch: str, change: Callable[[DataFrame], DataFrame], author: str, message: str, empty: DataFrame | None = None, tries: int = 10) -> Commit:
        """Commit ``change(head table)``; a writer that loses the race starts again on the new
        head, at most ``tries`` times."""
        return self._retry(branch, tries, lambda head: self.commit(branch, change(self.branch(branch, empty)), head, author, message))

    def update_edits(self, branch: str, edits: DataFrame, author: str, message: str, order: str | None = None, tries: int = 10) -> Commit:
        """Commit edits on whatever the head is."""
        return self._retry(branch, tries, lambda head: self.commit_edits(branch, edits, head, author, message, order=order))

    def _retry(self, branch: str, tries: int, attempt: Callable[[str | None], Commit | None]) -> Commit:
        for _ in range(tries):
            made = attempt(self.ref(branch))
            if made is not None:
                return made
        raise RuntimeError(f"{branch} kept moving")

    # changes between commits -------------------------------------------

    def diff_roots(self, a: str, b: str) -> DataFrame:
        """Between two versions: rows of chunks that only one of them has are joined.  Equal
        roots have no difference and nothing is read."""
        if self.spec.repeats:
            return bag_pairs(self.bags_of_roots(a, b), self.spec)
        return diff(*self._unlike_rows(a, b), self.spec)

    def bags_of_roots(self, a: str, b: str) -> DataFrame:
        """The same, by key with all its rows: see ``diff.bags``."""
        return bags(*self._unlike_rows(a, b), self.spec)

    @staticmethod
    def _with_ends(a: DataFrame, b: DataFrame) -> list[DataFrame]:
        """Of two versions' nodes (of one level) those that the other has not, or not as often, and
        those that begin or end at a key where one of these does: they may hold more of its rows."""
        counts = [x.groupBy("address").agg(F.count(F.lit(1)).alias("__n")) for x in (a, b)]
        only = [x.join(p.join(q, ["address", "__n"], "left_anti").select("address"), "address", "left_semi") for x, p, q in ((a, counts[0], counts[1]), (b, counts[1], counts[0]))]
        ends = [x.select(F.explode(F.array("first_key", "last_key")).alias("__end")) for x in only]
        ends = materialize(ends[0].unionByName(ends[1]).distinct(), "ends")
        out = []
        for x in (a, b):
            marked = x.withColumn("__id", F.monotonically_increasing_id())
            near = marked.select("*", F.explode(F.array_distinct(F.array("first_key", "last_key"))).alias("__end")).join(ends, "__end", "left_semi")
            out.append(materialize(near.dropDuplicates(["__id"]).drop("__end", "__id"), "only"))
        return out

    def _unlike_rows(self, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        """The rows of two versions' chunks that only one of them has."""
        schema = self.schema(a)
        if a == b:
            none = self.spark.createDataFrame([], schema)
            return none, none
        sa, sb = self.segments(a), self.segments(b)
        if self.spec.repeats:
            near_a, near_b = self._with_ends(sa, sb)
            low_a, low_b = self._with_ends(self.leaves(near_a, schema), self.leaves(near_b, self.schema(b)))
            rows = [self._rows(x, s, True).join(low.select(F.col("address").alias("__leaf")), "__leaf", "left_semi") for x, s, low in ((near_a, schema, low_a), (near_b, self.schema(b), low_b))]
            return rows[0], rows[1]
        only_a, only_b = (materialize(x.join(y.select("address"), "address", "left_anti"), "only") for x, y in ((sa, sb), (sb, sa)))
        chunks_a, chunks_b = (self.leaves(x, s).select(F.col("address").alias("__leaf")) for x, s in ((only_a, schema), (only_b, self.schema(b))))
        rows_a = self._rows(only_a, schema, True).join(chunks_b, "__leaf", "left_anti")
        rows_b = self._rows(only_b, self.schema(b), True).join(chunks_a, "__leaf", "left_anti")
        return rows_a, rows_b

    def diff(self, a: str, b: str) -> DataFrame:
        """Between two commits."""
        return self.diff_roots(self.commit_of(a).root, self.commit_of(b).root)

    def bags(self, a: str, b: str) -> DataFrame:
        """The same, by key with all its rows."""
        return self.bags_of_roots(self.commit_of(a).root, self.commit_of(b).root)

    def _base(self, a: str, b: str) -> tuple[str | None, tuple[DataFrame, DataFrame] | None]:
        """The commit to merge over or, for a criss-cross, a virtual base and its disputed keys."""
        table = self.commits()
        minimal = sorted(r.commit_id for r in history.minimal_common_ancestors(table, a, b).collect())
        if len(minimal) == 2:
            left = self.at(minimal[0])
            below, made = self._base(*minimal)
            root = made[0] if made else self.at(below) if below else left.where(F.lit(False))
            return None, merge.virtual_base(root, left, self.at(minimal[1]), self.spec)
        if len(minimal) > 2:
            return history.merge_base(table, a, b).first().commit_id, None
        return (minimal[0] if minimal else None), None

    def decide(self, a: str, b: str) -> DataFrame:
        """What a merge of two commits does with every key that either changed."""
        base, made = self._base(a, b)
        if made is not None:
            decided = merge.three_way(made[0], self.at(a), self.at(b), self.spec)
            decided = merge.contested(decided, made[1], self.spec)
            return decided if self.spec.repeats else decided.where("outcome <> 'same'")
        if base is None:
            left = self.at(a)
            return merge.three_way(left.where(F.lit(False)), left, self.at(b), self.spec)
        if self.spec.repeats:
            return merge.from_bags(self.bags(base, a), self.bags(base, b), self.spec)
        return merge.from_diffs(self.diff(base, a), self.diff(base, b), self.spec)

    def merge(self, ours: str, theirs: str, author: str, message: str, policy: merge.Policy | None = None, ts: int | None = None, resolutions: DataFrame | None = None) -> Commit | None:
        """Merge branch ``theirs`` into ``ours`` by a commit with two parents, also where it
        could be moved forward.  Where one side is the base its root is taken and nothing is
        read; else only what their side changed is written.  Conflicts that neither
        ``resolutions`` (see ``merge.resolve``) nor the policy settles raise ``Conflict``."""
        a, b = self.ref(ours), self.ref(theirs)
        if a is None or b is None:
            raise ValueError("both branches need a commit")
        ra, rb = self.commit_of(a).root, self.commit_of(b).root
        base, made = self._base(a, b)
        if base is not None and self.commit_of(base).root in (ra, rb):
            return self.commit_root(ours, rb if self.commit_of(base).root == ra else ra, a, author, message, [a, b], ts)
        decided = self.decide(a, b)
        if resolutions is not None:
            decided = merge.resolve(decided, resolutions, self.spec)
        decided = materialize(decided, "merge")
        if policy is None:
            found = merge.conflicts(decided, self.spec)
            if not found.isEmpty():
                raise Conflict(found, decided)
        root = self.store_edits(ra, merge.edits_on_ours(decided, self.spec, policy))
        return self.commit_root(ours, root, a, author, message, [a, b], ts)

    def _change(self, commit_id: str) -> DataFrame:
        parents = self.commit_of(commit_id).parents
        if not parents:
            raise ValueError("a first commit is no change to another")
        return self.diff(parents[0], commit_id)

    def cherry_pick(self, branch: str, commit_id: str, author: str, message: str) -> Commit | None:
        """What the commit changed against its first parent, laid over the branch."""
        return self.commit_edits(branch, as_edits(self._change(commit_id), self.spec), self.ref(branch), author, message)

    def revert(self, branch: str, commit_id: str, author: str, message: str) -> Commit | None:
        return self.commit_edits(branch, as_edits(invert(self._change(commit_id), self.spec), self.spec), self.ref(branch), author, message)

    def log(self, branch: str) -> DataFrame:
        return history.first_parent_log(self.commits(), self.ref(branch)).join(self.commits(), "commit_id")

    def line(self, branch: str) -> list[str]:
        """The branch's commits along first parents, the head first."""
        return [r.commit_id for r in history.first_parent_log(self.commits(), self.ref(branch)).orderBy("depth").collect()]

    def blame(self, branch: str, group: int = 16) -> DataFrame:
        """``keys, commit_id`` of every key of the branch's head: the first-parent commit that
        gave it its value, which is the last to have changed it.  Made from the differences
        between neighbouring versions, some at a time, so unchanged chunks are not read.  Where
        keys repeat, of every row, with its values."""
        path, spec, rows = self.line(branch), self.spec, None
        keys = spec.columns if spec.repeats else list(spec.keys)
        for start in range(0, len(path), group):
            part = None
            for depth in range(start, min(len(path), start + group)):
                if depth + 1 < len(path) and spec.repeats:
                    one = self.bags(path[depth + 1], path[depth])
                    moves = [one.select(*spec.keys, F.explode(F.array_except(x, y)).alias("__v")).select(*spec.keys, "__v.*", F.lit(x == "old").alias("gone")) for x, y in (("new", "old"), ("old", "new"))]
                    one = moves[0].unionByName(moves[1])
                elif depth + 1 < len(path):
                    one = self.diff(path[depth + 1], path[depth]).select(*spec.keys, (F.col("diff_type") == "DEL").alias("gone"))
                else:
                    one = self.at(path[depth]).select(*keys, F.lit(False).alias("gone"))
                one = one.withColumn("depth", F.lit(depth))
                part = one if part is None else part.unionByName(one)
            part = materialize(part.groupBy(*keys).agg(F.min(F.struct("depth", "gone")).alias("x")), "blame")
            rows = part if rows is None else rows.unionByName(part)
        last = rows.groupBy(*keys).agg(F.min("x").alias("x")).where("not x.gone")
        if spec.repeats:  # as often as the head has the row
            times = self.at(path[0]).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__n"))
            named = last.select(*(F.col(k).alias(f"__{k}") for k in keys), "x")
            last = times.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).withColumn("__i", F.explode(F.array_repeat(F.lit(1), F.col("__n"))))
        return last.select(*keys, F.get(F.array(*(F.lit(c) for c in path)), F.col("x.depth")).alias("commit_id"))

    def bisect(self, good: str, bad: str, is_bad) -> str:
        path = [r.commit_id for r in history.first_parent_log(self.commits(), bad).orderBy(F.col("depth").desc()).collect()]
        if good not in path:
            raise ValueError("good is not behind bad on first parents")
        return history.bisect(path[path.index(good) :], lambda c: is_bad(self.commit_of(c)))

    # looking up by the tree ------------------------------------------------

    def get(self, root: str, key) -> DataFrame:
        """The row of a key, read from the one segment that can hold it."""
        from lamina.operators import scan

        wanted = F.struct(*(F.lit(k).alias(n) for k, n in zip(key if isinstance(key, tuple) else (key,), self.spec.keys)))
        near = self.segments(root).where((F.col("first_key") <= wanted) & (F.col("last_key") >= wanted))
        return scan.get(self._rows(near, self.schema(root)), self.spec, key)

    def nth(self, root: str, n: int) -> DataFrame:
        """The n-th row in key order, from 0, read from the segment that the counts name."""
        from lamina.operators import scan

        near = chunks.nth_entry_chunk(self.segments(root), n).first()
        if near is None:
            return self.snapshot(root).where(F.lit(False))
        rows = self._rows(self.segments(root).where(F.col("pos") == near.pos), self.schema(root))
        if self.spec.repeats:
            return rows.orderBy(*self.spec.keys, self._tie()).offset(int(near.offset)).limit(1)
        return scan.get(rows, self.spec, tuple(scan.rank_nth(rows, self.spec, near.offset).first()))

    # housekeeping --------------------------------------------------------

    def shallow(self) -> set[str]:
        """Parents that retention has cut off."""
        return {x[:-5] for x in self.files.list("shallow") if x.endswith(".json")}

    def kept(self, heads_only: bool = False, last: int | None = None) -> set[str]:
        """Commits that refs hold.  Tags hold what they name unless ``heads_only``.  With
        ``last``, of each branch only so many commits of its first-parent line are held; a
        tagged one always is."""
        keep: set[str] = set()
        table = self.commits()
        known = {x[:-5] for x in self.files.list("commits") if x.endswith(".json")}
        for name, commit_id in self.refs().items():
            head = name.startswith("heads/")
            if last is not None:
                keep |= {r.commit_id for r in history.first_parent_log(table, commit_id).where(F.col("depth") < last).collect()} if head else {commit_id}
            elif not heads_only or head:
                keep |= {r.commit_id for r in history.ancestors(table, commit_id).collect()}
        return keep & known

    def gc(self, heads_only: bool = False, last: int | None = None) -> tuple[int, int]:
        """Delete commits, versions and segments that no ref holds: (kept, swept) versions.
        Parents that ``last`` cuts off are noted as shallow.  Nobody may write meanwhile."""
        keep = self.kept(heads_only, last)
        commits = [self.commit_of(c) for c in keep]
        for p in {p for c in commits for p in c.parents} - keep:
            self.files.publish(f"shallow/{p}.json", "{}")
        for x in self.files.list("commits"):
            if x.endswith(".json") and x[:-5] not in keep:
                self.files.delete(f"commits/{x}")
        roots = {c.root for c in commits}
        stored = {x[:-5] for x in self.files.list("roots") if x.endswith(".json")}
        live: set[str] = set()
        trees = set()
        for root in stored & roots:
            trees.add(self.root_of(root)["tree"].split("/")[1])
            live |= {self.folder(r.batch, r.seg) for r in self.segments(root).select("batch", "seg").collect()}
        for root in stored - roots:
            self.files.delete(f"roots/{root}.json")
            self._roots.pop(root, None)
        for tree in set(self.files.folders("trees")) - trees:
            self.files.delete(f"trees/{tree}")
        batches = {f.split("/")[1] for f in live}
        for batch in self.files.folders("data"):
            for seg in self.files.folders(f"data/{batch}"):
                if f"data/{batch}/{seg}" not in live:
                    self.files.delete(f"data/{batch}/{seg}")
            if batch not in batches:
                self.files.delete(f"data/{batch}")
                self.files.delete(f"leaves/{batch}")
        return len(stored & roots), len(stored - roots)

    def stats(self) -> DataFrame:
        """``root, entries, height, segments, bytes`` (of its folders) of each stored version, from
        metadata and the file listing."""
        rows = []
        for x in self.files.list("roots"):
            if x.endswith(".json"):
                info, segs = self.root_of(x[:-5]), self.segments(x[:-5]).select("batch", "seg").collect()
                rows.append((x[:-5], info["n"], info["height"], len(segs), sum(self.files.size(f) for f in {self.folder(r.batch, r.seg) for r in segs})))
        return self.spark.createDataFrame(rows, "root string, entries long, height int, segments int, bytes long")

    def verify(self) -> list[str]:
        """Versions whose rows, chunks or nodes do not hash to their addresses, and commits
        whose version is missing."""
        out, good = [], set()
        stored = [x[:-5] for x in self.files.list("roots") if x.endswith(".json")]
        for root in sorted(stored):
            tree, schema = self.tree(root), self.schema(root)
            text = F.array_join(F.transform(F.arrays_zip("children", "child_n"), lambda x: F.concat_ws(":", x["children"], x["child_n"].cast("string"))), ";")
            wrong = not tree.where(E.address(text) != F.col("address")).isEmpty()
            segs = tree.where("level = 1")
            if good:
                segs = segs.where(~F.col("address").isin(sorted(good)))
            fresh = {r.address for r in segs.select("address").collect()}
            rows = self._rows(segs, schema, True)
            entry = F.struct(self.spec.key().alias("k"), self._tie().alias("t"), E.entry(*self.spec.columns).alias("e"))
            named = segs.select(F.explode("children").alias("__leaf")).groupBy("__leaf").agg(F.count(F.lit(1)).alias("__m"))
            made = rows.groupBy("__leaf").agg(F.sort_array(F.collect_list(entry)).alias("x"))
            if self.spec.repeats:  # of equal chunks one
                made = made.join(named, "__leaf", "left").withColumn("x", F.filter("x", lambda r, i: i % F.coalesce("__m", F.lit(1)) == 0))
            made = made.select("__leaf", E.address(F.array_join(F.transform("x", lambda r: r["e"]), "")).alias("now"))
            bad = made.join(named.withColumn("named", F.lit(True)), "__leaf", "full_outer").where("now is null or named is null or now <> __leaf")
            top = tree.agg(F.max_by("address", "level")).first()[0] or chunks.EMPTY_ROOT
            if wrong or top != root or not bad.isEmpty():
                out.append(f"mismatch {root}")
            else:
                good |= fresh
        lost = [f"missing {r.root}" for r in self.commits().select("root").distinct().collect() if r.root not in stored]
        return out + sorted(lost)
